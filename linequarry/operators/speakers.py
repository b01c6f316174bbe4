"""Speaker tracking over ordered lines, as one pass of window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chars, clean, dialogue
from ..options import CleanOptions
from .lines import explode_lines


def carry_forward(df: DataFrame, value: str, scope: list[str], order: list, out: str = "carried") -> DataFrame:
    """Last non-null value at or before each row of its scope."""
    w = W.partitionBy(*scope).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def bare_name_lead(df: DataFrame, scope: list[str], order: list) -> DataFrame:
    """Rows with `current`, the speaker in force, and without the lines that only name them.

    Expects no blank lines and the columns bare (name or null), declared (name or null),
    hint and pairs (rows of dialogue.extract). A bare name counts if the next line has a
    hint or gives lines without speakers only; its own line then goes.
    """
    w = W.partitionBy(*scope).orderBy(*order)
    following = F.lead("pairs").over(w)
    unnamed = (F.size(following) > 0) & ~F.exists(following, lambda r: r["speaker"] != "")
    confirmed = F.when(F.col("bare").isNotNull() & ((F.coalesce(F.trim(F.lead("hint").over(w)), F.lit("")) != "") | F.coalesce(unnamed, F.lit(False))), F.col("bare"))
    named = df.withColumn("_set", F.coalesce(confirmed, F.col("declared")))
    carried = carry_forward(named, "_set", scope, order, "current").drop("_set")
    return carried.filter(~(F.col("bare").isNotNull() & F.coalesce(F.col("bare") == F.col("current"), F.lit(False))))


def dialogue_rows(candidates: DataFrame, opts: CleanOptions, scope: list[str] | None = None, order: list | None = None) -> DataFrame:
    """speaker and text for every line of dialogue among candidates (scope..., line_no, hint, line).

    Adds sub_no, the place inside a line. Inline speakers come before hints, hints before
    the speaker carried along; the narration label comes last.
    """
    scope, order = scope or ["script_id"], order or ["line_no"]
    filled = candidates.withColumn("hint", F.coalesce("hint", F.lit(""))).filter(chars.strip(F.coalesce("line", F.lit(""))) != "")
    declared = F.when(F.lit(opts.tracking), F.nullif(dialogue.declaration(F.col("line")), F.lit("")))
    bare = F.when(F.lit(opts.guess_bare_speakers) & clean.bare_name(F.col("line")), chars.strip(F.col("line")))
    # The prepared line is made in a projection of its own, so that what follows reads it and does not repeat it.
    ready = filled.withColumn("prepared", dialogue.prepared(F.col("line"), opts)).withColumn("declared", declared).withColumn("bare", bare)
    ready = ready.withColumn("pairs", dialogue.extract(F.col("prepared"), opts))
    if opts.guess_bare_speakers:
        ready = bare_name_lead(ready, scope, order)
    elif opts.tracking:
        ready = carry_forward(ready, "declared", scope, order, "current")
    else:
        ready = ready.withColumn("current", F.lit(None).cast("string"))
    keep = [c for c in candidates.columns if c not in ("line", "hint")]
    rows = ready.select(*keep, "hint", "current", F.posexplode("pairs").alias("sub_no", "pair"))
    speaker = F.when(F.col("pair.speaker") != "", F.col("pair.speaker")).otherwise(F.coalesce(F.nullif(F.trim("hint"), F.lit("")), F.col("current"), F.lit("")))
    label = F.lit(opts.narration_speaker)
    named = F.when(speaker == "", label).otherwise(speaker) if opts.narration_speaker else speaker
    # Normalised here, so that deduplication sees what comes out.
    return rows.select(*keep, "sub_no", clean.squeeze(named).alias("speaker"), F.col("pair.text").alias("text"))


def dialogue_of_text(texts: DataFrame, opts: CleanOptions, key: str = "script_id", text: str = "text") -> DataFrame:
    """dialogue_rows of whole texts, one a script; line numbers start at 0."""
    rows = explode_lines(texts.select(F.col(key), F.col(text).alias("text")))
    return dialogue_rows(rows.withColumn("hint", F.lit("")), opts, [key])

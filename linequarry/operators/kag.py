"""KAG scripts: continuation lines, skip blocks, tags, speaker declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chars, dialogue
from .speakers import carry_forward

#: Escaped bracket, whole tag (quotes respected), unterminated rest; replaced by groups 1 and 2.
TAGS = r"(\[)\[|\[(?:[^\]\"']++|\"[^\"]*+\"|'[^']*+')*+\]|(\[(?s:.*))"
# Blocks that are skipped, and tags that give a KAG script away.
BLOCKS = ("iscript", "ignore")
SIGNS = r"(?i)\[(cm|ct|er|r|l|p|wait|ruby|if|endif|iscript|endscript|jump|call|bg|image|name|font|color|position|quake|trans)(?![A-Za-z0-9_])"
_NAMED = r"\A[^「」『』\"“”\s\x{3000}:：,，。]{1,16}\s*[「『\"“]"


def strip_kag_tags(c: Column) -> Column:
    return F.regexp_replace(c, TAGS, "$1$2")


def looks_like_kag(text: Column) -> Column:
    return F.substring(text, 1, 8192).rlike(SIGNS)


def join_continued(lines: DataFrame, scope: list[str], line_no: str = "line_no", line: str = "line") -> DataFrame:
    """Lines that end in a single backslash joined with what follows; the number is that of the first."""
    s = F.regexp_replace(F.col(line), rf"{chars.RE_BLANK}+\z", "")
    w = W.partitionBy(*scope).orderBy(line_no)
    more = s.rlike(r"(?<!\\)\\\z")
    marked = lines.withColumn("_more", more).withColumn("_line", F.when(more, F.substring(s, F.lit(1), F.char_length(s) - 1)).otherwise(F.col(line)))
    group = F.sum(F.when(F.coalesce(F.lag("_more").over(w), F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    parts = marked.withColumn("_g", group).groupBy(*scope, "_g").agg(F.min(line_no).alias(line_no), F.array_sort(F.collect_list(F.struct(F.col(line_no).alias("n"), F.col("_line").alias("t")))).alias("_p"))
    return parts.select(*scope, line_no, F.array_join(F.transform("_p", lambda p: p["t"]), "").alias(line))


def skipped_lines(lines: DataFrame, scope: list[str], line_no: str = "line_no", line: str = "line") -> DataFrame:
    """scope, line_no of the lines inside skip blocks, their first and last lines included.

    A block ends at its own end marker only, so the state is a fold over the markers of
    a script; other lines are ranged between them.
    """
    s = F.regexp_replace(F.col(line), r"\A[ \t]+", "")
    kind = F.lit(None).cast("string")
    for b in BLOCKS:
        end = "endscript" if b == "iscript" else "endignore"
        kind = F.when(s.rlike(rf"(?i)\A[\[@]{end}"), f"-{b}").when(s.rlike(rf"(?i)\A[\[@]{b}(?![A-Za-z0-9_])"), f"+{b}").otherwise(kind)
    marks = lines.withColumn("_kind", kind).filter("_kind is not null").groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct(F.col(line_no).alias("n"), F.col("_kind").alias("k")))).alias("_m"))
    start = "named_struct('open', '', 'from', 0, 'spans', cast(array() as array<struct<a:int,b:int>>))"
    step = (
        "(s, m) -> case when s.open = '' and substr(m.k, 1, 1) = '+' then named_struct('open', substr(m.k, 2), 'from', m.n, 'spans', s.spans) "
        "when s.open != '' and m.k = concat('-', s.open) then named_struct('open', '', 'from', 0, 'spans', array_append(s.spans, named_struct('a', s.from, 'b', m.n))) else s end"
    )
    done = "s -> if(s.open = '', s.spans, array_append(s.spans, named_struct('a', s.from, 'b', 2147483647)))"
    spans = marks.select(*scope, F.explode(F.expr(f"aggregate(_m, {start}, {step}, {done})")).alias("_s")).select(*scope, F.col("_s.a").alias("_a"), F.col("_s.b").alias("_b"))
    return lines.select(*scope, line_no).join(spans, scope).filter(F.col(line_no).between(F.col("_a"), F.col("_b"))).select(*scope, line_no)


def kag_candidates(lines: DataFrame, scope: list[str], track: bool = True, line_no: str = "line_no", line: str = "line") -> DataFrame:
    """scope, line_no, hint, line: what a KAG script says, tags removed, with the declared speaker as hint."""
    whole = join_continued(lines, scope, line_no, line)
    kept = whole.join(skipped_lines(whole, scope, line_no, line), [*scope, line_no], "left_anti")
    s = F.regexp_replace(F.col(line), r"\A[ \t]+", "")
    kept = kept.withColumn(line, s).withColumn("_set", F.when(F.startswith(s, F.lit("[")), F.nullif(dialogue.declaration(s), F.lit(""))))
    if track:
        kept = carry_forward(kept, "_set", scope, [line_no], "_now")
    else:
        kept = kept.withColumn("_now", F.lit(None).cast("string"))
    spoken = kept.filter(~F.col(line).rlike(r"\A(?:;|//|\*|@)")).withColumn("_body", chars.strip(strip_kag_tags(F.col(line)))).filter(F.col("_body").rlike(chars.RE_KAG_WORD))
    hint = F.when(F.col("_body").rlike(_NAMED), "").otherwise(F.coalesce("_now", F.lit("")))
    return spoken.select(*scope, line_no, hint.alias("hint"), F.col("_body").alias("line"))


def plain_candidates(lines: DataFrame, scope: list[str], line_no: str = "line_no", line: str = "line") -> DataFrame:
    """scope, line_no, hint, line: trimmed lines with a word character."""
    s = chars.strip(F.col(line))
    return lines.withColumn(line, s).filter(s.rlike(chars.RE_KAG_WORD)).select(*scope, line_no, F.lit("").alias("hint"), line)

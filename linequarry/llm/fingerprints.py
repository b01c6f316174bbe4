"""Document fingerprints: a canonical exact digest, made with SQL functions only.

canonical text = NFKC, Unicode case folding, NFKC again, every run of white space
folded to one space, ends trimmed. The fingerprint is 128 bits of xxhash over the
canonical text (two 64-bit passes with different seeds), as 32 hex digits.

Documents are grouped by that digest, and inside a digest that several documents
have, by the bytes of the canonical text; the digest alone never merges two texts.

Defined results: a null text counts as empty; all empty or blank texts share one
fingerprint; repeated rows are separate members of one class; rows without a
doc_id come after all others; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import broadcast_if_small, id_splits, join_counted, range_of, shuffle_parts, spread, staged

#: White space as Unicode lists it (fixed values), written as a Java character class.
_BLANK = r"[\u0009-\u000D\u001C-\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
ID_BROADCAST = 64 << 20
_NFKC = "com.ibm.icu.text.Normalizer"
_FOLD = "com.ibm.icu.lang.UCharacter"


def canonical(text: Column) -> Column:
    """Unicode-normalised, case-folded, white-space-folded form of a text; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    composed = F.reflect(F.lit(_NFKC), F.lit("compose"), whole, F.lit(True))
    folded = F.reflect(F.lit(_FOLD), F.lit("foldCase"), composed, F.lit(True))
    again = F.reflect(F.lit(_NFKC), F.lit("compose"), folded, F.lit(True))
    # ASCII needs neither of the two compositions.
    plain = F.octet_length(whole) == F.char_length(whole)
    form = F.when(plain, F.lower(whole)).otherwise(again)
    return F.trim(F.regexp_replace(form, _BLANK, " "))


def digest(canonical_text: Column) -> Column:
    """128-bit xxhash digest of a canonical text as 32 lowercase hex digits."""
    one = F.xxhash64(canonical_text)
    two = F.xxhash64(F.lit(0x51F15E), canonical_text)
    return F.lower(F.concat(F.lpad(F.hex(one), 16, "0"), F.lpad(F.hex(two), 16, "0")))


def classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", prints: DataFrame | None = None) -> DataFrame:
    """One row per document: id, fingerprint, class_id (smallest id whose canonical text has the same bytes).

    `prints` is a staged table with doc_id and fingerprint of these documents, if there is
    one already; its other columns are passed on.

    Digests travel first. Texts travel only for digests that more than one row has,
    and equal texts are merged before they are shuffled, so a text that a third of
    all rows carry costs one row per task. Such a digest is no key of a shuffle either.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if prints is None:
        prints = staged(docs.select("doc_id", digest(canonical(F.col("text"))).alias("fingerprint")), "digests")
    parts = shuffle_parts(documents.sparkSession)
    shared = staged(prints.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("class_id")), "digest-classes")
    several = staged(shared.filter("n > 1").select("fingerprint", "n"), "shared-digests")
    ids = staged(join_counted(prints.select("doc_id", "fingerprint"), several, ["fingerprint"], "n", parts).select("doc_id").distinct(), "shared-ids")
    # A null id meets no other in a join, so rows without one are all looked at.
    some = docs.join(broadcast_if_small(ids, 16, ID_BROADCAST), "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))
    texts = some.select("doc_id", canonical(F.col("text")).alias("canon")).withColumn("fingerprint", digest(F.col("canon")))
    merged = texts.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("least"))
    apart = merged.groupBy("fingerprint").agg(F.count("*").alias("texts")).filter("texts > 1").select("fingerprint")
    apart = staged(apart, "split-digests")
    out = join_counted(prints, shared, ["fingerprint"], "n", parts).select(*prints.columns, "class_id")
    if apart.isEmpty():
        return out
    split = texts.join(apart, "fingerprint", "left_semi").join(merged, ["fingerprint", "canon"]).groupBy("doc_id", "fingerprint").agg(F.min("least").alias("class_id"))
    same = prints["doc_id"].eqNullSafe(split["doc_id"]) & (prints["fingerprint"] == split["fingerprint"])
    return out.join(apart, "fingerprint", "left_anti").select(*out.columns).unionByName(prints.join(split, same).select(*[prints[c] for c in prints.columns], split["class_id"]))


def with_next(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, fingerprint, and next, next_print of the document that follows in descending id, after the last the first.

    A distributed lead: rows are dealt to id ranges, each range also gets a copy of
    the row that follows its last one, and the window runs per range.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = docs.select("doc_id")
    # Where the text is read, once for each row.
    docs = docs.withColumn("fingerprint", digest(canonical(F.col("text"))))
    spark = documents.sparkSession
    splits = id_splits(ids, "doc_id", shuffle_parts(spark))
    part = range_of(F.col("doc_id"), splits)
    tops = {r["part"]: r["top"] for r in ids.groupBy(part.alias("part")).agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)
    # The greatest id of a range follows the least of the next range up; that of the highest follows the very last.
    above = {p: order[(i + 1) % len(order)] for i, p in enumerate(order)}
    heads = [(p, tops[p], above[p]) for p in order]
    own = F.struct(part.alias("part"), F.lit(0).alias("copy"))
    if heads:
        cases = [(part == p) & (F.col("doc_id").eqNullSafe(F.lit(top).cast("long"))) for p, top, _ in heads]
        also = F.when(cases[0], heads[0][2])
        for c, (_, _, to) in zip(cases[1:], heads[1:], strict=True):
            also = also.when(c, to)
        places = F.when(also.isNull(), F.array(own)).otherwise(F.array(own, F.struct(also.cast("int").alias("part"), F.lit(1).alias("copy"))))
    else:
        places = F.array(own)
    dealt = docs.withColumn("at", F.explode(places)).select("doc_id", "text", "fingerprint", "at.part", "at.copy")
    dealt = dealt.withColumn("part", spread(spark, F.col("part"), shuffle_parts(spark)))
    follow = W.partitionBy("part").orderBy("copy", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    found = dealt.withColumn("next", F.lead("text").over(follow)).withColumn("next_print", F.lead("fingerprint").over(follow))
    return found.filter("copy = 0").select("doc_id", "text", "fingerprint", "next", "next_print")


def edited_pairs(documents: DataFrame) -> DataFrame:
    """Fingerprint of each text, of its edited form and of the next text, and how alike they are.

    The edited form has the last third of the code points (rounded down) replaced by
    as many from the start of the next document, or all it has. Likeness of an exact
    digest is 1 if fingerprint and canonical bytes are equal, else 0.
    """
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    base = with_next(documents).withColumn("n_chars", F.char_length("text").cast("long"))
    base = base.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 3) as int))"), F.when(cut > 0, F.substring(F.col("next"), F.lit(1), cut)).otherwise("")))
    forms = base.withColumn("c1", canonical(F.col("edited"))).withColumn("edited_fingerprint", digest(F.col("c1")))

    def alike(other_print: str, other_text: Column) -> Column:
        # Bytes are compared only where the digests are equal.
        return F.when(F.col("fingerprint") == F.col(other_print), (canonical(F.col("text")) == other_text).cast("double")).otherwise(0.0)

    return forms.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        alike("edited_fingerprint", F.col("c1")).alias("near_edited"),
        alike("next_print", canonical(F.col("next"))).alias("near_next"),
    )

"""Benchmark decontamination with spaced seeds, made with SQL functions only.

A seed mask looks at some of a run of consecutive tokens and ignores the others, so a
copied passage still hits where tokens at ignored places were substituted. Hashes of
the masked tokens of all test items are joined to those of every position of every
document. Around each hit the test item is laid over the document on the hit's
diagonal, and tokens are compared one by one: the document overlaps the item if some
stretch of STRETCH tokens (the whole item if shorter) has at least SHARE equal ones.

Nothing that this rule asks for is missed: a stretch of 10 to 13 tokens may have two
unequal ones, and wherever two lie among ten tokens, one of the three masks fits between
them (an unequal token may also be one beyond the document's ends). Items of fewer than
SEEDED tokens must be met whole: their seed is the run of all their tokens.

Tokens are maximal runs of letters and digits, lower-cased.

Scale: documents are scanned where they lie; the hashes of the test items are broadcast in
blocks of about BLOCK_ROWS rows, dealt so that one common seed is spread over all blocks.
Only hits are shuffled. Tokens under a hit come from blocks of TOKENS tokens, so neither a
long text nor one with a hit at every place gathers in one row.

Defined results: null and empty texts have no tokens and overlap with nothing; items of
fewer than `shortest` tokens are no leaks and are ignored; rows that repeat an id, and
items that repeat one, are each judged and reported under their id, also the null one;
an empty table on either side gives no rows; ties do not arise, as every overlap counts.
Very long texts are judged whole. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import broadcast_if_small, staged

#: Places that count (1) and places that are ignored (0); fixed values.
MASKS = ("111011", "1101011", "1110011")
STRETCH, SHARE = 13, 0.8
#: Tokens from which an item is met by masks; shorter ones are met whole, down to SHORTEST tokens.
SEEDED, SHORTEST = 10, 5
#: Rows of item hashes in one broadcast: about 32 MB.
BLOCK_ROWS = 1_000_000
#: Tokens in one row of a text under hits.
TOKENS = 256
#: Bytes of items in one broadcast.
ITEM_BYTES = 16 << 20


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of a text, as an array."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1)
    return F.filter(parts, lambda w: w != "")


def _seeds(words: str, masks: tuple[str, ...]) -> Column:
    """Array of arrays: for each mask the hashes at positions 0, 1, ... of a token array column."""
    hashes = []
    for mask in masks:
        at = [j for j, c in enumerate(mask) if c == "1"]
        picked = ", ".join(f"h[i + {j}]" if j else "h[i]" for j in at)
        # The mask's own number keeps masks apart.
        hashes.append(f"case when size(h) >= {len(mask)} then transform(sequence(0, size(h) - {len(mask)}), i -> xxhash64({int(mask, 2)}, {picked})) end")
    return F.expr(f"transform(array(transform({words}, w -> xxhash64(w))), h -> array({', '.join(hashes)}))[0]")


def _positions(df: DataFrame, masks: tuple[str, ...], *keep: str) -> DataFrame:
    """The kept columns, position and hash for every position and mask of a table with words."""
    seeds = df.select(*keep, F.explode(_seeds("words", masks)).alias("of_mask"))
    return seeds.select(*keep, F.posexplode("of_mask").alias("position", "hash"))


def _blocks(df: DataFrame, n: int, *by: str) -> list[DataFrame]:
    """A table in n parts of about equal size."""
    return [df.filter(F.pmod(F.xxhash64(*by), F.lit(n)) == b) for b in range(n)] if n > 1 else [df]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overlaps(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    masks: tuple[str, ...] = MASKS,
    stretch: int = STRETCH,
    share: float = SHARE,
    shortest: int = SHORTEST,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per document, item and alignment that overlap.

    doc_id, item_id, start and stop (token positions in the document of the first and
    after the last equal token), n_equal (equal tokens of the whole item), n_item
    (tokens of the item).
    """
    # k1, k2 tell rows apart, whether or not ids repeat.
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col("text").alias("text")).filter("text is not null")
    docs = docs.withColumn("k1", F.xxhash64(F.col("id").isNull(), "id", "text")).withColumn("k2", F.xxhash64(F.lit(5), "text", "id"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), tokens(F.col("text")).alias("item")).withColumn("n_item", F.size("item")).filter(F.col("n_item") >= shortest)
    items = staged(items.withColumn("row", F.monotonically_increasing_id()), "items")
    # At most SEEDED lengths, whatever the size of the test set.
    lengths = sorted(r["n_item"] for r in items.filter(F.col("n_item") < SEEDED).select("n_item").distinct().collect())
    seeded = _positions(items.filter(F.col("n_item") >= SEEDED).withColumnRenamed("item", "words"), masks, "row", "n_item")
    whole = [_positions(items.filter(F.col("n_item") == n).withColumnRenamed("item", "words"), ("1" * n,), "row", "n_item") for n in lengths]
    wanted = _union([seeded, *whole])
    wanted = staged(wanted.withColumnRenamed("position", "item_position"), "item-seeds")
    blocks = max(1, math.ceil(wanted.count() / block_rows))
    # A mask without a hole is the seed of the short items of its length.
    every = tuple(dict.fromkeys((*masks, *("1" * n for n in lengths))))
    places = _positions(docs.select("id", "k1", "k2", tokens(F.col("text")).alias("words")), every, "id", "k1", "k2")
    hits = [
        places.join(F.broadcast(block), "hash").select("id", "k1", "k2", "row", (F.col("position") - F.col("item_position")).alias("diagonal"), "n_item")
        for block in _blocks(wanted, blocks, "hash", "row", "item_position")
    ]
    found = staged(_union(hits).distinct(), "hits")

    # The tokens under a hit, gathered from the blocks of the text that it touches.
    texts = docs.join(broadcast_if_small(found.select("k1", "k2").distinct(), 32), ["k1", "k2"], "left_semi").select("k1", "k2", tokens(F.col("text")).alias("words"))
    pieces = F.expr(f"transform(sequence(0, (size(words) - 1) div {TOKENS}), b -> struct(cast(b as int) as b, slice(words, cast(b * {TOKENS} + 1 as int), {TOKENS}) as part))")
    pieces = texts.filter(F.size("words") > 0).select("k1", "k2", F.explode(pieces).alias("p")).select("k1", "k2", "p.b", "p.part").dropDuplicates(["k1", "k2", "b"])
    low, high = F.greatest(F.col("diagonal"), F.lit(0)), F.col("diagonal") + F.col("n_item") - 1
    touched = found.withColumn("b", F.explode(F.sequence(F.floor(low / TOKENS).cast("int"), F.floor(high / TOKENS).cast("int"))))
    under = F.expr(f"slice(part, greatest(diagonal - b * {TOKENS}, 0) + 1, least(diagonal + n_item, (b + 1) * {TOKENS}) - greatest(diagonal, b * {TOKENS}))")
    laid = touched.join(pieces, ["k1", "k2", "b"]).groupBy("id", "k1", "k2", "row", "diagonal").agg(F.array_sort(F.collect_list(F.struct("b", under.alias("part")))).alias("parts"))
    laid = staged(laid.select(F.col("id").alias("doc_id"), "row", "diagonal", F.greatest(-F.col("diagonal"), F.lit(0)).alias("skip"), F.flatten(F.transform("parts", lambda p: p["part"])).alias("part")), "laid")
    size = items.agg(F.coalesce(F.sum(F.expr("aggregate(item, 64, (a, w) -> a + 24 + octet_length(w))")), F.lit(0))).first()[0]
    laid = _union([laid.join(F.broadcast(block.select("row", "item_id", "item")), "row") for block in _blocks(items, max(1, math.ceil(size / ITEM_BYTES)), "row")])
    laid = laid.withColumn("equal", F.expr("transform(sequence(0, size(item) - 1), j -> case when j >= skip and j - skip < size(part) and get(part, j - skip) = item[j] then 1 else 0 end)"))
    laid = laid.withColumn("width", F.least(F.size("item"), F.lit(stretch)))
    best = "array_max(transform(sequence(1, size(equal) - width + 1), s -> aggregate(slice(equal, s, width), 0, (a, x) -> a + x)))"
    need = F.when(F.size("item") < SEEDED, F.size("item")).otherwise(F.ceil(F.col("width") * F.lit(share) - 1e-9))
    kept = laid.withColumn("best", F.expr(best)).filter(F.col("best") >= need)
    return kept.select(
        "doc_id",
        "item_id",
        (F.array_position("equal", F.lit(1)) - 1 + F.col("diagonal")).cast("long").alias("start"),
        (F.size("equal") - F.array_position(F.reverse("equal"), F.lit(1)) + 1 + F.col("diagonal")).cast("long").alias("stop"),
        F.expr("aggregate(equal, 0, (a, x) -> a + x)").cast("long").alias("n_equal"),
        F.size("item").cast("long").alias("n_item"),
    ).distinct()


def contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document that overlaps some item: doc_id, item_ids, n_items, most_equal."""
    rows = overlaps(documents, benchmark, **options)
    return rows.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
        F.count_distinct("item_id").alias("n_items"),
        F.max(F.col("n_equal") / F.col("n_item")).alias("most_equal"),
    )

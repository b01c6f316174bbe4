"""Quality classifier: interpolated modified Kneser-Ney model of byte n-grams, one per language.

The model is trained on trusted text (labelled good), all of it but a fold that is held
out to place the thresholds. Counts are made per task, summed by Spark, and turned into
two numbers per k-gram by joins and aggregations over the sharded count tables: alpha,
its discounted relative count (raw counts in the highest order, counts of distinct left
neighbours below), and gamma, the mass that it leaves to the shorter context.

Scoring. Documents are gathered into blocks of one language. A block asks for its
distinct k-grams only, so the join with the count tables carries a small fraction of
the text; the answers meet the (compressed) block again, and the probabilities of all
its bytes follow by table lookups.

A document's score is its mean number of bits per byte, drawn to the language's mean
by SHRINK bytes, so that a few unusual words do not condemn a short text. Rejected is
what lies above the HIGH quantile of the held-out trusted documents of its language,
widened by SLACK of its distance to the median.

Defined results: null and empty texts have score null and are kept; documents without
language, or of a language with fewer than LEAST trusted documents, are scored by a
model of all trusted text; with no trusted text at all everything is kept; rows that
repeat an id are scored each; an empty table gives an empty result. Texts of more than
BLOCK_BYTES are counted and scored in parts that see the bytes before them, so nothing
of them is lost and memory stays bounded. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .runtime import broadcast_if_small, ship, staged

ORDER = 4
BLOCK_BYTES = 4 << 20
FOLDS, HELD_OUT = 5, 0
HIGH, SLACK, SHRINK = 0.995, 0.25, 200
#: Trusted documents that a language needs for a model of its own.
LEAST = 20
#: The model of all languages.
POOLED = 0
ID_BROADCAST = 64 << 20
_PAD = 0x0A


def gram_key(keys: np.ndarray, size: int, lang: int) -> np.ndarray:
    """Language, size and bytes of k-grams in one integer (at most five bytes)."""
    return (keys | np.int64(size) << np.int64(40) | np.int64(lang) << np.int64(43)).astype(np.int64)


class Block:
    """The k-grams (k up to `order`) that end at each byte of some texts.

    keys[k]: distinct k-grams as big-endian integers, rising; head[k], tail[k]: index of
    a k-gram's first and last k - 1 bytes; ids: index of the longest gram that ends at
    each place. Texts have order - 1 line feeds before them.
    """

    def __init__(self, texts: list[bytes], order: int, heads: list[int] | None = None):
        """`heads`: leading bytes of each text that are context only, because it is a part of a longer one."""
        gap = bytes([_PAD]) * (order - 1)
        data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        known = np.array(heads, np.int64) if heads is not None else np.zeros(len(texts), np.int64)
        # Index into ids of each text's first byte that counts.
        self.begin = np.cumsum(sizes + order - 1) - sizes - (order - 1) + known
        self.sizes = sizes - known
        self.order = order
        used = np.flatnonzero(np.bincount(data, minlength=256))
        code = np.zeros(256, np.int32)
        code[used] = np.arange(len(used), dtype=np.int32)
        c, n_codes = code[data], len(used)
        del data
        self.keys, self.head, ids = [np.zeros(1, np.int64), used.astype(np.int64)], [None, np.zeros(n_codes, np.int64)], c
        for k in range(2, order + 1):
            pair = ids[:-1] * np.int32(n_codes)
            pair += c[k - 1 :]
            seen = np.zeros(len(self.keys[k - 1]) * n_codes, dtype=bool)
            seen[pair] = True
            distinct = np.flatnonzero(seen)
            rank = np.cumsum(seen, dtype=np.int32)
            rank -= 1
            ids = rank[pair]
            self.head.append(distinct // n_codes)
            self.keys.append(self.keys[k - 1][distinct // n_codes] << 8 | used[distinct % n_codes])
        self.ids = ids
        self.tail = [None, np.zeros(n_codes, np.int64)] + [np.searchsorted(self.keys[k - 1], self.keys[k] & ((1 << 8 * (k - 1)) - 1)) for k in range(2, order + 1)]

    def counts(self) -> np.ndarray:
        """How often each of keys[order] ends at a byte of a text."""
        spans = [self.ids[b : b + n] for b, n in zip(self.begin.tolist(), self.sizes.tolist(), strict=True)]
        return np.bincount(np.concatenate([self.ids[:0], *spans]), minlength=len(self.keys[self.order]))

    def bits(self, alpha: list[np.ndarray], gamma: list[np.ndarray]) -> np.ndarray:
        """Bits of each text under a model; alpha and gamma are aligned with keys."""
        p = np.full(1, 1 / 256)
        for k in range(1, self.order + 1):
            p = alpha[k] + gamma[k - 1][self.head[k]] * p[self.tail[k]]
        cost = -np.log2(np.maximum(p, 1e-30))
        return np.array([cost[self.ids[b : b + n]].sum() for b, n in zip(self.begin.tolist(), self.sizes.tolist(), strict=True)])


@dataclass
class _Held:
    """Documents of one language that wait for a block: ids, texts, context bytes, and of which whole text they are parts."""

    ids: list = field(default_factory=list)
    texts: list[bytes] = field(default_factory=list)
    heads: list[int] = field(default_factory=list)
    part: tuple[int, int] | None = None

    def block(self, order: int) -> Block:
        return Block(self.texts, order, self.heads)


def _parts(doc_id, text: bytes, size: int, order: int) -> Iterator[_Held]:
    """A long text in parts, each after the bytes that its first grams need."""
    key = int(np.uint64(xxhash.xxh3_64_intdigest(text, seed=hash(doc_id) & 0xFFFFFFFF)).view(np.int64))
    n = -(-len(text) // size)
    for k in range(n):
        head = min(k * size, order - 1)
        yield _Held([doc_id], [text[k * size - head : (k + 1) * size]], [head], (key, n))


def _blocks(batches: Iterator[pa.RecordBatch], size: int, order: int) -> Iterator[tuple[int, _Held]]:
    """Language id and documents of about `size` bytes, gathered over batches; a longer text comes in parts of its own."""
    held: dict[int, _Held] = {}
    used: dict[int, int] = {}
    for b in batches:
        data, offsets = tk.string_buffers(b.column("text"))
        places = offsets.tolist()
        for lang, doc_id, x, y in zip(b.column("lang_id").to_pylist(), b.column("doc_id").to_pylist(), places[:-1], places[1:], strict=True):
            if y - x > size:
                for part in _parts(doc_id, data[x:y].tobytes(), size, order):
                    yield lang, part
                continue
            mine = held.setdefault(lang, _Held())
            mine.ids.append(doc_id)
            mine.texts.append(data[x:y].tobytes())
            mine.heads.append(0)
            used[lang] = used.get(lang, 0) + y - x
            # However many languages there are, what waits stays bounded.
            if used[lang] >= size or sum(used.values()) >= 2 * size:
                most = max(used, key=lambda k: used[k])
                yield most, held.pop(most)
                used.pop(most)
    for lang in sorted(held):
        yield lang, held[lang]


def _name(lang: int, ids: list, texts: list[bytes]) -> int:
    h = xxhash.xxh3_64(f"{lang} {ids}")
    for t in texts:
        h.update(t)
    return int(np.uint64(h.intdigest()).view(np.int64))


def _counting(order: int, size: int, pooled: bool):
    @tk.worker_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, held in _blocks(batches, size, order):
            block = held.block(order)
            n = block.counts()
            some = np.flatnonzero(n)
            for at in {lang, POOLED} if pooled else {lang}:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), at, np.int32)), pa.array(block.keys[order][some]), pa.array(n[some].astype(np.int64))], names=["lang_id", "key", "n"])

    return run


def _asking(order: int, size: int):
    @tk.worker_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, held in _blocks(batches, size, order):
            block = held.block(order)
            keys = np.concatenate([gram_key(block.keys[k], k, lang) for k in range(order + 1)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), _name(lang, held.ids, held.texts))), pa.array(keys)], names=["block", "gram"])

    return run


def _packing(size: int, order: int):
    @tk.worker_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, held in _blocks(batches, size, order):
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(held.texts))
            key, n = held.part or (None, None)
            lists = [pa.array([x], pa.list_(t)) for x, t in ((held.ids, pa.int64()), (list(map(len, held.texts)), pa.int32()), (held.heads, pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_name(lang, held.ids, held.texts)]), pa.array([lang], pa.int32()), *lists, pa.array([blob], pa.binary()), pa.array([key], pa.int64()), pa.array([n], pa.int32())],
                names=["block", "lang_id", "ids", "sizes", "heads", "blob", "part_of", "n_parts"],
            )

    return run


def _scoring(order: int):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_id", pa.int32()), ("n_bytes", pa.int64()), ("bits", pa.float64()), ("part_of", pa.int64()), ("n_parts", pa.int32())])

    def run(packed: pa.Table, answers: pa.Table) -> pa.Table:
        if not packed.num_rows:
            # Blocks are named by their content, so this means that the input changed meanwhile.
            raise RuntimeError("answers without their block: the documents differ between two reads")
        gram = answers.column("gram").to_numpy()
        rank = np.argsort(gram)
        gram, values = gram[rank], [answers.column(c).to_numpy()[rank] for c in ("alpha", "gamma")]
        out = []
        # Repeated rows can make several equal blocks.
        for row in packed.to_pylist():
            joined, texts, at = zstandard.ZstdDecompressor().decompress(row["blob"]) if sum(row["sizes"]) else b"", [], 0
            for n in row["sizes"]:
                texts.append(joined[at : at + n])
                at += n
            block = Block(texts, order, row["heads"])
            tables: list[list[np.ndarray]] = [[], []]
            for k in range(order + 1):
                want = gram_key(block.keys[k], k, row["lang_id"])
                place = np.minimum(np.searchsorted(gram, want), max(0, len(gram) - 1))
                hit = gram[place] == want if len(gram) else np.zeros(len(want), bool)
                # Unseen k-grams have no count; unseen contexts leave everything to the shorter one.
                for t, v, other in zip(tables, values, (0.0, 1.0), strict=True):
                    t.append(np.where(hit, v[place], other) if len(gram) else np.full(len(want), other))
            out.append(pa.table([pa.array(row["ids"], pa.int64()), pa.array(np.full(len(texts), row["lang_id"], np.int32)), pa.array(block.sizes), pa.array(block.bits(*tables)), pa.array([row["part_of"]] * len(texts), pa.int64()), pa.array([row["n_parts"]] * len(texts), pa.int32())], schema=schema))
        return pa.concat_tables(out)

    return run


def _discounts(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts per language from the counts of counts."""
    of = lambda k: F.count_if(F.col("n") == k).cast("double")
    n = counts.groupBy("lang_id").agg(*[of(k).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.coalesce(F.try_divide("n1", F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    inside = lambda d, k: F.greatest(F.lit(0.05 * k), F.least(F.lit(k - 0.05), d))
    return n.select(
        "lang_id",
        inside(1 - 2 * y * ratio("n2", "n1"), 1).alias("d1"),
        inside(2 - 3 * y * ratio("n3", "n2"), 2).alias("d2"),
        inside(3 - 4 * y * ratio("n4", "n3"), 3).alias("d3"),
    )


def kneser_ney(counts: DataFrame, order: int) -> DataFrame:
    """gram, alpha, gamma for all k-grams of a table (lang_id, key, n) of `order`-gram counts."""
    parts, table = [], counts
    packed = lambda size, key: key.bitwiseOR(F.lit(size << 40)).bitwiseOR(F.shiftleft(F.col("lang_id").cast("long"), 43))
    for k in range(order, 0, -1):
        with_head = table.withColumn("head", F.shiftright("key", 8))
        d = _discounts(table)
        # One row per language: bounded by the number of languages, which is counted on the driver.
        with_head = with_head.join(F.broadcast(d), "lang_id")
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        with_head = with_head.withColumn("cut", cut)
        heads = with_head.groupBy("lang_id", "head").agg(F.sum("n").alias("total"), F.sum("cut").alias("left"))
        grams = with_head.join(heads.select("lang_id", "head", "total"), ["lang_id", "head"])
        alpha = (F.col("n") - F.col("cut")) / F.col("total")
        parts.append(grams.select(packed(k, F.col("key")).alias("gram"), alpha.alias("alpha"), F.lit(None).cast("double").alias("gamma")))
        parts.append(heads.select(packed(k - 1, F.col("head")).alias("gram"), F.lit(None).cast("double").alias("alpha"), (F.col("left") / F.col("total")).alias("gamma")))
        if k > 1:
            table = staged(table.groupBy("lang_id", F.col("key").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)).alias("key")).agg(F.count("*").alias("n")), "counts")
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    merged = both.groupBy("gram").agg(F.max("alpha").alias("alpha"), F.max("gamma").alias("gamma"))
    return merged.select("gram", F.coalesce("alpha", F.lit(0.0)).alias("alpha"), F.coalesce("gamma", F.lit(1.0)).alias("gamma"))


def _whole(scored: DataFrame) -> DataFrame:
    """One row a document: the parts of long texts summed, equal rows kept apart by their number."""
    parts = scored.filter("part_of is not null").groupBy("doc_id", "lang_id", "part_of", "n_parts").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("bits").alias("bits"), F.count("*").alias("rows"))
    times = F.expr("cast(rows div n_parts as int)")
    sums = parts.withColumn("times", times).withColumn("one", F.explode(F.sequence(F.lit(1), F.col("times"))))
    sums = sums.select("doc_id", "lang_id", F.expr("n_bytes div times").alias("n_bytes"), (F.col("bits") / F.col("times")).alias("bits"))
    return scored.filter("part_of is null").select("doc_id", "lang_id", "n_bytes", "bits").unionByName(sums)


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def judge(documents: DataFrame, trusted: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", high: float = HIGH) -> DataFrame:
    """doc_id, lang_id, n_bytes, bits_per_byte, perplexity, smoothed, most, keep of every row.

    `trusted` has the ids (doc_id) of documents known to be good. perplexity is per
    byte; most is the bound of the smoothed bits per byte.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    good = staged(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct(), "trusted")
    good_docs = docs.join(broadcast_if_small(good, 16, ID_BROADCAST), "doc_id", "left_semi")
    taught = fold_of(F.col("doc_id")) != HELD_OUT
    # A dimension of one row per language.
    n_taught = {r["lang"]: r["n"] for r in good_docs.filter(taught & F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(k for k, n in n_taught.items() if n >= LEAST)
    ids = {name: i + 1 for i, name in enumerate(names)}
    lang_id = F.lit(POOLED)
    if ids:
        lang_id = F.coalesce(F.create_map(*[x for k, v in ids.items() for x in (F.lit(k), F.lit(v))])[F.col("lang")], lang_id)
    pooled = len(names) == 0 or not docs.filter(F.col("lang").isNull() | ~F.col("lang").isin(names)).isEmpty()
    known = docs.withColumn("lang_id", lang_id.cast("int")).select("doc_id", "text", "lang_id")
    lessons = good_docs.filter(taught).withColumn("lang_id", lang_id.cast("int")).select("doc_id", "text", "lang_id")
    counts = lessons.mapInArrow(_counting(order, BLOCK_BYTES, pooled), "lang_id int, key long, n long").groupBy("lang_id", "key").agg(F.sum("n").alias("n"))
    model = kneser_ney(staged(counts, "counts"), order)

    asked = known.mapInArrow(_asking(order, BLOCK_BYTES), "block long, gram long")
    answers = asked.join(model, "gram").select("block", "gram", "alpha", "gamma")
    blocks = known.mapInArrow(_packing(BLOCK_BYTES, order), "block long, lang_id int, ids array<long>, sizes array<int>, heads array<int>, blob binary, part_of long, n_parts int")
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scoring(order), "doc_id long, lang_id int, n_bytes long, bits double, part_of long, n_parts int")
    scored = _whole(staged(scored, "bits"))

    held = scored.join(broadcast_if_small(good, 16, ID_BROADCAST), "doc_id", "left_semi").filter((fold_of(F.col("doc_id")) == HELD_OUT) & (F.col("n_bytes") > 0))
    mean = held.groupBy("lang_id").agg((F.sum("bits") / F.sum("n_bytes")).alias("mean"))
    smooth = (F.col("bits") + SHRINK * F.col("mean")) / (F.col("n_bytes") + SHRINK)
    marks = held.join(F.broadcast(mean), "lang_id").groupBy("lang_id").agg(F.percentile_approx(smooth, [0.5, high], 10_000).alias("q"), F.first("mean").alias("mean"))
    wide = F.col("q")[1] + SLACK * (F.col("q")[1] - F.col("q")[0])
    marks = staged(marks.select("lang_id", "mean", wide.alias("most")), "marks")
    out = scored.join(F.broadcast(marks), "lang_id", "left")
    rate = F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes"))
    keep = F.coalesce((F.col("n_bytes") == 0) | (smooth <= F.col("most")), F.lit(True))
    return out.select("doc_id", "lang_id", "n_bytes", rate.alias("bits_per_byte"), F.pow(F.lit(2.0), rate).alias("perplexity"), smooth.alias("smoothed"), "most", keep.alias("keep"))

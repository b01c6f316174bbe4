"""Near-duplicate documents: MinHash bands for candidates, odd sketches and full sets to verify them.

A document is the set of its distinct word shingles (A-Z lower-cased; a shingle is known by
64 bits mixed from the xxh3 hashes of its words). Two documents are linked if
100 * |intersection| >= percent * |union|.

1. Documents with equal sets are one class; sets are equal if 128 bits of SHA-256 over the
   whole sorted set are. A class is a node of its own, named by a number, not by an id.
2. Representatives get BANDS * ROWS MinHash values. Those with an equal band are
   candidates; a pair at the limit of 80 % misses all bands with probability 1e-7.
3. Candidates that hang together form a group, cut into blocks of BLOCK documents. A
   task gets one block, or two. Inside, the pairs with a common band are compared by
   odd sketches: the MinHash samples are folded into a bitmap by flipping one bit each,
   so the XOR of two bitmaps has at most two bits for each sample that differs; pairs
   beyond MARGIN standard deviations are passed over. The rest is verified on full
   sets, most alike first, skipping pairs that are connected already.
4. The first round compares each block with itself and with the first block of its
   group; the second only blocks that share a band and still hold different
   components, so a group of thousands of copies costs a linear number of
   comparisons, and no table of all its pairs is ever made.

Defined results: null and empty texts have an empty set and are linked with nothing;
texts with fewer words than a shingle are one shingle; rows without an id are counted
but not linked (component null, kept true); rows that repeat an id are one document with
several texts: what one text links to, all reach, and each row has its own n_shingles; an
empty table gives an empty result. Very long texts are taken in spans, their sets whole.
Other columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .graph import components
from .runtime import broadcast_if_small, discard, join_counted, ship, shuffle_parts, staged

BANDS, ROWS = 40, 5
SKETCH_WORDS = 16
MARGIN = 6.0
BLOCK = 256

_SAMPLES = BANDS * ROWS


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    base = tk.mix(np.arange(1, 2 * _SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return base[:_SAMPLES] | np.uint64(1), base[_SAMPLES:]


def _long_set(data: np.ndarray, begin: int, end: int, words: int) -> np.ndarray:
    """The set of one long text, gathered over its spans."""
    found, tail = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    held: list[np.ndarray] = []
    for a, z in tk.spans(data, begin, end):
        tail = np.concatenate([tail, tk.Words(data, np.array([a, z]), 0, 1, lower=True).hashes()])
        if len(tail) >= words:
            held.append(np.unique(tk.gram_hashes(tail, words) ^ np.uint64(words)))
            tail = tail[len(tail) - words + 1 :]
        if sum(map(len, held)) > max(1 << 20, len(found)):
            found, held = np.unique(np.concatenate([found, *held])), []
    found = np.unique(np.concatenate([found, *held]))
    if not len(found) and len(tail):
        return tk.gram_hashes(tail, len(tail)) ^ np.uint64(len(tail))
    return found


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row from there on), in bounded chunks."""
    data, offsets = tk.string_buffers(column)
    for lo, hi in tk.row_chunks(offsets):
        if tk.is_long(offsets, lo, hi):
            yield lo, [_long_set(data, int(offsets[lo]), int(offsets[hi]), words)]
            continue
        w = tk.Words(data, offsets, lo, hi, lower=True)
        h = w.hashes()
        g = tk.gram_hashes(h, words) ^ np.uint64(words)
        sets = []
        for a, b in zip(w.first[:-1], w.first[1:], strict=True):
            if b - a >= words:
                sets.append(np.unique(g[a : b - words + 1]))
            elif b > a:
                sets.append(tk.gram_hashes(h[a:b], int(b - a)) ^ np.uint64(b - a))
            else:
                sets.append(h[:0])
        yield lo, sets


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of SHA-256 over a sorted set, as two signed integers."""
    one, two = np.frombuffer(hashlib.sha256(shingles.tobytes()).digest(), np.int64, 2)
    return int(one), int(two)


def minhash(shingles: np.ndarray, step: int = 40) -> np.ndarray:
    """BANDS * ROWS MinHash values of a non-empty set."""
    mult, add = _coefficients()
    out = np.empty(_SAMPLES, dtype=np.uint64)
    for part in range(0, len(shingles), 1 << 15):
        piece = shingles[part : part + (1 << 15), None]
        for k in range(0, _SAMPLES, step):
            least = (piece * mult[k : k + step] + add[k : k + step]).min(axis=0)
            out[k : k + step] = least if part == 0 else np.minimum(out[k : k + step], least)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.zeros(BANDS, dtype=np.uint64)
    rows = samples.reshape(BANDS, ROWS)
    for r in range(ROWS):
        keys = tk.mix(keys + rows[:, r])
    return tk.mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples: each flips one of 64 * SKETCH_WORDS bits."""
    bits = tk.mix(samples + np.arange(_SAMPLES, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(64 * SKETCH_WORDS)
    odd = np.bincount(bits.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def most_bits(percent: int) -> int:
    """XOR bits that a linked pair exceeds with a probability of about 1e-9 only."""
    s = percent / 100
    return math.ceil(2 * (_SAMPLES * (1 - s) + MARGIN * math.sqrt(_SAMPLES * s * (1 - s))))


def _signatures(words: int):
    @tk.worker_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, sets in shingle_sets(b.column("text"), words):
                n = [len(s) for s in sets]
                one, two = zip(*map(set_digest, sets), strict=True)
                keys = [band_keys(minhash(s)) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, len(sets)), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "d1", "d2", "keys"],
                )

    return run


def _full_sets(words: int):
    @tk.worker_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, sets in shingle_sets(b.column("text"), words):
                samples = [minhash(s) if len(s) else np.zeros(_SAMPLES, np.uint64) for s in sets]
                one, two = zip(*map(set_digest, sets), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, len(sets)), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([band_keys(s).tobytes() for s in samples], pa.binary()), pa.array([odd_sketch(s).tobytes() for s in samples], pa.binary())],
                    names=["doc_id", "d1", "d2", "shingles", "bands", "sketch"],
                )

    return run


def linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(two) - both)


def verified_links(roots: list[int], sets: list[np.ndarray], bands: np.ndarray, sketches: np.ndarray, percent: int, limit: int) -> list[tuple[int, int]]:
    """Links that join the components of some nodes, verified on their full sets.

    What hangs together by them is given as a star: each root that was met with the least one.
    """
    size = np.array([len(s) for s in sets])
    near = np.zeros((len(roots), len(roots)), dtype=bool)
    for k in range(bands.shape[1]):
        near |= bands[:, k, None] == bands[None, :, k]
    near &= 100 * np.minimum(size[:, None], size) >= percent * np.maximum(size[:, None], size)
    one, two = np.nonzero(np.triu(near, 1))
    bits = np.bitwise_count(sketches[one] ^ sketches[two]).sum(axis=1)
    keep = bits <= limit
    one, two, bits = one[keep], two[keep], bits[keep]
    order = np.argsort(bits, kind="stable")
    of = {r: r for r in roots}

    def root(x: int) -> int:
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    for i, j in zip(one[order].tolist(), two[order].tolist(), strict=True):
        a, b = root(roots[i]), root(roots[j])
        if a != b and linked(sets[i], sets[j], percent):
            of[max(a, b)] = min(a, b)
    return [(root(r), r) for r in of if root(r) != r]


def _verify(percent: int):
    limit = most_bits(percent)

    def run(table: pa.Table) -> pa.Table:
        grp = table.column("grp").to_numpy()
        order = np.argsort(grp, kind="stable")
        cuts = np.flatnonzero(np.diff(grp[order])) + 1
        found: list[tuple[int, int]] = []
        root = table.column("root").to_numpy()
        shingles, bands, sketch = (table.column(c).combine_chunks() for c in ("shingles", "bands", "sketch"))
        for rows in np.split(order, cuts):
            if len(rows) > 1:
                found += verified_links(
                    root[rows].tolist(),
                    [np.frombuffer(shingles[int(i)].as_py(), np.uint64) for i in rows],
                    np.stack([np.frombuffer(bands[int(i)].as_py(), np.int64) for i in rows]),
                    np.stack([np.frombuffer(sketch[int(i)].as_py(), np.uint64) for i in rows]),
                    percent,
                    limit,
                )
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


_TASK = ["task", "grp", "root", "shingles", "bands", "sketch"]


def _links(tasks: DataFrame, percent: int) -> DataFrame:
    return tasks.select(*_TASK).groupBy("task").applyInArrow(_verify(percent), "a long, b long")


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (it is that id)."""
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = staged(docs.mapInArrow(_signatures(words), "doc_id long, n long, d1 long, d2 long, keys array<long>"), "signatures")
    parts = shuffle_parts(spark)
    same = signed.filter("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min(F.struct("doc_id", "keys")).alias("m"))
    # Numbers are given while the table is written, so every later read sees the same ones.
    same = staged(same.select("n", "d1", "d2", F.col("m.doc_id").alias("doc_id"), F.col("m.keys").alias("keys")).withColumn("node", F.monotonically_increasing_id()), "classes")
    # An id with several texts ties their classes together.
    several = staged(signed.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.expr("min(d1) < max(d1) or min(d2) < max(d2)").alias("apart")).filter("rows > 1"), "repeated-ids")
    repeated, apart = several.agg(F.count("*"), F.count_if("apart")).first()

    banded = staged(same.select("node", F.explode("keys").alias("key")), "banded")
    shared = staged(banded.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("size")).filter("size > 1"), "hubs")
    members = staged(join_counted(banded, shared, ["key"], "size", parts), "bands")
    discard(banded, shared)
    groups = staged(components(members.select(F.col("hub").alias("a"), F.col("node").alias("b"))), "groups")

    # Blocks: the order in a group follows the smallest hub, so that blocks share few bands.
    sizes = staged(groups.groupBy("component").agg(F.count("*").alias("size")).withColumn("rows", F.col("size")), "sizes")
    places = join_counted(groups, sizes, ["component"], "rows", parts).select("node", F.col("component").alias("grp"), "size")
    near = members.groupBy("node").agg(F.min("hub").alias("hub"))
    places = places.join(near, "node")
    wide = places.filter(F.col("size") > BLOCK)
    spots = wide.withColumn("block", F.pmod(F.xxhash64("hub", F.pmod(F.xxhash64("node"), F.greatest(F.lit(64), F.ceil(F.col("size") / BLOCK)))), F.ceil(F.col("size") / BLOCK)).cast("int"))
    placed = places.filter(F.col("size") <= BLOCK).withColumn("block", F.lit(0)).unionByName(spots)
    placed = staged(placed.select("node", "grp", "size", "block").join(same.select("node", "doc_id", "d1", "d2"), "node"), "blocks")
    wanted = broadcast_if_small(placed.select("doc_id").distinct(), 16)
    sets = docs.join(wanted, "doc_id", "left_semi").mapInArrow(_full_sets(words), "doc_id long, d1 long, d2 long, shingles binary, bands binary, sketch binary")
    # The digests pick the right one of the texts of an id.
    sets = sets.join(placed, ["doc_id", "d1", "d2"]).select("node", "grp", "size", "block", "shingles", "bands", "sketch")
    if repeated:
        sets = sets.groupBy("node").agg(*[F.first(c).alias(c) for c in ("grp", "size", "block", "shingles", "bands", "sketch")])
    full = staged(sets, "sets")

    bins = max(1, placed.count() // (BLOCK // 2))
    small = full.filter(F.col("size") <= BLOCK).withColumn("task", F.concat(F.lit("s"), F.pmod(F.xxhash64("grp"), F.lit(bins))))
    large = full.filter(F.col("size") > BLOCK)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    # Each block alone; the first block also with every other one.
    to = F.when(F.col("block") == 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("block"))
    large = large.withColumn("other", F.explode(to)).withColumn("task", F.concat_ws("-", F.lit("l"), "grp", "other"))
    first = staged(_links(small.unionByName(large.drop("other")).withColumn("root", F.col("node")), percent), "links")
    linked_to = staged(components(first), "components")

    again = _second_round(placed, members, full, linked_to, percent)
    # Links between components of the first round, by their roots.
    more = again
    if apart:
        ids = signed.join(several.filter("apart").select("doc_id"), "doc_id").join(same.select("n", "d1", "d2", "node"), ["n", "d1", "d2"]).select("doc_id", "node").distinct()
        low = ids.groupBy("doc_id").agg(F.min("node").alias("a"))
        tied = ids.join(low, "doc_id").select("a", F.col("node").alias("b"))
        for end in ("a", "b"):
            tied = tied.join(linked_to.select(F.col("node").alias(end), "component"), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
        more = tied if more is None else more.unionByName(tied)
    if more is not None:
        onto = staged(components(more).select(F.col("node").alias("component"), F.col("component").alias("onto")), "onto")
        alone = onto.join(linked_to.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("onto").alias("component"))
        moved = linked_to.join(onto, "component", "left").select("node", F.coalesce("onto", "component").alias("component"))
        linked_to = staged(moved.unionByName(alone), "components")
    discard(full, members)
    rooted = staged(same.select("n", "d1", "d2", "doc_id", "node").join(linked_to, "node", "left").withColumn("component", F.coalesce("component", "node")), "rooted")
    least = staged(rooted.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size")), "least")
    of_class = join_counted(rooted, least, ["component"], "size", parts).select("n", "d1", "d2", "component_id")
    # Classes of very many copies are one key each: those are joined by broadcast.
    counts = signed.filter("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.count("*").alias("rows"))
    of_class = staged(of_class.join(counts, ["n", "d1", "d2"]), "component-ids")
    known = signed.filter("n > 0 and doc_id is not null").select("doc_id", "n", "d1", "d2")
    out = join_counted(known, of_class, ["n", "d1", "d2"], "rows", parts).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = signed.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    if repeated:
        # An empty text of an id that has others is the same document as they are.
        alone = alone.join(out.groupBy("doc_id").agg(F.min("component_id").alias("reached")), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("reached", "component_id").alias("component_id"))
    out = out.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def _second_round(placed: DataFrame, members: DataFrame, full: DataFrame, linked_to: DataFrame, percent: int) -> DataFrame | None:
    """Links between blocks of groups that the first round left in several components."""
    wide = placed.filter(F.col("size") > BLOCK)
    if wide.isEmpty():
        return None
    rooted = wide.join(linked_to, "node", "left").select("node", "grp", "block", F.coalesce("component", "node").alias("root"))
    rooted = staged(rooted, "roots")
    major = staged(rooted.groupBy("grp", "root").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.sum("n").alias("size")), "major")
    rooted = join_counted(rooted, major, ["grp"], "size", shuffle_parts(placed.sparkSession))
    rooted = staged(rooted.withColumn("minor", F.col("root") != F.col("major")), "rooted")
    at = members.select("key", "node").join(rooted, "node").groupBy("key", "grp", "block").agg(F.max("minor").alias("minor"))
    one, two = at.alias("x"), at.alias("y")
    # Only blocks that share a band, and of which one holds nodes outside the main component.
    pairs = one.join(two, (F.col("x.key") == F.col("y.key")) & (F.col("x.grp") == F.col("y.grp")) & (F.col("x.block") < F.col("y.block")) & (F.col("x.block") > 0) & (F.col("x.minor") | F.col("y.minor")))
    pairs = staged(pairs.select("x.grp", F.col("x.block").alias("low"), F.col("y.block").alias("high")).distinct(), "block-pairs")
    if pairs.isEmpty():
        return None
    sides = pairs.select("grp", F.explode(F.array("low", "high")).alias("block"), F.concat_ws("-", F.lit("p"), "grp", "low", "high").alias("task"))
    tasks = full.join(rooted.select("node", "root"), "node").join(broadcast_if_small(sides, 64), ["grp", "block"])
    return staged(_links(tasks, percent), "links")

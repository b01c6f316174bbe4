"""Substring dedup: windows of WINDOW words that also start in a document with a smaller id are cut out.

Super-k-mer partitioning. The minimiser of a window is the least hash of its runs of
GRAM words. Consecutive windows with the same minimiser form a run, which travels as
one packed string (its words joined by one space) to the bucket of the minimiser;
there the windows of all strings are sorted as bytes, so equal windows meet and are
counted exactly. Any two equal windows have the same minimiser.

1. Minimisers alone are counted first: (minimiser, id) pairs, 16 bytes for about
   sixteen words. A run travels on only if its minimiser occurs in two documents; no
   equal window is lost by that.
2. Equal strings of a batch travel once. Buckets with more than HEAVY strings (a
   passage that very many documents hold, in ever other surroundings) are split into
   single windows and grouped by an aggregation with partial sums, so no task gets
   more than its share.
3. For every string the least id of each of its windows returns to the runs, then to
   the documents, where the covered words are removed.

Windows are judged on the input, not on what is left of it.

Defined results: null and empty texts have no words; rows without an id are never
changed and remove nothing; rows that share an id do not remove each other's words;
texts with fewer words than a window stay whole; an empty table gives an empty result.
Very long texts are taken in spans that overlap by a window, nothing of them is cut.
Columns other than id, text and the carried ones are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .runtime import broadcast_if_small, discard, join_counted, ship, shuffle_parts, staged

WINDOW, GRAM = 50, 20
#: Longest run in windows; texts that repeat one word would else give runs without end.
MAX_RUN = 32
#: Strings in a bucket above which it is split into windows.
HEAVY = 500
ID_BROADCAST = 64 << 20


class _Runs:
    """Runs of windows with one minimiser: doc (row), first word, number of windows, minimiser."""

    def __init__(self, words: tk.Words, window: int, gram: int):
        n = len(words.start)
        empty = np.zeros(0, np.int64)
        self.doc, self.first, self.count, self.key = empty, empty, empty, empty
        if n < window:
            return
        least = tk.sliding_min(tk.gram_hashes(words.hashes(), gram), window - gram + 1)
        at = np.arange(n - window + 1)
        at = at[at + window <= words.first[words.doc[at] + 1]]
        if not len(at):
            return
        key, doc = least[at], words.doc[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        heads = np.flatnonzero(new)
        inside = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
        heads = np.flatnonzero(new | (inside % MAX_RUN == 0))
        self.count = np.diff(np.append(heads, len(at)))
        self.doc, self.first, self.key = doc[heads], at[heads] - words.first[doc[heads]], key[heads].view(np.int64)


def _minimisers(window: int, gram: int):
    @tk.worker_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = tk.string_buffers(b.column("text"))
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, _, _, words in tk.word_chunks(data, offsets, window):
                runs = _Runs(words, window, gram)
                yield pa.RecordBatch.from_arrays([pa.array(runs.key, pa.int64()), pa.array(ids[lo + runs.doc], pa.int64())], names=["key", "doc_id"])

    return run


def _packed(window: int, gram: int):
    schema = pa.schema([("key", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("doc_id", pa.int64()), ("r1", pa.int64()), ("r2", pa.int64()), ("first", pa.int32()), ("packed", pa.binary()), ("copies", pa.bool_())])

    @tk.worker_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = tk.string_buffers(b.column("text"))
            ids, r1, r2 = (b.column(c).to_numpy() for c in ("doc_id", "r1", "r2"))
            keys = b.column("keys")
            for lo, hi, skipped, words in tk.word_chunks(data, offsets, window):
                runs = _Runs(words, window, gram)
                out: list[tuple] = []
                carrier: dict[tuple[int, int], int] = {}
                for d, (a, z) in enumerate(zip(*(np.searchsorted(runs.doc, np.arange(hi - lo), side=s) for s in ("left", "right")), strict=True)):
                    wanted = keys[lo + d].values.to_numpy()
                    for i in (np.flatnonzero(np.isin(runs.key[a:z], wanted)) + a).tolist():
                        start = int(words.first[d] + runs.first[i])
                        text = words.text(start, start + int(runs.count[i]) + window - 1)
                        digest = np.frombuffer(xxhash.xxh3_128_digest(text), np.int64)
                        name = (int(digest[0]), int(digest[1]))
                        doc_id = int(ids[lo + d])
                        held = carrier.get(name)
                        row = (int(runs.key[i]), *name, doc_id, int(r1[lo + d]), int(r2[lo + d]), skipped + int(runs.first[i]))
                        # The string travels with the least id of this batch, and says if others here have it.
                        if held is None:
                            carrier[name] = len(out)
                            out.append((*row, text, False))
                            continue
                        copies = out[held][8] or out[held][3] != doc_id
                        if doc_id < out[held][3]:
                            out[held] = (*out[held][:7], None, None)
                            carrier[name] = len(out)
                            out.append((*row, text, copies))
                        else:
                            out[held] = (*out[held][:8], copies)
                            out.append((*row, None, None))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def windows_of(packed: bytes, window: int) -> list[bytes]:
    """All windows of a packed string, as bytes."""
    at = np.frombuffer(packed, np.uint8)
    gaps = np.flatnonzero(at == 0x20)
    begins = np.concatenate([[0], gaps + 1]).tolist()
    ends = np.append(gaps, len(packed)).tolist()
    return [packed[a:z] for a, z in zip(begins, ends[window - 1 :], strict=False)]


def least_ids(strings: list[tuple[bytes, int, bool]], window: int) -> dict[bytes, list[int]]:
    """For each distinct packed string of a bucket the least id of each window, if some window has two ids.

    A string comes with the least id that a batch has for it, and whether others of the batch have it too.
    """
    first: dict[bytes, int] = {}
    useful = set()
    for text, doc, copies in strings:
        if copies or first.get(text, doc) != doc:
            useful.add(text)
        first[text] = min(doc, first.get(text, doc))
    if len(first) == 1 and not useful:
        return {}
    texts = list(first)
    rows = sorted((w, first[t], i, k) for i, t in enumerate(texts) for k, w in enumerate(windows_of(t, window)))
    least = [[0] * (t.count(b" ") + 2 - window) for t in texts]
    last, doc = None, 0
    for w, d, i, k in rows:
        if w != last:
            last, doc = w, d
        elif d != doc:
            useful.add(texts[i])
        least[i][k] = doc
    return {t: v for t, v in zip(texts, least, strict=True) if t in useful or v != [first[t]] * len(v)}


def _buckets(window: int):
    def emit(strings: list[tuple[bytes, int, bool]]) -> list[tuple]:
        return [(*np.frombuffer(xxhash.xxh3_128_digest(t), np.int64).tolist(), v) for t, v in least_ids(strings, window).items()]

    @tk.worker_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("least", pa.list_(pa.int64()))])
        held: list[tuple[bytes, int, bool]] = []
        key = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            out: list[tuple] = []
            for k, text, doc, copies in zip(*(b.column(n).to_pylist() for n in ("key", "packed", "doc_id", "copies")), strict=True):
                if k != key:
                    out += emit(held)
                    held, key = [], k
                held.append((text, doc, copies))
            if out:
                yield batch(out)
        if held and (out := emit(held)):
            yield batch(out)

    return run


def _single_windows(window: int):
    @tk.worker_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rows = []
                for p1, p2, text, doc, copies in zip(*(part.column(n).to_pylist() for n in ("p1", "p2", "packed", "doc_id", "copies")), strict=True):
                    rows += [(p1, p2, k, w, doc, copies) for k, w in enumerate(windows_of(text, window))]
                if rows:
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["p1", "p2", "k", "window", "doc_id", "copies"])

    return run


def _staying(starts: np.ndarray, window: int, first: int, count: int) -> np.ndarray:
    """Which of the words first..first+count no window covers; `starts` are rising places of windows."""
    near = starts[np.searchsorted(starts, first - window, side="right") : np.searchsorted(starts, first + count)] - first
    edge = np.zeros(count + 1, np.int32)
    edge[np.maximum(near, 0)] += 1
    # Windows that begin before the first word share their place, so those are summed.
    edge[0] += max(0, int((near <= 0).sum()) - 1)
    ends = near + window
    np.add.at(edge, ends[ends < count], -1)
    return np.flatnonzero(np.cumsum(edge[:count]) == 0)


def _kept(words: tk.Words, a: int, z: int, starts: np.ndarray | None, window: int, first: int = 0) -> tuple[bytes, int]:
    """The words a..z-1 that stay, joined by one space, and their number."""
    if starts is None or not len(starts):
        return words.text(a, z), z - a
    stay = _staying(starts, window, first, z - a) + a
    return b" ".join(words.data[words.start[i] : words.end[i]].tobytes() for i in stay.tolist()), len(stay)


def _cut(window: int):
    @tk.worker_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = tk.string_buffers(b.column("text"))
            hits = b.column("hits")

            def starts_of(row: int, hits=hits) -> np.ndarray | None:
                return None if hits[row].values is None else np.unique(hits[row].values.to_numpy())

            for lo, hi in tk.row_chunks(offsets):
                if tk.is_long(offsets, lo, hi):
                    starts, total, stayed, parts = starts_of(lo), 0, 0, []
                    for x, y in tk.spans(data, int(offsets[lo]), int(offsets[hi])):
                        words = tk.Words(data, np.array([x, y]), 0, 1)
                        text, n = _kept(words, 0, len(words.start), starts, window, total)
                        total, stayed = total + len(words.start), stayed + n
                        if n:
                            parts.append(text)
                    counts, removed, kept = [total], [total - stayed], [b" ".join(parts)]
                else:
                    words = tk.Words(data, offsets, lo, hi)
                    edges = words.first.tolist()
                    made = [_kept(words, a, z, starts_of(lo + d), window) for d, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
                    counts = words.counts
                    removed, kept = [int(c) - n for c, (_, n) in zip(counts, made, strict=True)], [t for t, _ in made]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), b.column("carried").slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "carried", "n_words", "n_removed", "kept"],
                )

    return run


def _join_few(docs: DataFrame, few: DataFrame, on: list[str], value: str, outer: bool) -> DataFrame:
    """docs joined to the few rows that have something for them; only those documents are shuffled if their keys fit a broadcast."""
    marked = broadcast_if_small(few.select(*on), 32, ID_BROADCAST)
    some = docs.join(marked, on, "left_semi").join(few, on)
    if not outer:
        return some
    rest = docs.join(marked, on, "left_anti").withColumn(value, F.lit(None).cast(few.schema[value].dataType))
    return some.select(*rest.columns).unionByName(rest)


def cut_repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carried, n_words, n_removed, kept (the words that stay, joined by one space) for every row.

    `carried` is a struct of the columns named in `carry`, unchanged.
    """
    spark = documents.sparkSession
    ship(spark)
    carried = F.struct(*[F.col(c) for c in carry] or [F.lit(True).alias("none")]).alias("carried")
    whole = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), carried)
    docs = whole.select("doc_id", "text")
    parts = shuffle_parts(spark)
    found = staged(docs.filter("doc_id is not null").mapInArrow(_minimisers(window, gram), "key long, doc_id long"), "minimisers")
    shared = staged(found.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).filter("low < high").select("key", "n"), "shared")
    # A passage that very many documents hold is one key: those rows are not shuffled by it.
    lists = staged(join_counted(found, shared, ["key"], "n", parts).groupBy("doc_id").agg(F.collect_set("key").alias("keys")), "lists")
    discard(found, shared)

    # Tells rows with one id apart: the id goes along, so it only has to tell texts of one id apart.
    rows = whole.withColumn("r1", F.xxhash64("doc_id", "text")).withColumn("r2", F.xxhash64(F.lit(3), "text", "doc_id"))
    listed = _join_few(rows.filter("doc_id is not null").select("doc_id", "r1", "r2", "text"), lists, ["doc_id"], "keys", outer=False).select("doc_id", "r1", "r2", "text", "keys")
    runs = staged(listed.mapInArrow(_packed(window, gram), "key long, p1 long, p2 long, doc_id long, r1 long, r2 long, first int, packed binary, copies boolean"), "runs")

    strings = runs.filter("packed is not null").select("key", "packed", "doc_id", "copies", "p1", "p2")
    counts = strings.groupBy("key").agg(F.count("*").alias("n"))
    big = staged(counts.filter(F.col("n") > heavy).select("key"), "heavy")
    any_big = not big.isEmpty()
    light = strings.join(broadcast_if_small(big, 16), "key", "left_anti") if any_big else strings
    dealt = light.select("key", "packed", "doc_id", "copies").repartition(parts, "key").sortWithinPartitions("key")
    least = dealt.mapInArrow(_buckets(window), "p1 long, p2 long, least array<long>")
    if any_big:
        split = strings.join(broadcast_if_small(big, 16), "key", "left_semi").mapInArrow(_single_windows(window), "p1 long, p2 long, k int, window binary, doc_id long, copies boolean")
        split = split.withColumn("w", F.struct(F.xxhash64("window").alias("x"), F.xxhash64(F.lit(7), "window").alias("y")))
        lows = split.groupBy("window").agg(F.first("w").alias("w"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("copies").alias("copies"), F.count("*").alias("n")).filter("low < high or copies")
        lows = staged(lows.select("w", "low", "n"), "windows")
        where = staged(split.select("p1", "p2", "k", "w").distinct(), "places")
        hit = join_counted(where, lows, ["w"], "n", parts).groupBy("p1", "p2").agg(F.array_sort(F.collect_list(F.struct("k", "low"))).alias("pairs"))
        # Windows without an entry have one id only; no document is below a least id of its own.
        filled = F.expr(f"transform(sequence(0, element_at(pairs, -1).k), i -> coalesce(get(filter(pairs, p -> p.k = i), 0).low, {2**63 - 1}))")
        least = least.unionByName(hit.select("p1", "p2", filled.alias("least")))
    # How many runs a string has: copies of one passage are one key.
    sizes = runs.groupBy("p1", "p2").agg(F.count("*").alias("n"))
    least = staged(least.dropDuplicates(["p1", "p2"]).join(sizes, ["p1", "p2"]), "least")

    starts = F.expr("transform(filter(sequence(0, size(least) - 1), k -> least[k] < doc_id), k -> first + k)")
    met = join_counted(runs.select("p1", "p2", "doc_id", "r1", "r2", "first"), least, ["p1", "p2"], "n", parts)
    hits = met.select("doc_id", "r1", "r2", starts.alias("starts")).filter(F.size("starts") > 0)
    hits = staged(hits.groupBy("doc_id", "r1", "r2").agg(F.flatten(F.collect_list("starts")).alias("hits")), "hits")
    discard(runs, least, lists, big)
    return _join_few(rows, hits, ["doc_id", "r1", "r2"], "hits", outer=True).select("doc_id", "text", "hits", "carried").mapInArrow(_cut(window), f"doc_id long, carried {whole.schema['carried'].dataType.simpleString()}, n_words long, n_removed long, kept string")

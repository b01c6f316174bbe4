"""Byte-level BPE encoding and decoding from a rank file, with a hierarchical-bitmap rank queue.

A text is cut into pre-tokens by a pattern; inside a pre-token the adjacent pair of the
lowest rank, leftmost first, is merged until no pair has a rank. Pairs wait in one
bucket per rank that holds positions of a linked list of tokens; a three-level bitmap
of the buckets in use finds the next rank by find-first-set; entries that a later merge
made stale are skipped when they come up.

Short pre-tokens of a batch share one queue: a bucket is emptied for all of them at
once, one merge per pre-token, as numpy arrays. A long pre-token has a queue of its own
and takes time n log n at worst, so a text without any break is no special case.

Ids are the ranks. Decoding joins the bytes of the ids.

Defined results: null counts as the empty text, which has no ids; ids without an entry
raise an error in decoding; repeated rows are encoded each; an empty table gives an
empty result. Very long texts are encoded some pre-tokens at a time; nothing is cut,
whatever the length. Other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .runtime import ship

#: Bytes from which a pre-token gets a queue of its own.
LONG = 512
#: Pre-tokens that a worker remembers with their ids.
CACHE_ENTRIES = 150_000
#: Pre-tokens of a long text that are encoded at a time.
PIECES = 100_000
_NONE = np.int32(np.iinfo(np.int32).max)


def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes -> rank of a rank file: base64 and a number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankBitmap:
    """A set of small integers with find-first-set over three levels of 64-bit words."""

    def __init__(self, size: int):
        self.low = [0] * (size // 64 + 1)
        self.mid = [0] * (size // 4096 + 1)
        self.top = 0

    def add(self, i: int) -> None:
        self.low[i >> 6] |= 1 << (i & 63)
        self.mid[i >> 12] |= 1 << (i >> 6 & 63)
        self.top |= 1 << (i >> 12)

    def discard(self, i: int) -> None:
        self.low[i >> 6] &= ~(1 << (i & 63))
        if not self.low[i >> 6]:
            self.mid[i >> 12] &= ~(1 << (i >> 6 & 63))
            if not self.mid[i >> 12]:
                self.top &= ~(1 << (i >> 12))

    def first(self) -> int:
        """The least member, or -1."""
        if not self.top:
            return -1
        t = (self.top & -self.top).bit_length() - 1
        m = t << 6 | (self.mid[t] & -self.mid[t]).bit_length() - 1
        return m << 6 | (self.low[m] & -self.low[m]).bit_length() - 1


class Merges:
    """Ranks of a vocabulary: of byte strings, and of pairs of ids as a sorted table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values(), default=0) + 1
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte_ids < 0).any():
            raise ValueError("the rank file lacks single bytes")
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        # One more entry keeps every search inside the table.
        self.keys = np.append(keys[order], np.int64(2**62))
        self.values = np.append(np.fromiter(pairs.values(), np.int32, len(pairs))[order], _NONE)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.values[at], _NONE)


def encode_long(merges: Merges, piece: bytes) -> list[int]:
    """Ids of one pre-token, through a queue of its own."""
    ids = merges.byte_ids[np.frombuffer(piece, np.uint8)]
    n = len(ids)
    waiting = merges.pair_ranks(ids[:-1], ids[1:]).tolist() + [int(_NONE)]
    ids = ids.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    none, pairs = int(_NONE), merges.pairs
    buckets: dict[int, list[int]] = {}
    queue = RankBitmap(merges.size)
    for i, r in enumerate(waiting):
        if r != none:
            if r not in buckets:
                buckets[r] = []
                queue.add(r)
            buckets[r].append(i)
    while (rank := queue.first()) >= 0:
        bucket = buckets[rank]
        at = heapq.heappop(bucket)
        if not bucket:
            del buckets[rank]
            queue.discard(rank)
        if waiting[at] != rank:
            continue
        gone = after[at]
        to = after[gone]
        ids[at], ids[gone], waiting[gone] = rank, -1, none
        after[at] = to
        if to < n:
            before[to] = at
        for i, j in ((at, to), (before[at], at)):
            if i >= 0:
                r = pairs.get(ids[i] << 32 | ids[j], none) if j < n else none
                waiting[i] = r
                if r != none:
                    if r not in buckets:
                        buckets[r] = []
                        queue.add(r)
                    heapq.heappush(buckets[r], i)
    return [i for i in ids if i >= 0]


def encode_short(merges: Merges, pieces: list[bytes]) -> list[bytes]:
    """Ids of many pre-tokens as little-endian 32-bit integers, through one queue."""
    if not pieces:
        return []
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ids = merges.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    n = len(ids)
    of = np.repeat(np.arange(len(pieces)), lengths)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    waiting = np.full(n + 1, _NONE, np.int32)
    waiting[: n - 1] = np.where(of[1:] == of[:-1], merges.pair_ranks(ids[:-1], ids[1:]), _NONE)
    alive = np.ones(n, dtype=bool)
    ids = np.append(ids, np.int32(-1))
    of = np.append(of, -1)
    buckets: dict[int, list[np.ndarray]] = {}
    queue = RankBitmap(merges.size)

    def push(at: np.ndarray) -> None:
        """Put positions, in rising order, into the buckets of their waiting ranks."""
        ranks = waiting[at]
        at, ranks = at[ranks != _NONE], ranks[ranks != _NONE]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        edges = [0, *cuts.tolist(), len(at)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            r = int(ranks[lo])
            if r in buckets:
                buckets[r].append(at[lo:hi])
            else:
                buckets[r] = [at[lo:hi]]
                queue.add(r)

    push(np.flatnonzero(waiting[:n] != _NONE))
    while (rank := queue.first()) >= 0:
        held = buckets.pop(rank)
        at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
        at = at[waiting[at] == rank]
        queue.discard(rank)
        if not len(at):
            continue
        word = of[at]
        lead = np.ones(len(at), dtype=bool)
        lead[1:] = word[1:] != word[:-1]
        if not lead.all():
            # One merge per pre-token: it may give rise to a pair of lower rank.
            buckets[rank] = [at[~lead]]
            queue.add(rank)
            at, word = at[lead], word[lead]
        gone = after[at]
        to = after[gone]
        ids[at] = rank
        alive[gone] = False
        waiting[gone] = _NONE
        after[at] = to
        inner = to < n
        before[to[inner]] = at[inner]
        waiting[at] = np.where(of[to] == word, merges.pair_ranks(ids[at], ids[to]), _NONE)
        left = before[at]
        has = (left >= 0) & (of[left] == word)
        left, right = left[has], at[has]
        waiting[left] = merges.pair_ranks(ids[left], ids[right])
        push(np.sort(np.concatenate([at, left])))
    counts = np.bincount(of[:n][alive], minlength=len(pieces))
    flat = ids[:n][alive].astype("<u4").tobytes()
    edges = np.concatenate([[0], np.cumsum(counts)]) * 4
    return [flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


class Encoder:
    """Encodes texts, remembering pre-tokens in bounded memory."""

    def __init__(self, merges: Merges, pattern: str):
        self.merges = merges
        compiled = regex.compile(pattern)
        self.cut, self.walk = compiled.findall, compiled.finditer
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        return self._ids([self.cut(t) for t in texts])

    def encode_long(self, text: str) -> bytes:
        """Ids of one text of any length, some pre-tokens at a time."""
        found = (m.group() for m in self.walk(text))
        return b"".join(self._ids([part])[0] for part in iter(lambda: list(itertools.islice(found, PIECES)), []))

    def _ids(self, cut: list[list[str]]) -> list[bytes]:
        known = self.known
        new = set().union(*cut).difference(known)
        if len(known) + len(new) > CACHE_ENTRIES:
            known.clear()
            new = set().union(*cut)
        ranks, short, long = self.merges.ranks, [], {}
        for piece in new:
            raw = piece.encode()
            if (r := ranks.get(raw)) is not None:
                known[piece] = r.to_bytes(4, "little")
            elif len(raw) < LONG:
                short.append((piece, raw))
            else:
                long[piece] = np.array(encode_long(self.merges, raw), "<u4").tobytes()
        known.update(zip((p for p, _ in short), encode_short(self.merges, [raw for _, raw in short]), strict=True))
        look = known.__getitem__
        if long:
            look = lambda p: long[p] if p in long else known[p]
        return [b"".join(map(look, pieces)) for pieces in cut]


def _encoding(ranks, pattern: str):
    @tk.worker_task
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Merges(ranks.value), pattern)
        for b in batches:
            texts = b.column("text")
            _, offsets = tk.string_buffers(texts)
            for lo, hi in tk.row_chunks(offsets):
                some = [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
                ids = [encoder.encode_long(some[0])] if tk.is_long(offsets, lo, hi) else encoder.encode(some)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def _joined(token, ids: np.ndarray) -> bytes:
    return b"".join(b"".join(map(token, ids[k : k + PIECES].tolist())) for k in range(0, len(ids), PIECES))


def _decoding(ranks):
    @tk.worker_task
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {r: t for t, r in ranks.value.items()}.__getitem__
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                out = [_joined(token, np.frombuffer(x or b"", "<u4")) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, "decoded"])

    return run


def encode(documents: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers) of every row."""
    spark = documents.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_encoding(ranks, pattern), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The rows of encode() with decoded (binary), the bytes of their ids."""
    spark = encoded.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decoding(ranks), "doc_id long, n_tokens long, ids binary, decoded binary")

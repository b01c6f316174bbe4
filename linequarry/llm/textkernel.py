"""Vectorised word kernels over Arrow string columns.

Everything here works on the raw UTF-8 buffer of an Arrow string column: word boundaries
and hashes of word n-grams are numpy passes over a bounded chunk of documents, a word's
hash is 64 bits of xxh3 over its bytes. A text longer than a chunk is taken in spans that
end at white space, so memory does not grow with the length of a text.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. All of these are
ASCII, so cutting the bytes and cutting the code points give the same words.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 20

_GRAM = np.uint64(0xD6E8FEB86659FD93)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def release() -> None:
    """Give memory that is no longer used back to the system; Spark keeps its workers for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        # Another C library: it keeps what it has.
        return


def worker_task(run: Callable) -> Callable:
    """A function over batches that tidies its worker when its task ends."""

    @functools.wraps(run)
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidy


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of each 64-bit value (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def _cut(data: np.ndarray, begin: int, end: int, limit: int) -> int:
    """End of a span of about `limit` bytes from `begin` on: behind a blank, or the end of the text."""
    at = begin + limit
    if at >= end:
        return end
    tail = np.flatnonzero(_SPACE[data[max(begin, at - 4096) : at]])
    if len(tail):
        return max(begin, at - 4096) + int(tail[-1]) + 1
    while at < end:
        head = np.flatnonzero(_SPACE[data[at : min(at + limit, end)]])
        if len(head):
            return at + int(head[0]) + 1
        at += limit
    return end


def spans(data: np.ndarray, begin: int, end: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Byte ranges of a text, one after the other, that cut no word; at least one."""
    while True:
        stop = _cut(data, begin, end, limit)
        yield begin, stop
        if stop >= end:
            return
        begin = stop


class Words:
    """Words of the rows lo..hi of a string column.

    start, end: byte positions inside `data` (a slice of the buffer);
    doc: row of each word, counted from lo; first: index of each row's first
    word, with one more entry for the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, lower: bool = False):
        base, stop = int(offsets[lo]), int(offsets[hi])
        self.data = data[base:stop]
        if lower:
            self.data = _LOWER[self.data]
        bounds = (offsets[lo : hi + 1] - base).astype(np.int64)
        n = len(self.data)
        solid = ~_SPACE[self.data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[bounds] = True
        begins, ends = solid.copy(), solid
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(hi - lo), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        text = self.data.tobytes()
        words = map(text.__getitem__, map(slice, self.start.tolist(), self.end.tolist()))
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(self.start))

    def text(self, i: int, j: int) -> bytes:
        """Words i..j-1 joined by one space."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j], strict=True))


def is_long(offsets: np.ndarray, lo: int, hi: int) -> bool:
    """Is the range of rows from row_chunks one text that is to be taken in spans?"""
    return int(offsets[hi] - offsets[lo]) > CHUNK_BYTES


def word_chunks(data: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[int, int, int, Words]]:
    """(lo, hi, k, words): the rows lo..hi whole with k = 0, or a span of one long text from its word k on.

    Spans overlap by window - 1 words, so every run of `window` words lies in exactly one.
    """
    for lo, hi in row_chunks(offsets):
        if not is_long(offsets, lo, hi):
            yield lo, hi, 0, Words(data, offsets, lo, hi)
            continue
        at, end, k, size = int(offsets[lo]), int(offsets[hi]), 0, CHUNK_BYTES
        while True:
            stop = _cut(data, at, end, size)
            words = Words(data, np.array([at, stop]), 0, 1)
            n = len(words.start)
            if stop < end and n < 2 * window:
                # Few, very long words.
                size *= 2
                continue
            yield lo, hi, k, words
            if stop >= end:
                break
            step = n - window + 1
            at, k, size = at + int(words.start[step]), k + step, CHUNK_BYTES


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive values; shorter by size - 1."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        acc *= _GRAM
        acc += words[j : n + j]
    return mix(acc)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of `size` values, by doubling the covered width."""
    out, width = values, 1
    while width * 2 <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = size - width
    return np.minimum(out[:-rest], out[rest:]) if rest else out

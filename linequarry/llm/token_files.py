"""Token ids in Arrow files of equal-length sequences, written in id order and read back.

A text is encoded as the tokenizers library does with add_special_tokens=False. As its
pre-tokenizer never joins text over white space, or over the border from a letter to ASCII
punctuation, texts are cut there first. Arrow's dictionary encoding finds the distinct
pieces (by their bytes) of a chunk of texts, each is looked up or encoded once, and ids
are gathered per document by the dictionary's indices. The library finds the strings of
added tokens in a text before it cuts it; a word that holds one is given to it whole and
as it is.

File format. Documents are dealt to ranges of rising ids; each range becomes one Arrow
IPC file of record batches with two fixed-size-list columns, `ids` (the narrowest
unsigned type that holds the vocabulary) and `mask` (true for real tokens; Arrow's one bit
a place), of SEQUENCE entries each; only the last sequence of a file is padded. Batches
are not compressed, so a reader maps a file and reaches the ids and the mask of any
sequence as views of it, without a copy. Beside it lies an index file with doc_id, start
(place in the file's own stream) and n_tokens.

Files get a name of their own in every attempt, and only the files that a finished task
reports are read; an executor may be lost at any time.

Defined results: null counts as the empty text, which has only the end id; rows
without an id come first; rows that repeat an id follow each other, in an order that only
their texts decide; an empty table writes no file and gives an empty result. Very long
texts are encoded in spans that end at white space. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .runtime import id_splits, new_folder, range_of, ship, shuffle_parts, spread

SEQUENCE = 1024
#: Sequences in a record batch.
BATCH = 256
END_ID = 1
#: Pieces in each of the two generations that a worker remembers with their ids.
CACHE_ENTRIES = 300_000
#: Text that is cut into pieces at once: the more of it, the fewer look-ups, as words repeat.
CHUNK_BYTES = 3 << 20
#: Pieces in one call of the library.
CALL = 4000
#: Pieces that are one pre-token for certain: nothing but letters up to U+00FF, in UTF-8.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch

_BLANKS = np.flatnonzero(tk._SPACE).astype(np.uint8).tobytes()
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


class _Pieces(tk.Words):
    """Words of a text, cut once more where ASCII punctuation follows a letter (a-z or U+00C0-00FF)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int):
        super().__init__(data, offsets, lo, hi, lower=True)
        self.word_start, self.word_end = self.start, self.end
        text = self.data
        cut = np.flatnonzero(_PUNCT[text])
        cut = cut[cut > 0]
        before = text[cut - 1]
        latin = (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (cut > 1) & (text[cut - 2] == 0xC3)
        cut = cut[_LETTER[before] | latin]
        # Neither side of a cut is blank, so it lies inside a word, or is a word's own start where a row begins.
        edge = np.zeros(len(text) + 1, dtype=bool)
        edge[self.start] = True
        cut = cut[~edge[cut]]
        edge[cut] = True
        self.start = np.flatnonzero(edge)
        edge[:] = False
        edge[self.word_end] = edge[cut] = True
        self.end = np.flatnonzero(edge)
        self.first = np.searchsorted(self.start, offsets[lo : hi + 1] - offsets[lo])
        self.counts = np.diff(self.first)

    def column(self) -> pa.Array:
        """The pieces as an Arrow column: together they are all bytes but the blanks."""
        edges = np.zeros(len(self.start) + 1, np.int64)
        np.cumsum(self.end - self.start, out=edges[1:])
        return pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(edges), pa.py_buffer(self.data.tobytes().translate(None, _BLANKS))])


class Encoder:
    """Ids of texts, each distinct piece encoded once while the memory of pieces is bounded."""

    def __init__(self, spec: str):
        # A task has one core; the library's own threads would take those of other tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        # Strings that the library looks for before it cuts a text, as they would be after lower-casing.
        added = json.loads(spec).get("added_tokens") or []
        if any(t["content"].split() != [t["content"]] for t in added):
            raise ValueError("an added token holds white space: texts cannot be cut there")
        self.added = sorted({t["content"].encode().translate(tk._LOWER.tobytes()) for t in added})
        self.type = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _keep(self, pieces: list[bytes], ids: np.ndarray, edges: np.ndarray) -> None:
        raw = ids.tobytes()
        edges = (edges * self.type.itemsize).tolist()
        self.known.update(zip(pieces, map(raw.__getitem__, map(slice, edges[:-1], edges[1:])), strict=True))

    def _learn(self, pieces: list[bytes]) -> None:
        for p in pieces:
            if p[:1] in (b"", b" "):
                # Words as they stand in the text: the library looks for added tokens itself.
                self.known[p] = np.array(self.tokenizer.encode(p[1:].decode(), add_special_tokens=False).ids, self.type).tobytes()
        plain, other = [], []
        for p in pieces:
            if _PLAIN(p):
                plain.append(p)
            elif p[:1] not in (b"", b" "):
                other.append(p)
        for k in range(0, len(plain), CALL):
            part = plain[k : k + CALL]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, self.type)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(part):
                self._keep(part, ids, np.concatenate([[0], ends]))
            else:
                # A vocabulary without word ends: have the library count.
                other += part
        for k in range(0, len(other), CALL):
            part = other[k : k + CALL]
            made = self.tokenizer.encode([p.decode() for p in part], is_pretokenized=True, add_special_tokens=False)
            counts = np.bincount(np.array(made.word_ids, np.int64), minlength=len(part)) if made.ids else np.zeros(len(part), np.int64)
            self._keep(part, np.array(made.ids, self.type), np.concatenate([[0], np.cumsum(counts)]))

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces, as bytes."""
        if len(self.known) > CACHE_ENTRIES:
            # Pieces that are still in use come over from the older generation one by one.
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        each = list(map(known.get, pieces))
        places = [i for i, ids in enumerate(each) if ids is None]
        missing = [pieces[i] for i in places]
        if older:
            known.update({p: older[p] for p in missing if p in older})
            missing = [p for p in missing if p not in older]
        self._learn(missing)
        for i in places:
            each[i] = known[pieces[i]]
        return each

    def _with_added(self, raw: bytes, text: bytes, pieces: _Pieces) -> list[bytes]:
        """Names of the pieces; the words that hold an added token become one piece, named by a blank and their own bytes."""
        begins, ends = pieces.start.tolist(), pieces.end.tolist()
        names = list(map(text.__getitem__, map(slice, begins, ends)))
        found = sorted({m.start() for t in self.added for m in re.finditer(re.escape(t), text)})
        done = -1
        for at in found:
            if at < done:
                continue
            word = int(np.searchsorted(pieces.word_start, at, side="right")) - 1
            a, done = int(pieces.word_start[word]), int(pieces.word_end[word])
            i, j = (int(np.searchsorted(pieces.start, x)) for x in (a, done))
            # The first piece stands for the whole word, its others have no ids.
            names[i:j] = [b" " + raw[a:done]] + [b""] * (j - i - 1)
        return names

    def encode(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows lo..hi of a string column one after the other, and the count of each row."""
        pieces = _Pieces(data, offsets, lo, hi)
        if not len(pieces.start):
            return np.zeros(0, self.type), np.zeros(hi - lo, np.int64)
        text = pieces.data.tobytes() if self.added else b""
        if any(t in text for t in self.added):
            names = pa.array(self._with_added(data[int(offsets[lo]) : int(offsets[hi])].tobytes(), text, pieces), pa.large_binary())
        else:
            names = pieces.column()
        named = names.dictionary_encode()
        each = pa.array(self._ids_of(named.dictionary.to_pylist()), pa.large_binary()).take(named.indices)
        _, at, raw = each.buffers()
        edges = np.frombuffer(at, np.int64, len(each) + 1)[pieces.first] // self.type.itemsize
        ids = np.frombuffer(raw, self.type, int(edges[-1])) if edges[-1] else np.zeros(0, self.type)
        return ids, np.diff(edges)


_ENCODERS: dict[int, Encoder] = {}


def _encoder(spec) -> Encoder:
    key = hash(spec.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec.value)
    return _ENCODERS[key]


@lru_cache
def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


class SequenceWriter:
    """One file of equal-length sequences with its index."""

    def __init__(self, folder: str, part: int, type_: np.dtype, length: int, end_id: int):
        self.store, base = _store(folder)
        self.store.create_dir(base, recursive=True)
        self.name = f"part-{part:06d}-{uuid.uuid4().hex}"
        self.path = f"{base}/{self.name}"
        self.length, self.type = length, type_
        kind = pa.from_numpy_dtype(type_)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))], {"length": str(length), "batch": str(BATCH), "end_id": str(end_id)})
        self.out = self.store.open_output_stream(f"{self.path}.arrow")
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = 0
        self.index: list[tuple[list, np.ndarray]] = []

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.type)
        # All batches but a file's last are full, so that a sequence's number tells its batch.
        rows = -(-len(ids) // self.length) if last else len(ids) // (BATCH * self.length) * BATCH
        used = min(len(ids), rows * self.length)
        for r in range(0, rows, BATCH):
            part = ids[r * self.length : min(used, (r + BATCH) * self.length)]
            n = -(-len(part) // self.length) * self.length
            values, mask = np.zeros(n, self.type), np.zeros(n, bool)
            values[: len(part)], mask[: len(part)] = part, True
            self.writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(values), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
        self.held, self.n_held = [ids[used:]], len(ids) - used

    def add(self, doc_ids: list, ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents in their order, with the ids of all of them."""
        self.index.append((doc_ids, counts))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        if self.n_held >= BATCH * self.length:
            self._flush(False)

    def close(self) -> tuple[str, int, int]:
        self._flush(True)
        self.writer.close()
        self.out.close()
        counts = np.concatenate([c for _, c in self.index])
        docs = pa.table({"doc_id": pa.array([d for ids, _ in self.index for d in ids], pa.int64()), "start": pa.array(np.cumsum(counts) - counts), "n_tokens": pa.array(counts)})
        with self.store.open_output_stream(f"{self.path}.docs.arrow") as out, pa.ipc.new_file(out, docs.schema) as w:
            w.write_table(docs)
        return self.name, len(counts), self.n_tokens


def _with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


def _writing(spec, folder: str, length: int, end_id: int):
    @tk.worker_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, now = _encoder(spec), None, None
        done: list[tuple] = []
        for b in batches:
            parts = b.column("part").to_numpy()
            data, offsets = tk.string_buffers(b.column("text"))
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if a == z:
                    continue
                if parts[a] != now:
                    if writer is not None:
                        done.append((int(now), *writer.close()))
                    now, writer = parts[a], SequenceWriter(folder, int(parts[a]), encoder.type, length, end_id)
                for lo, hi in tk.row_chunks(offsets[a : z + 1], CHUNK_BYTES):
                    if hi - lo == 1 and tk.is_long(offsets, a + lo, a + hi):
                        made = [encoder.encode(data, np.array(span), 0, 1)[0] for span in tk.spans(data, int(offsets[a + lo]), int(offsets[a + hi]))]
                        ids = np.append(np.concatenate(made), encoder.type.type(end_id))
                        counts = np.array([len(ids)], np.int64)
                    else:
                        ids, counts = _with_end(*encoder.encode(data, offsets, a + lo, a + hi), end_id)
                    writer.add(b.column("doc_id").slice(a + lo, hi - lo).to_pylist(), ids, counts)
        if writer is not None:
            done.append((int(now), *writer.close()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["part", "file", "n_docs", "n_tokens"]).cast(pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return run


def write(documents: DataFrame, tokenizer_path: str, folder: str | None = None, length: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, list[dict]]:
    """Write all documents in rising id order; returns the folder and its files, one entry per file.

    An entry has part, file, n_docs, n_tokens and start (tokens in all files before).
    """
    spark = documents.sparkSession
    ship(spark)
    folder = folder or new_folder(spark, "tokens")
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = shuffle_parts(spark)
    dealt = docs.withColumn("part", range_of(F.col("doc_id"), id_splits(docs.select("doc_id"), "doc_id", parts)).cast("int"))
    dealt = dealt.withColumn("at", spread(spark, F.col("part"), parts))
    ordered = dealt.repartition(parts, "at").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    files = ordered.select("part", "doc_id", "text").mapInArrow(_writing(spec, folder, length, end_id), "part int, file string, n_docs long, n_tokens long")
    manifest, start = [], 0
    for r in sorted(files.collect(), key=lambda r: r["part"]):
        manifest.append(r.asDict() | {"start": start})
        start += r["n_tokens"]
    return folder, manifest


class SequenceReader:
    """Random access to the sequences and documents of one file."""

    def __init__(self, folder: str, file: str):
        self.store, base = _store(folder)
        local = isinstance(self.store, pafs.LocalFileSystem)
        opened = [pa.memory_map(f"{base}/{file}{x}") if local else self.store.open_input_file(f"{base}/{file}{x}") for x in (".arrow", ".docs.arrow")]
        self.sequences, self.docs = (pa.ipc.open_file(x) for x in opened)
        self.length, self.batch = (int(self.sequences.schema.metadata[k]) for k in (b"length", b"batch"))
        self.held: tuple[int, np.ndarray] | None = None

    def _ids(self, k: int) -> np.ndarray:
        """Ids of record batch k, its sequences one after the other, as a view; the last one is held, as documents follow each other."""
        if self.held is None or self.held[0] != k:
            self.held = k, self.sequences.get_batch(k).column(0).values.to_numpy()
        return self.held[1]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of one sequence; both are views of the file (a numpy mask of bytes would be a copy)."""
        batch = self.sequences.get_batch(i // self.batch)
        ids, mask = batch.column(0)[i % self.batch].values, batch.column(1)[i % self.batch].values
        return ids.to_numpy(), mask

    def parts(self, start: int, count: int) -> Iterator[np.ndarray]:
        """Tokens start..start+count of the file's stream, as views of one batch after the other."""
        width = self.batch * self.length
        while count > 0:
            at = start % width
            got = self._ids(start // width)[at : at + count]
            if not len(got):
                raise ValueError("a document's tokens end beyond its file")
            yield got
            start, count = start + len(got), count - len(got)

    def span(self, start: int, count: int) -> np.ndarray:
        """Tokens start..start+count of the file's stream, as one array."""
        out = list(self.parts(start, count))
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        for k in range(self.docs.num_record_batches):
            b = self.docs.get_batch(k)
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)


def _reading(folder: str):
    @tk.worker_task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("file", pa.string())])
        for b in batches:
            for file, base in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                reader, rows = SequenceReader(folder, file), []
                for doc_id, start, n in reader.documents():
                    crc = 0
                    for part in reader.parts(start, n):
                        crc = zlib.crc32(part.astype("<u4"), crc)
                    rows.append((doc_id, base + start, n, crc, file))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def read(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, file of every document, from the files; a file is a task's work."""
    ship(spark)
    files = spark.createDataFrame([(m["file"], m["start"]) for m in manifest], "file string, start long")
    if manifest:
        files = files.repartition(len(manifest))
    return files.mapInArrow(_reading(folder), "doc_id long, start long, n_tokens long, ids_crc32 long, file string")

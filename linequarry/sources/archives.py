"""Scripts below a folder: an index of names first, bytes later and only for what is kept.

Spark lists the folder. One pass over the listing opens each file once: it keeps the first
16 bytes for engine detection, reads the index of an archive, applies the gates, and gives
one row for each script that could be read, without its bytes. After versions are resolved
on these rows, the members that are left are read, a few hundred of one archive in a task,
so that a large archive is not one task. Any store that Arrow opens will do.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import looks_like_text, plausible_script, script_like
from ..storage import ship
from . import dsc, loose
from .containers import READERS

# Engines of containers and extensions of members that may be scripts.
ENGINES = {".xp3": "kirikiri", ".exe": "kirikiri", ".nsa": "nscripter", ".sar": "nscripter", ".arc": "bgi"}
WANTED = {"kirikiri": {".ks", ".kag", ".tjs", ".txt"}, "nscripter": {".txt", ".dat", ".ks", ".s", ".sn", ".scn"}, "bgi": {"", ".ws2", ".ws", ".dsc", ".txt", ".csv", ".tsv", ".ini", ".dat", ".src", ".sc", ".s", ".mjo"}}
GATES = {"kirikiri": plausible_script, "nscripter": script_like, "bgi": lambda data: True}
LIMITS = {".exe": 64 << 20, ".nsa": 512 << 20, ".sar": 512 << 20}
#: Members of one container in a task.
TOGETHER = 256
HEAD = 16

INDEX = "kind string, engine string, virtual_path string, container string, size long, error string, path string, member string, rel string, head binary"
SCRIPTS = "engine string, virtual_path string, container string, data binary, size long, error string"
_INDEX = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in INDEX.split(", ")])


def opened(path: str) -> BinaryIO:
    """A seekable file at a Hadoop path or URI."""
    if "://" not in path and path.startswith("file:"):
        path = path[5:]
    if path.startswith("/"):
        return open(path, "rb")
    store, inner = pafs.FileSystem.from_uri(path)
    return io.BufferedReader(store.open_input_file(inner))


def _extension(name: str) -> str:
    return os.path.splitext(name)[1].lower()


def _payload(engine: str, data: bytes) -> bytes:
    """What a member holds; compressed BGI scripts are unpacked."""
    return dsc.unpack(data) if engine == "bgi" and data.startswith(dsc.MAGIC) else data


def _members(f: BinaryIO, path: str, rel: str) -> Iterator[dict]:
    """Index rows of an archive; a member that cannot be read is a row with its error."""
    ext = _extension(rel)
    engine = ENGINES[ext]
    row = {"kind": "script", "engine": engine, "container": rel, "path": path}
    try:
        if ext == ".exe" and f.read(2) != b"MZ":
            return
        for m in READERS[ext](f):
            if _extension(m.name) not in WANTED[engine]:
                continue
            row |= {"virtual_path": f"{rel}/{m.name}", "member": m.name, "error": None}
            try:
                data = _payload(engine, m.read())
            except Exception as e:  # a bad member is a row, not a failed scan
                yield row | {"size": m.size, "error": f"{type(e).__name__}: {e}"}
                continue
            # Gates come before versions are resolved, so that junk never wins.
            if GATES[engine](data):
                yield row | {"size": len(data)}
    except Exception as e:
        if ext != ".exe":
            yield row | {"virtual_path": rel, "size": 0, "member": None, "error": f"{type(e).__name__}: {e}"}


def _indexing(max_file_bytes: int):
    def rows_of(path: str, rel: str, length: int) -> Iterator[dict]:
        try:
            with opened(path) as f:
                head = f.read(HEAD)
                yield {"kind": "file", "rel": rel, "size": length, "path": path, "head": head}
                ext = _extension(rel)
                if ext in READERS and length <= LIMITS.get(ext, length) and loose.is_archive_place(ext, rel):
                    f.seek(0)
                    yield from _members(f, path, rel)
                engine = loose.engine_of(rel, length, max_file_bytes)
                if engine:
                    # Hidden scripts and compiled ones are no text yet; their gate is at extraction.
                    if engine in ("nscripter", "bgi") or looks_like_text(head + f.read(loose.GATE_BYTES + 1 - len(head))):
                        yield {"kind": "script", "engine": engine, "virtual_path": rel, "container": "", "size": length, "path": path}
        except OSError:
            # A file that cannot be opened speaks for no engine and holds no script.
            yield {"kind": "file", "rel": rel, "size": 0, "path": path, "head": b""}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, rel, length in zip(*(b.column(c).to_pylist() for c in ("path", "rel", "length")), strict=True):
                rows = list(rows_of(path, rel, length))
                yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)

    return run


def index(listing: DataFrame, max_file_bytes: int = 64 << 20) -> DataFrame:
    """Rows of INDEX: kind `file` for every file, kind `script` for every script that could be read."""
    spark = listing.sparkSession
    ship(spark)
    # Archives are far apart in cost: many small tasks even out.
    dealt = listing.select("path", "rel", "length").repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return dealt.mapInArrow(_indexing(max_file_bytes), INDEX)


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("script_ord", pa.string()), ("engine", pa.string()), ("virtual_path", pa.string()), ("data", pa.binary())])
    for b in batches:
        for path, wanted in zip(b.column("path").to_pylist(), b.column("wanted").to_pylist(), strict=True):
            with opened(path) as f:
                for w in wanted:
                    if w["member"] is None:
                        f.seek(0)
                        yield pa.RecordBatch.from_pylist([{"script_ord": w["script_ord"], "engine": w["engine"], "virtual_path": w["virtual_path"], "data": f.read()}], schema=schema)
                left = {w["member"]: w for w in wanted if w["member"] is not None}
                if not left:
                    continue
                for m in READERS[_extension(path)](f):
                    # Of members with one name the first counts.
                    w = left.pop(m.name, None)
                    if w:
                        row = {"script_ord": w["script_ord"], "engine": w["engine"], "virtual_path": w["virtual_path"], "data": _payload(w["engine"], m.read())}
                        yield pa.RecordBatch.from_pylist([row], schema=schema)
                    if not left:
                        break


def read(kept: DataFrame) -> DataFrame:
    """script_ord, engine, virtual_path, data of index rows (with script_ord)."""
    ship(kept.sparkSession)
    part = F.when(F.col("member").isNull(), 0).otherwise(F.pmod(F.xxhash64("member"), F.greatest(F.lit(1), F.ceil(F.col("n") / TOGETHER))))
    counted = kept.join(kept.groupBy("path").agg(F.count("*").alias("n")), "path")
    tasks = counted.groupBy("path", part.alias("part")).agg(F.collect_list(F.struct("member", "script_ord", "engine", "virtual_path")).alias("wanted"))
    return tasks.select("path", "wanted").repartition("path", "wanted").mapInArrow(_reading, "script_ord string, engine string, virtual_path string, data binary")


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """Script members of all archives under a folder: engine, virtual_path, container, data, size, error."""
    found = index(loose.listing(spark, root), 0).filter("kind = 'script' and container != ''").withColumn("script_ord", F.col("virtual_path"))
    good = found.filter("error is null").dropDuplicates(["script_ord"])
    data = read(good).select("script_ord", "data")
    return found.join(data, "script_ord", "left").select("engine", "virtual_path", "container", F.when(F.col("error").isNull(), F.col("data")).alias("data"), "size", "error")

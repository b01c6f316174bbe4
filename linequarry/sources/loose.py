"""Loose script files: listing by Spark, engines by name and extension."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..operators.versions import prefix_budget

# Extensions that are read, folders and extensions that are not.
SCRIPT_EXT = (".ks", ".tjs", ".txt", ".ws2", ".mes", ".scn", ".sn", ".s", ".spt", ".asd", ".dat", ".ini", ".csv", ".tsv", ".lst", ".def", ".jaf", ".inc", ".mac", ".cfg", ".nscript", ".script", ".text")
SKIP_DIRS = (
    "bgm", "bg", "se", "voice", "cv", "movie", "video", "image", "images", "img", "cg", "ev", "chara", "sprite", "graphic", "graphics", "font", "fonts", "sound", "audio", "cache",
    "temp", "tmp", "savedata", "save", "screenshot", "screenshots", "system", "sys", "dll", "__pycache__", ".git", ".svn", "node_modules", "redist", "directx", "vcredist",
)
SKIP_EXT = (
    ".png", ".jpg", ".jpeg", ".bmp", ".gif", ".webp", ".tga", ".dds", ".ico", ".svg", ".psd", ".pic", ".anm", ".pna", ".dgm", ".mp3", ".ogg", ".wav", ".m4a", ".flac", ".opus",
    ".aac", ".wma", ".mid", ".mp4", ".avi", ".wmv", ".mkv", ".webm", ".mov", ".mpg", ".mpeg", ".rmvb", ".zip", ".rar", ".7z", ".gz", ".bz2", ".xz", ".cab", ".lzh", ".exe", ".dll",
    ".so", ".sys", ".ocx", ".msi", ".ttf", ".otf", ".ttc", ".fon", ".fot", ".db", ".sqlite", ".pdf", ".chm", ".hlp", ".xp3", ".arc", ".ypf", ".pfs", ".pak",
)
#: Compiled scripts beside the ones above.
COMPILED_EXT = (".ws2", ".ws", ".dsc", ".src", ".sc", ".mjo")
KAG_EXT = (".ks", ".kag", ".tjs")
KAG_BYTES = 32 << 20
#: Bytes that the gate of loose text looks at.
GATE_BYTES = 16384
NSCRIPT_NAMES = ("nscript.dat", "nscript.txt", "nscript.___", "nscript.old", "00.txt", "0.txt", "00_.txt")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, rel, length of all files under a root, which may be one file; no file is opened."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    local = root.removeprefix("file://").removeprefix("file:")
    base = os.path.dirname(local) if os.path.isfile(local) else local.split("://")[-1]
    rel = F.regexp_replace(F.col("path"), r"\A.*?\Q" + base.rstrip("/") + r"\E/", "")
    return df.select("path", rel.alias("rel"), "length")


def is_archive_place(ext: str, rel: str) -> bool:
    """BGI archives count in the root and in its folder `data` only."""
    return ext != ".arc" or re.fullmatch(r"(?:(?i:data)/)?[^/]*", rel) is not None


def engine_of(rel: str, length: int, max_file_bytes: int) -> str | None:
    """Engine of a loose script by its name; None for what is no script, too large, empty, or in a folder that is skipped."""
    *folders, name = rel.lower().split("/")
    ext = os.path.splitext(name)[1]
    if not length or any(f in SKIP_DIRS for f in folders):
        return None
    if name in NSCRIPT_NAMES:
        engine = "nscripter"
    elif ext in KAG_EXT:
        return "kirikiri" if length <= min(KAG_BYTES, max_file_bytes) else None
    elif ext in COMPILED_EXT:
        engine = "bgi"
    elif ext in SCRIPT_EXT:
        engine = "plaintext"
    else:
        return None
    return engine if length <= max_file_bytes else None


def in_skipped_dir(rel: Column) -> Column:
    return F.exists(F.slice(F.split(F.lower(rel), "/"), F.lit(1), F.size(F.split(rel, "/")) - 1), lambda d: d.isin(*SKIP_DIRS))


def generic_files(files: DataFrame, max_file_bytes: int = 16 << 20, max_total_bytes: int = 256 << 20) -> DataFrame:
    """Index rows for every file of 64 bytes or more that is no known resource, in path order up to the total limit."""
    some = files.filter(F.col("length").between(64, max_file_bytes) & ~clean.extension(F.col("rel")).isin(*SKIP_EXT)).select("path", "rel", "length")
    taken = prefix_budget(some, max_total_bytes, "path", "length")
    none = F.lit(None).cast("string")
    return taken.select(F.lit("generic").alias("engine"), F.col("rel").alias("virtual_path"), F.lit("").alias("container"), F.col("length").alias("size"), none.alias("error"), "path", none.alias("member"))

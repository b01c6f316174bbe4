"""Scripts and archives made from the driver tables, as inputs of the registered queries.

Text of the tables is turned into kana letter by letter, so the SQL of a query can say what
must come out without knowing how files are read. Writers of the archive formats live here;
the library itself only reads them.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..pdf.fonts import font_of
from ..sources import dsc
from ..sources.containers import XP3_MAGIC
from ..storage import scratch, ship

LATIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = "あいうえおかきくけこさしすせそたちつてとなにぬねのは"


def kana(c: Column) -> Column:
    """Latin letters as kana; everything else goes."""
    return F.regexp_replace(F.translate(c, LATIN, LETTERS * 2), "[^ぁ-ん]+", "")


def sql_kana(c: str) -> str:
    return f"regexp_replace(translate({c}, '{LATIN}', '{LETTERS * 2}'), '[^ぁ-ん]+', '', 'g')"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, body (kana) of the conversations."""
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", kana(F.col("text")).alias("body"))


SQL_TURNS = f"(SELECT conv_id, turn, {sql_kana('text')} AS body FROM conversations)"


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, text: the turns of a conversation as lines, after a first line that names it."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "body"))), lambda x: x["body"])
    return turns(spark, sf_dir).groupBy("conv_id").agg(F.concat(F.lit("はじまりのことばです。\n"), F.array_join(lines, "\n")).alias("text"))


SQL_SCRIPTS = f"(SELECT conv_id, 'はじまりのことばです。' || chr(10) || string_agg(body, chr(10) ORDER BY turn) AS text FROM {SQL_TURNS} GROUP BY conv_id)"


def put(path: str, data: bytes) -> None:
    """Write a file in the shared folder."""
    if "://" in path and not path.startswith("file://"):
        store, inner = pafs.FileSystem.from_uri(path)
        store.create_dir(os.path.dirname(inner), recursive=True)
        with store.open_output_stream(inner) as f:
            f.write(data)
        return
    path = path.removeprefix("file://")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def folder_of(files: DataFrame, label: str, build: Callable[[pd.DataFrame], bytes]) -> str:
    """A new folder with one file for each `rel` of a table, built from its rows by a task of its own."""
    spark = files.sparkSession
    ship(spark)
    root = scratch(spark, label)

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        rel = rows["rel"].iloc[0]
        put(f"{root}/{rel}", build(rows))
        return pd.DataFrame({"rel": [rel]})

    files.groupBy("rel").applyInPandas(write, "rel string").count()
    return root


def one_file(rows: pd.DataFrame) -> bytes:
    return bytes(rows["data"].iloc[0])


def encoded(text: str, number: int) -> bytes:
    """Bytes of a script: Shift-JIS for even numbers, else UTF-8."""
    return text.encode("cp932" if number % 2 == 0 else "utf-8")


# XP3


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<Q", len(body)) + body


def xp3(members: Iterable[tuple[str, bytes, str]], packed_index: bool = False) -> bytes:
    """An archive of (name, bytes, how): how is raw, zlib or hidden."""
    body, entries = bytearray(), b""
    start = len(XP3_MAGIC) + 8
    for name, data, how in members:
        key = zlib.adler32(data)
        raw = {"raw": lambda d=data: d, "zlib": lambda d=data: zlib.compress(d), "hidden": lambda d=data, k=key: d.translate(bytes(b ^ k & 0xFF for b in range(256)))}[how]()
        info = struct.pack("<IQQH", (how == "hidden") << 31, len(data), len(raw), len(name)) + name.encode("utf-16-le")
        segment = struct.pack("<IQQQ", how == "zlib", start + len(body), len(data), len(raw))
        entries += _chunk(b"File", _chunk(b"info", info) + _chunk(b"segm", segment) + _chunk(b"adlr", struct.pack("<I", key)))
        body += raw
    if packed_index:
        small = zlib.compress(entries)
        index = b"\x01" + struct.pack("<QQ", len(small), len(entries)) + small
    else:
        index = b"\x00" + struct.pack("<Q", len(entries)) + entries
    return XP3_MAGIC + struct.pack("<Q", start + len(body)) + bytes(body) + index


def inside_exe(archive: bytes) -> bytes:
    return b"MZ".ljust(64, b"\0") + archive


# NScripter


def _bits(items: Iterator[tuple[int, int]]) -> bytes:
    out, held, have = bytearray(), 0, 0
    for value, width in items:
        held, have = held << width | value, have + width
        while have >= 8:
            have -= 8
            out.append(held >> have & 0xFF)
            held &= (1 << have) - 1
    if have:
        out.append(held << 8 - have & 0xFF)
    return bytes(out)


def lzss(data: bytes) -> bytes:
    """Literals, and copies of 2 to 17 bytes from the last 256."""

    def items() -> Iterator[tuple[int, int]]:
        at = 0
        while at < len(data):
            low = max(0, at - 255)
            run = 0
            for n in (17, 8, 4, 2):
                place = data.rfind(data[at : at + n], low, at) if at + n <= len(data) else -1
                # A copy reads what was there before it began.
                if place >= 0 and place + n <= at:
                    run = n
                    break
            if run:
                yield from ((0, 1), ((239 + place) & 0xFF, 8), (run - 2, 4))
                at += run
            else:
                yield from ((1, 1), (data[at], 8))
                at += 1

    return _bits(items())


def nsa(members: Iterable[tuple[str, bytes, bool]], shift: int = 0) -> bytes:
    """An archive of (name, bytes, packed), its index after `shift` bytes."""
    index, body = b"", bytearray()
    members = list(members)
    for name, data, packed in members:
        raw = lzss(data) if packed else data
        index += name.encode("cp932") + b"\0" + struct.pack(">BIII", 2 if packed else 0, len(body), len(raw), len(data))
        body += raw
    return bytes(shift) + struct.pack(">HI", len(members), 6 + len(index)) + index + bytes(body)


def sar(members: Iterable[tuple[str, bytes]]) -> bytes:
    index, body = b"", bytearray()
    members = list(members)
    for name, data in members:
        index += name.encode("cp932") + b"\0" + struct.pack(">II", len(body), len(data))
        body += data
    return struct.pack(">HI", len(members), 6 + len(index)) + index + bytes(body)


# BGI


def arc(members: Iterable[tuple[str, bytes]], second: bool = False) -> bytes:
    """An archive of the first or the second layout."""
    members = list(members)
    magic, width, rest = (b"BURIKO ARC20", 96, 24) if second else (b"PackFile    ", 16, 8)
    index, body = b"", bytearray()
    for name, data in members:
        index += name.encode("cp932").ljust(width, b"\0") + struct.pack("<II", len(body), len(data)) + bytes(rest)
        body += data
    return magic + struct.pack("<I", len(members)) + index + bytes(body)


def dsc_packed(data: bytes, key: int = 0x1234ABCD) -> bytes:
    """A DSC member: short codes for bytes 0x40 to 0xBF, longer ones for the rest and for copies."""
    lengths = [8 if 0x40 <= s < 0xC0 else 9 if s < 384 else 0 for s in range(dsc.SYMBOLS)]
    codes, code, depth = {}, 0, 0
    for n, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code, depth = code << n - depth, n
        codes[symbol] = (code, n)
        code += 1
    items, count, at = [], 0, 0
    while at < len(data):
        place = data.rfind(data[at : at + 6], max(0, at - 4000), at)
        if place >= 0 and at - place >= 6 and at + 6 <= len(data):
            items += [codes[256 + 4], (at - place - 2, 12)]
            at += 6
        else:
            items.append(codes[data[at]])
            at += 1
        count += 1
    hidden = bytes((n + k) & 0xFF for n, k in zip(lengths, dsc.key_stream(key, dsc.SYMBOLS), strict=True))
    return dsc.MAGIC + struct.pack("<IIII", key, len(data), count, 0) + hidden + _bits(iter(items))


# Fonts and PDF


def font_file(characters: str) -> bytes:
    """A TrueType font: a box for each character (full width beyond ASCII), every fifth one composed of the first two."""
    chars = sorted(set(characters))
    box = lambda w: struct.pack(">5h", 1, 50, 0, w - 50, 700) + struct.pack(">HH", 3, 0) + bytes([1, 1, 1, 1]) + struct.pack(">4h", 50, w - 100, 0, 100 - w) + struct.pack(">4h", 0, 0, 700, 0)
    widths, shapes = [600], [box(600)]
    for k, c in enumerate(chars):
        w = 500 if c.isascii() else 1000
        widths.append(w)
        shapes.append(struct.pack(">5h", -1, 50, 0, w - 50, 700) + struct.pack(">HHbb", 0x22, 1, 0, 0) + struct.pack(">HHbb", 0x02, 2, 10, 0) if k % 5 == 4 else box(w))
    shapes = [s + bytes(-len(s) % 4) for s in shapes]
    places = [0]
    for s in shapes:
        places.append(places[-1] + len(s))
    n = len(shapes)
    groups = b"".join(struct.pack(">III", ord(c), ord(c), g + 1) for g, c in enumerate(chars))
    cmap = struct.pack(">HHHHI", 0, 1, 3, 10, 12) + struct.pack(">HHIII", 12, 0, 16 + len(groups), 0, len(chars)) + groups
    family = "Boxes".encode("utf-16-be")
    tables = {
        b"head": struct.pack(">IIIIHH16x4hHHhhh", 0x10000, 0, 0, 0x5F0F3CF5, 0, 1000, 0, 0, 1000, 700, 0, 8, 2, 1, 0),
        b"hhea": struct.pack(">IhhhH3h3h8xhH", 0x10000, 800, -200, 0, 1000, 0, 0, 1000, 1, 0, 0, 0, n),
        b"maxp": struct.pack(">IH", 0x10000, n) + bytes(26),
        b"hmtx": b"".join(struct.pack(">Hh", w, 0) for w in widths),
        b"cmap": cmap,
        b"glyf": b"".join(shapes),
        b"loca": struct.pack(f">{n + 1}I", *places),
        b"name": struct.pack(">HHH6H", 0, 1, 18, 3, 1, 0x409, 1, len(family), 0) + family,
    }
    return font_of(tables)


def pdf_text(data: bytes) -> list[list[tuple[float, str]]]:
    """The texts of each page with their sizes, found through page tree, contents and character map."""
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(?s)(?<=\n)(\d+) 0 obj\n(.*?)\nendobj\n", data)}
    stream = lambda o: zlib.decompress(o.split(b"stream\n", 1)[1].rsplit(b"\nendstream", 1)[0])
    refs = lambda b: [int(x) for x in re.findall(rb"(\d+) 0 R", b)]
    maps = next(o for o in objects.values() if b"/ToUnicode" in o)
    cmap = stream(objects[refs(re.search(rb"/ToUnicode (\d+ 0 R)", maps)[1])[0]]).decode()
    char = {g: bytes.fromhex(u).decode("utf-16-be") for g, u in re.findall(r"<([0-9A-F]{4})> <([0-9A-F]+)>\n", cmap)}
    tree = next(o for o in objects.values() if b"/Type /Pages" in o)
    pages = []
    for k in refs(re.search(rb"/Kids \[(.*?)\]", tree)[1]):
        drawn = b"".join(stream(objects[c]) for c in refs(re.search(rb"/Contents \[(.*?)\]", objects[k])[1]))
        found = re.findall(rb"/F1 ([\d.]+) Tf [\d.]+ [\d.]+ Td <([0-9A-F]*)> Tj", drawn)
        pages.append([(float(size), "".join(char[g] for g in re.findall("....", glyphs.decode()))) for size, glyphs in found])
    return pages

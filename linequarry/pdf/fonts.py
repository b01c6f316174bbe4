"""TrueType files: characters, widths, and a subset with the glyphs that are used."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np

#: What a subset keeps; characters are reached by glyph number, so no cmap is needed.
_KEPT = (b"head", b"hhea", b"hmtx", b"maxp", b"cvt ", b"fpgm", b"prep", b"glyf", b"loca")
EXTENSIONS = (".ttf", ".ttc", ".otf", ".otc")
#: A text that a font for scripts must be able to show, and how much of it.
PROBE = "的一是不了人我在有他这为之大来以个中上们。，！？「」『』"
LEAST_COVERAGE = 0.98

# Composite glyphs: what follows the flags of a component.
_WORDS, _SCALE, _MORE, _XY, _2X2 = 0x1, 0x8, 0x20, 0x40, 0x80


def face_offsets(data: bytes) -> list[int]:
    """Where the table directories of a font file or collection are."""
    if data[:4] == b"ttcf":
        n = struct.unpack_from(">I", data, 8)[0]
        return list(struct.unpack_from(f">{n}I", data, 12))
    return [0]


class Font:
    """One face of a font file."""

    def __init__(self, data: bytes, face: int = 0):
        places = face_offsets(data)
        if not 0 <= face < len(places):
            raise ValueError(f"face {face} of {len(places)}")
        self.data, at = data, places[face]
        kind = data[at : at + 4]
        if kind not in (b"\0\1\0\0", b"true", b"OTTO"):
            raise ValueError("not a TrueType or OpenType font")
        count = struct.unpack_from(">H", data, at + 4)[0]
        self.tables = {tag: (offset, size) for tag, _, offset, size in (struct.unpack_from(">4sIII", data, at + 12 + 16 * i) for i in range(count))}
        #: Outlines of the other kind (CFF) are embedded whole.
        self.is_cff = b"glyf" not in self.tables
        head = self.table(b"head")
        self.units = struct.unpack_from(">H", head, 18)[0]
        self.box = struct.unpack_from(">4h", head, 36)
        self.long_places = struct.unpack_from(">h", head, 50)[0] == 1
        self.ascent, self.descent = struct.unpack_from(">hh", self.table(b"hhea"), 4)
        self.n_glyphs = struct.unpack_from(">H", self.table(b"maxp"), 4)[0]
        n_wide = struct.unpack_from(">H", self.table(b"hhea"), 34)[0]
        widths = np.frombuffer(self.table(b"hmtx"), ">u2", n_wide * 2)[::2].astype(np.int64)
        self.widths = np.concatenate([widths, np.full(max(0, self.n_glyphs - n_wide), widths[-1] if n_wide else 0)])
        self.glyph_of = self._characters()

    @classmethod
    def load(cls, path: str | os.PathLike, face: int = 0) -> Font:
        return cls(Path(path).read_bytes(), face)

    def table(self, tag: bytes) -> bytes:
        if tag not in self.tables:
            raise ValueError(f"font without {tag.decode()}")
        offset, size = self.tables[tag]
        return self.data[offset : offset + size]

    @property
    def family(self) -> str:
        """Family name, '' if the font does not say."""
        if b"name" not in self.tables:
            return ""
        names = self.table(b"name")
        count, strings = struct.unpack_from(">HH", names, 2)
        found = {}
        for i in range(count):
            platform, _, language, what, size, at = struct.unpack_from(">6H", names, 6 + 12 * i)
            if what == 1:
                raw = names[strings + at : strings + at + size]
                found[platform != 3, language != 0x409] = raw.decode("utf-16-be" if platform in (0, 3) else "latin-1", "replace")
        return found[min(found)] if found else ""

    def _characters(self) -> dict[int, int]:
        """code point -> glyph, from the richest subtable that is understood."""
        cmap = self.table(b"cmap")
        n = struct.unpack_from(">H", cmap, 2)[0]
        out: dict[int, int] = {}
        for _, _, at in sorted((struct.unpack_from(">HHI", cmap, 4 + 8 * i) for i in range(n)), key=lambda e: struct.unpack_from(">H", cmap, e[2])[0]):
            out |= dict(self._subtable(cmap[at:]))
        return {c: g for c, g in out.items() if 0 < g < self.n_glyphs}

    @staticmethod
    def _subtable(t: bytes) -> Iterator[tuple[int, int]]:
        kind = struct.unpack_from(">H", t)[0]
        if kind == 0:
            yield from enumerate(t[6:262])
        elif kind == 4:
            n = struct.unpack_from(">H", t, 6)[0] // 2
            ends, starts, shifts, ranges = (np.frombuffer(t, ">u2", n, 14 + k) for k in (0, 2 * n + 2, 4 * n + 2, 6 * n + 2))
            for i in range(n):
                for c in range(int(starts[i]), int(ends[i]) + 1):
                    if c == 0xFFFF:
                        continue
                    if ranges[i] == 0:
                        yield c, (c + int(shifts[i])) & 0xFFFF
                        continue
                    at = 16 + 6 * n + 2 * i + int(ranges[i]) + 2 * (c - int(starts[i]))
                    if at + 2 <= len(t) and (g := struct.unpack_from(">H", t, at)[0]):
                        yield c, (g + int(shifts[i])) & 0xFFFF
        elif kind == 6:
            first, n = struct.unpack_from(">HH", t, 6)
            yield from zip(range(first, first + n), struct.unpack_from(f">{n}H", t, 10), strict=True)
        elif kind == 12:
            for i in range(struct.unpack_from(">I", t, 12)[0]):
                a, z, g = struct.unpack_from(">III", t, 16 + 12 * i)
                yield from zip(range(a, z + 1), range(g, g + z - a + 1), strict=True)

    def width(self, c: str, size: float) -> float:
        return float(self.widths[self.glyph_of.get(ord(c), 0)]) * size / self.units

    def text_width(self, text: str, size: float) -> float:
        return sum(self.width(c, size) for c in text)

    def missing(self, text: str) -> list[str]:
        """Characters without a glyph, sorted."""
        return sorted({c for c in text if ord(c) not in self.glyph_of})

    def coverage(self, text: str) -> float:
        """Share of characters with a glyph."""
        return sum(ord(c) in self.glyph_of for c in text) / max(1, len(text))

    def _places(self) -> np.ndarray:
        loca = self.table(b"loca")
        if self.long_places:
            return np.frombuffer(loca, ">u4", self.n_glyphs + 1).astype(np.int64)
        return np.frombuffer(loca, ">u2", self.n_glyphs + 1).astype(np.int64) * 2

    def closure(self, glyphs: Iterable[int]) -> set[int]:
        """Glyphs and all that they are composed of, with the one for missing characters."""
        places, glyf = self._places(), self.table(b"glyf")
        done, wait = set(), {0, *glyphs}
        while wait:
            g = wait.pop()
            done.add(g)
            shape = glyf[places[g] : places[g + 1]]
            if len(shape) < 10 or struct.unpack_from(">h", shape)[0] >= 0:
                continue
            at, flags = 10, _MORE
            while flags & _MORE:
                flags, part = struct.unpack_from(">HH", shape, at)
                at += 4 + (4 if flags & _WORDS else 2) + (2 if flags & _SCALE else 4 if flags & _XY else 8 if flags & _2X2 else 0)
                if part < self.n_glyphs and part not in done:
                    wait.add(part)
        return done

    def subset(self, glyphs: Iterable[int]) -> bytes:
        """A font file with the outlines of these glyphs only; glyph numbers stay."""
        if self.is_cff:
            raise ValueError("outlines of this kind cannot be cut")
        places, glyf = self._places(), self.table(b"glyf")
        keep = self.closure(glyphs)
        shapes = [glyf[places[g] : places[g + 1]] if g in keep else b"" for g in range(self.n_glyphs)]
        shapes = [s + bytes(-len(s) % 4) for s in shapes]
        new = np.concatenate([[0], np.cumsum([len(s) for s in shapes])])
        head = bytearray(self.table(b"head"))
        struct.pack_into(">I", head, 8, 0)
        struct.pack_into(">h", head, 50, 1)
        made = {tag: self.table(tag) for tag in _KEPT if tag in self.tables} | {b"head": bytes(head), b"glyf": b"".join(shapes), b"loca": new.astype(">u4").tobytes()}
        return font_of(made)


def _checksum(data: bytes) -> int:
    return int(np.frombuffer(data + bytes(-len(data) % 4), ">u4").sum(dtype=np.uint64)) & 0xFFFFFFFF


def font_of(tables: dict[bytes, bytes]) -> bytes:
    """A font file of these tables, with its checksums."""
    n = len(tables)
    power = n.bit_length() - 1
    out = struct.pack(">IHHHH", 0x00010000, n, 16 << power, power, 16 * n - (16 << power))
    at, entries, body = 12 + 16 * n, b"", b""
    for tag in sorted(tables):
        data = tables[tag]
        entries += struct.pack(">4sIII", tag, _checksum(data), at + len(body), len(data))
        body += data + bytes(-len(data) % 4)
    whole = bytearray(out + entries + body)
    where = next(struct.unpack_from(">I", entries, 16 * i + 8)[0] for i in range(n) if entries[16 * i : 16 * i + 4] == b"head")
    struct.pack_into(">I", whole, where + 8, (0xB1B0AFBA - _checksum(bytes(whole))) & 0xFFFFFFFF)
    return bytes(whole)


@dataclass(frozen=True)
class Face:
    path: str
    face: int
    name: str
    size: int


def font_folders() -> list[Path]:
    """Where the system keeps fonts."""
    windows = [Path(os.environ.get("WINDIR", r"C:\Windows")) / "Fonts"]
    if os.environ.get("LOCALAPPDATA"):
        windows.append(Path(os.environ["LOCALAPPDATA"]) / "Microsoft" / "Windows" / "Fonts")
    return [p for p in (*windows, Path("/usr/share/fonts"), Path("/usr/local/share/fonts"), Path.home() / ".fonts", Path("/Library/Fonts"), Path("/System/Library/Fonts")) if p.is_dir()]


def find_fonts(folders: Iterable[Path] | None = None, probe: str = "", least: float = LEAST_COVERAGE) -> list[Face]:
    """Faces that can be read and that cover the probe, by name."""
    out = []
    for folder in font_folders() if folders is None else folders:
        for path in sorted(p for p in Path(folder).rglob("*") if p.suffix.lower() in EXTENSIONS):
            try:
                data = path.read_bytes()
                for face in range(len(face_offsets(data))):
                    font = Font(data, face)
                    if font.coverage(probe) >= least or not probe:
                        out.append(Face(str(path), face, font.family or path.stem, len(data)))
            except (OSError, ValueError, struct.error):
                # A file that is no font that we read.
                continue
    return sorted(out, key=lambda f: (f.name.lower(), f.path.lower(), f.face))

"""The file: pages are written as they come, the font and the page tree at the end."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path
from typing import BinaryIO

from .fonts import Font
from .layout import A4, Layout, Page

#: Entries in one block of a character map, by the format.
_BLOCK = 100


def _number(x: float) -> str:
    return f"{x:.3f}".rstrip("0").rstrip(".")


def _string(text: str) -> str:
    return "<FEFF" + text.encode("utf-16-be", "replace").hex().upper() + ">"


class Objects:
    """Numbered objects of a file, written in any order."""

    def __init__(self, out: BinaryIO):
        self.out, self.places = out, {}
        self.at = 0
        self._write(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n")

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def reserve(self) -> int:
        self.places[len(self.places) + 1] = 0
        return len(self.places)

    def put(self, body: str, number: int | None = None) -> int:
        number = number or self.reserve()
        self.places[number] = self.at
        self._write(f"{number} 0 obj\n{body}\nendobj\n".encode("latin-1"))
        return number

    def stream(self, data: bytes, extra: str = "") -> int:
        number, packed = self.reserve(), zlib.compress(data)
        self.places[number] = self.at
        self._write(f"{number} 0 obj\n<< /Length {len(packed)} /Filter /FlateDecode{extra} >>\nstream\n".encode("latin-1") + packed + b"\nendstream\nendobj\n")
        return number

    def close(self, root: int, info: int) -> None:
        table, n = self.at, len(self.places) + 1
        rows = "".join(f"{self.places[k]:010d} 00000 n \n" for k in range(1, n))
        self._write(f"xref\n0 {n}\n0000000000 65535 f \n{rows}trailer\n<< /Size {n} /Root {root} 0 R /Info {info} 0 R >>\nstartxref\n{table}\n%%EOF\n".encode("latin-1"))


class Text:
    """Turns pages into drawing commands and remembers the glyphs that they use."""

    def __init__(self, font: Font):
        self.font = font
        self.used: dict[int, str] = {}
        self.missing: set[str] = set()

    def _glyphs(self, text: str) -> str:
        out = []
        for c in text:
            g = self.font.glyph_of.get(ord(c))
            if g is None:
                self.missing.add(c)
                continue
            self.used.setdefault(g, c)
            out.append(f"{g:04X}")
        return "".join(out)

    def commands(self, page: Page) -> bytes:
        out = []
        for x1, y1, x2, y2, width, colour in page.rules:
            out.append(f"{' '.join(map(_number, colour))} RG {_number(width)} w {_number(x1)} {_number(y1)} m {_number(x2)} {_number(y2)} l S")
        for x, y, text, size, colour in page.texts:
            if glyphs := self._glyphs(text):
                out.append(f"BT {' '.join(map(_number, colour))} rg /F1 {_number(size)} Tf {_number(x)} {_number(y)} Td <{glyphs}> Tj ET")
        return ("\n".join(out) + "\n").encode("latin-1")


def _to_unicode(used: dict[int, str]) -> bytes:
    head = "/CIDInit /ProcSet findresource begin\n12 dict begin\nbegincmap\n/CIDSystemInfo << /Registry (Adobe) /Ordering (UCS) /Supplement 0 >> def\n/CMapName /Adobe-Identity-UCS def\n/CMapType 2 def\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n"
    rows = [f"<{g:04X}> <{c.encode('utf-16-be').hex().upper()}>" for g, c in sorted(used.items())]
    blocks = [rows[i : i + _BLOCK] for i in range(0, len(rows), _BLOCK)]
    return (head + "".join(f"{len(b)} beginbfchar\n" + "\n".join(b) + "\nendbfchar\n" for b in blocks) + "endcmap\nCMapName currentdict /CMap defineresource pop\nend\nend\n").encode()


def _put_font(objects: Objects, font: Font, used: dict[int, str]) -> int:
    scale = 1000 / font.units
    name = "LINEQY+" + (re.sub(r"[^A-Za-z0-9._-]+", "_", font.family).strip("_") or "Font")
    if font.is_cff:
        file, kind, key = objects.stream(font.data, " /Subtype /OpenType"), "CIDFontType0", "FontFile3"
    else:
        data = font.subset(used)
        file, kind, key = objects.stream(data, f" /Length1 {len(data)}"), "CIDFontType2", "FontFile2"
    box = " ".join(_number(v * scale) for v in font.box)
    descriptor = objects.put(
        f"<< /Type /FontDescriptor /FontName /{name} /Flags 4 /FontBBox [{box}] /ItalicAngle 0 /Ascent {_number(font.ascent * scale)} /Descent {_number(font.descent * scale)} "
        f"/CapHeight {_number(font.ascent * scale)} /StemV 80 /{key} {file} 0 R >>"
    )
    widths = " ".join(f"{g} [{_number(int(font.widths[g]) * scale)}]" for g in sorted(used))
    to_gid = "" if font.is_cff else " /CIDToGIDMap /Identity"
    inner = objects.put(f"<< /Type /Font /Subtype /{kind} /BaseFont /{name} /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /FontDescriptor {descriptor} 0 R /DW 1000 /W [{widths}]{to_gid} >>")
    unicode = objects.stream(_to_unicode(used))
    return objects.put(f"<< /Type /Font /Subtype /Type0 /BaseFont /{name} /Encoding /Identity-H /DescendantFonts [{inner} 0 R] /ToUnicode {unicode} 0 R >>")


@dataclass(frozen=True)
class PdfResult:
    path: Path
    pages: int
    lines: int
    scenes: int
    missing: list[str]
    font_name: str
    font_path: str
    size: int


def write(path: Path, rows: Iterable[tuple[str, str, str]], layout: Layout, font_path: str = "") -> PdfResult:
    """Write (speaker, text, source) rows as a PDF; ValueError and no file if there are none."""
    part = path.with_name(path.name + ".part")
    text = Text(layout.font)
    try:
        with part.open("wb") as f:
            objects = Objects(f)
            contents = [objects.stream(text.commands(page)) for page in layout.pages(rows)]
            if not layout.total.lines:
                raise ValueError("there are no lines to write")
            footers = [objects.stream(text.commands(layout.footer(k + 1))) for k in range(len(contents))] if layout.o.footers else [None] * len(contents)
            font, tree = _put_font(objects, layout.font, text.used), objects.reserve()
            pages = []
            for content, footer in zip(contents, footers, strict=True):
                drawn = f"[{content} 0 R{f' {footer} 0 R' if footer else ''}]"
                pages.append(objects.put(f"<< /Type /Page /Parent {tree} 0 R /MediaBox [0 0 {_number(A4[0])} {_number(A4[1])}] /Resources << /Font << /F1 {font} 0 R >> >> /Contents {drawn} >>"))
            objects.put(f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{p} 0 R' for p in pages)}] >>", tree)
            root = objects.put(f"<< /Type /Catalog /Pages {tree} 0 R >>")
            info = objects.put(f"<< /Title {_string(layout.title)} /Creator {_string('linequarry')} >>")
            objects.close(root, info)
        part.replace(path)
    finally:
        part.unlink(missing_ok=True)
    t = layout.total
    return PdfResult(path, t.pages, t.lines, t.scenes, sorted(text.missing), layout.font.family or Path(font_path).stem, font_path, path.stat().st_size)

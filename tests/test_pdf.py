"""Fonts, line breaking and the PDF file."""

import re
import struct

import pytest

from linequarry import cli, sinks
from linequarry.pdf.fonts import Font, face_offsets, find_fonts
from linequarry.pdf.layout import NOT_FIRST, NOT_LAST, PdfOptions, wrap
from linequarry.plans import fixtures as fx

TEXT = fx.LETTERS + "。、「」（）" + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,-:0123456789|/" + "場景场：｜条台词脚本个引擎—·剧"


@pytest.fixture(scope="module")
def font():
    return Font(fx.font_file(TEXT))


def test_wrap(font):
    assert wrap("  ", font, 10, 100) == [] and wrap("あい", font, 10, 0) == ["あい"] and wrap("あい", font, 10, 100) == ["あい"]
    text = "「あいう、えおか。」きくけこ（さし）すせそ。" * 7
    pieces = wrap(text, font, 10, 73)
    assert "".join(pieces) == text and all(font.text_width(p, 10) <= 73 + 20 for p in pieces)
    assert sum(p[0] in NOT_FIRST for p in pieces[1:]) <= text.count("。」") and not any(p[-1] in NOT_LAST for p in pieces[:-1])
    words = wrap("hello brave new world of wrapping", font, 10, 60)
    assert " ".join(words).split() == "hello brave new world of wrapping".split()
    assert "".join(wrap("x" * 100, font, 10, 60)) == "x" * 100


def test_fonts(font, tmp_path):
    assert font.family == "Boxes" and font.missing("aあ漢") == ["漢"] and font.coverage("aあ漢漢") == 0.5
    used = {font.glyph_of[ord(c)] for c in "あいう"}
    small = font.subset(used)
    assert struct.unpack(">I", small[:4])[0] == 0x10000
    # The sum over a whole font file, with its own entry, is a fixed value.
    words = struct.unpack(f">{len(small) // 4}I", small[: len(small) // 4 * 4])
    assert sum(words) & 0xFFFFFFFF == 0xB1B0AFBA
    composed = next(g for g in range(5, font.n_glyphs) if len(font.closure([g])) > 2)
    assert font.closure([composed]) == {0, 1, 2, composed}
    (tmp_path / "a.ttf").write_bytes(fx.font_file(TEXT))
    (tmp_path / "broken.ttf").write_bytes(b"nothing")
    assert [f.name for f in find_fonts([tmp_path])] == ["Boxes"]
    assert find_fonts([tmp_path], probe="漢字") == []
    for data in (b"", b"abc", b"\0\1\0\0" + bytes(20)):
        with pytest.raises((ValueError, struct.error)):
            Font(data)
    assert face_offsets(b"ttcf" + struct.pack(">IIII", 0x10000, 2, 20, 40)) == [20, 40]


def rows(spark, n, sources=1):
    made = [(i + 1, ["葵", "", "abc"][i % 3], fx.LETTERS[: 5 + i % 20] * (1 + i % 4) + "。", f"d/s{i * sources // n}.ks", "e", "") for i in range(n)]
    return spark.createDataFrame(made, "index long, speaker string, text string, source string, engine string, container string")


def test_file(spark, tmp_path):
    path = tmp_path / "f.ttf"
    path.write_bytes(fx.font_file(TEXT))
    options = PdfOptions(title="t", font_path=str(path))
    made = sinks.export_pdf(tmp_path / "a.pdf", rows(spark, 120, 3), options)
    data = made.path.read_bytes()
    assert made.scenes == 3 and made.lines == 120 and made.missing == ["葵"] and made.size == len(data)
    table = int(re.search(rb"startxref\n(\d+)\n%%EOF", data)[1])
    places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n", data[table:])]
    assert all(re.match(rb"%d 0 obj\n" % (k + 1), data[p:]) for k, p in enumerate(places))
    for m in re.finditer(rb"/Length (\d+)[^>]*>>\nstream\n", data):
        assert data[m.end() + int(m[1]) :].startswith(b"\nendstream")
    pages = fx.pdf_text(data)
    assert len(pages) == made.pages > 3 and all(p[-1][1] == f"— {k} / {made.pages} —" for k, p in enumerate(pages, 1))
    assert sinks.export_pdf(tmp_path / "b.pdf", rows(spark, 240, 3), options).pages > made.pages
    each = sinks.export_pdf(tmp_path / "c.pdf", rows(spark, 6, 6), PdfOptions(title="t", font_path=str(path), scene_per_page=True))
    flat = sinks.export_pdf(tmp_path / "d.pdf", rows(spark, 6, 6), PdfOptions(title="t", font_path=str(path), scene_headings=False, scene_per_page=True))
    assert each.pages >= 6 and flat.pages == 1
    with pytest.raises(ValueError):
        sinks.export_pdf(tmp_path / "e.pdf", rows(spark, 6).limit(0), options)
    assert not (tmp_path / "e.pdf").exists() and not list(tmp_path.glob("*.part"))
    with pytest.raises(FileNotFoundError):
        sinks.export_pdf(tmp_path / "e.pdf", rows(spark, 6), PdfOptions(font_path="/nowhere.ttf"))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a.ks").write_text("葵「あいうえお」\nかきくけこ。\n", encoding="utf-8")
    (tmp_path / "f.ttf").write_bytes(fx.font_file(TEXT + "葵"))
    run = lambda *more: cli.main(["scan", str(tmp_path / "g"), "-f", "pdf", "-o", str(tmp_path / "o.pdf"), *more], spark)
    assert run("--pdf-font", str(tmp_path / "f.ttf"), "--pdf-title", "abc", "--pdf-scene-per-page", "--pdf-no-source", "--quiet") == 0
    assert any("あいうえお" in t for p in fx.pdf_text((tmp_path / "o.pdf").read_bytes()) for _, t in p)
    assert run("--pdf-font", str(tmp_path / "missing.ttf")) == 3
    assert cli.main(["scan", "--pdf-list-fonts"], spark) in (0, 2)

"""Archives and the whole scan over folders built here."""

import io
import json
import struct
import zlib

import pytest

from linequarry import cli, sinks
from linequarry.options import CleanOptions, ScanOptions
from linequarry.plans.scan import scan
from linequarry.sources import containers


def chunk(tag, body):
    return tag + struct.pack("<Q", len(body)) + body


def xp3(members, packed_index=False):
    head = containers.XP3_MAGIC
    body, files = b"", b""
    for name, data, packed, key in members:
        plain = data if key is None else data.translate(bytes(b ^ key & 0xFF for b in range(256)))
        raw = zlib.compress(plain) if packed else plain
        info = struct.pack("<IQQH", 0 if key is None else 1 << 31, len(data), len(raw), len(name)) + name.encode("utf-16-le")
        segment = struct.pack("<IQQQ", int(packed), len(head) + 8 + len(body), len(data), len(raw))
        files += chunk(b"File", chunk(b"info", info) + chunk(b"segm", segment) + chunk(b"adlr", struct.pack("<I", zlib.adler32(data) if key is None else key)))
        body += raw
    z = zlib.compress(files)
    index = b"\x01" + struct.pack("<QQ", len(z), len(files)) + z if packed_index else b"\x00" + struct.pack("<Q", len(files)) + files
    return head + struct.pack("<Q", len(head) + 8 + len(body)) + body + index


def nsa(members, base=0):
    names = b"".join(n.encode("cp932") + b"\0" + struct.pack(">BIII", m, at, len(d), size) for n, m, at, d, size in members)
    return bytes(base) + struct.pack(">HI", len(members), 6 + len(names)) + names + b"".join(d for *_, d, _ in members)


def bits(items):
    out, acc, n = bytearray(), 0, 0
    for value, width in items:
        acc, n = acc << width | value, n + width
        while n >= 8:
            n -= 8
            out.append(acc >> n & 0xFF)
    return bytes(out) + (bytes([acc << 8 - n & 0xFF]) if n else b"")


def test_xp3_members():
    data = "文章です。\n".encode("cp932")
    for packed_index in (False, True):
        f = io.BytesIO(xp3([("a.ks", data, False, None), ("d\\b.ks", data * 3, True, None), ("c.ks", data, False, zlib.adler32(data))], packed_index))
        got = {m.name: m.read() for m in containers.xp3_members(f)}
        assert got == {"a.ks": data, "d/b.ks": data * 3, "c.ks": data}
    inside = b"MZ" + bytes(14) + xp3([("a.ks", data, False, None)])
    assert [m.read() for m in containers.xp3_members(io.BytesIO(inside))] == [data]
    with pytest.raises(ValueError):
        list(containers.xp3_members(io.BytesIO(b"nothing")))


def test_nscripter_archives():
    text = b"abcabcabc"
    packed = bits([(1, 1), (97, 8), (1, 1), (98, 8), (1, 1), (99, 8), (0, 1), (239, 8), (4, 4)])
    assert containers.lzss(packed, 9) == text
    for base in (0, 2):
        got = {m.name: m.read() for m in containers.nsa_members(io.BytesIO(nsa([("a.txt", 0, 0, b"plain", 5), ("b\\c.txt", 2, 5, packed, 9), ("d.bmp", 1, 5 + len(packed), b"z", 1)], base)))}
        assert got == {"a.txt": b"plain", "b/c.txt": text}
    names = b"x.txt\0" + struct.pack(">II", 0, 3)
    assert [(m.name, m.read()) for m in containers.sar_members(io.BytesIO(struct.pack(">HI", 1, 6 + len(names)) + names + b"abc"))] == [("x.txt", b"abc")]


@pytest.mark.parametrize("magic, width, skip", [(b"PackFile    ", 16, 8), (b"BURIKO ARC20", 96, 24)])
def test_arc(magic, width, skip):
    row = b"s.ws2".ljust(width, b"\0") + struct.pack("<II", 0, 4) + bytes(skip)
    bad = b"t".ljust(width, b"\0") + struct.pack("<II", 0, 400) + bytes(skip)
    f = io.BytesIO(magic + struct.pack("<I", 2) + row + bad + b"data")
    assert [(m.name, m.read()) for m in containers.arc_members(f)] == [("s.ws2", b"data")]


@pytest.fixture
def game(tmp_path):
    root = tmp_path / "game"
    (root / "scenario").mkdir(parents=True)
    (root / "data.xp3").write_bytes(xp3([("s/one.ks", '[name text="太郎"]\nおはよう、みんな。[r]\n'.encode("cp932"), False, None), ("two.ks", "花子「はい、そうです。」\n".encode("cp932"), True, None), ("p.png", b"\x89PNG", False, None)]))
    (root / "patch.xp3").write_bytes(xp3([("s/one.ks", "太郎「大家早上好。」\n".encode("utf-8"), True, None)], True))
    (root / "nscript.dat").write_bytes(bytes(b ^ 0x84 for b in '*define\ngame\n*start\nmesbox "x"\nこれは本文です。\n'.encode("cp932")))
    (root / "scenario" / "loose.ks").write_bytes("外に置いた台本です。\n".encode("cp932"))
    (root / "broken.nsa").write_bytes(b"\0\1junk")
    return root


def test_scan(spark, game, tmp_path):
    out = scan(spark, str(game))
    out.lines, out.scripts = out.lines.cache(), out.scripts.cache()
    assert dict(out.engines)["kirikiri"] == 100
    rows = [(r["index"], r["speaker"], r["text"], r["source"]) for r in out.lines.orderBy("index").collect()]
    assert rows == [(1, "花子", "はい、そうです。", "data.xp3/two.ks"), (2, "太郎", "大家早上好。", "patch.xp3/s/one.ks"), (3, "", "外に置いた台本です。", "scenario/loose.ks"), (4, "", "これは本文です。", "nscript.dat")]
    report = {r["virtual_path"]: r for r in out.scripts.collect()}
    assert "patch.xp3/s/one.ks" in report["data.xp3/s/one.ks"]["note"] and report["patch.xp3/s/one.ks"]["line_count"] == 1
    every = scan(spark, str(game), ScanOptions(override_archives=False))
    assert every.lines.count() == 5
    chinese = scan(spark, str(game), ScanOptions(clean=CleanOptions(chinese_only=True)))
    assert [r["text"] for r in chinese.lines.collect()] == ["大家早上好。"]
    for fmt in ("txt", "csv", "tsv", "json", "jsonl", "template"):
        path = sinks.export(tmp_path, out, fmt, name=fmt)
        text = path.read_text(encoding="utf-8-sig")
        assert "大家早上好。" in text
        if fmt == "json":
            assert len(json.loads(text)["lines"]) == 4 and json.loads(text)["scripts"]
        if fmt == "jsonl":
            assert [json.loads(x)["index"] for x in text.splitlines()] == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        sinks.export(tmp_path, out, "docx")


def test_generic_fallback(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "mystery.bin").write_bytes(bytes(range(1, 9)) * 40 + b"\0" + "「隠れた文章がここにあります。」".encode("cp932") + bytes(64))
    out = scan(spark, str(tmp_path / "g"))
    assert out.warnings and any("隠れた文章" in r["text"] for r in out.lines.collect())
    (tmp_path / "empty").mkdir()


def test_large_loose_script_and_limits(spark, tmp_path):
    root = tmp_path / "big"
    root.mkdir()
    (root / "a.txt").write_text("これは大きな台本です。\n" * 600_000, encoding="utf-8")
    (root / "b.txt").write_text("次の台本です。\n", encoding="utf-8")
    assert (root / "a.txt").stat().st_size > 18 << 20
    whole = scan(spark, str(root))
    assert sorted(r["text"] for r in whole.lines.collect()) == ["これは大きな台本です。", "次の台本です。"] and whole.warnings == []
    less = scan(spark, str(root), ScanOptions(max_total_bytes=1 << 20))
    assert [r["text"] for r in less.lines.collect()] == ["次の台本です。"] and "1 scripts were left out" in less.warnings[0]
    one = scan(spark, str(root / "b.txt"))
    assert [r["source"] for r in one.lines.collect()] == ["b.txt"]


def test_engines_from_outside(spark, tmp_path, monkeypatch):
    from linequarry.plans import registry

    monkeypatch.setattr(registry, "MODULES", dict(registry.MODULES))
    (tmp_path / "own_engine.py").write_text(
        "def score(files):\n    return 99\n"
        "def scripts(spark, root):\n    return spark.createDataFrame([('x/one.txt', 'x', bytearray('外から来た台本です。'.encode()), 30, None)], 'virtual_path string, container string, data binary, size long, error string')\n"
    )
    (tmp_path / "bad_engine.py").write_text("raise RuntimeError('broken')\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    registry.register("own", "Own", "own_engine")
    registry.register("bad", "Bad", "bad_engine")
    assert {k: (a, e) for k, _, a, e in registry.listed()}["bad"] == (False, "RuntimeError: broken")
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a.ks").write_text("中の台本です。\n", encoding="utf-8")
    out = scan(spark, str(tmp_path / "g"))
    assert out.best_engine == "own" and sorted(r["text"] for r in out.lines.collect()) == ["中の台本です。", "外から来た台本です。"]


def test_dsc():
    from linequarry.plans import fixtures as fx
    from linequarry.sources import dsc

    for data in (b"", b"a", bytes(range(256)) * 9, "葵「はい」".encode("cp932") * 300):
        packed = fx.dsc_packed(data)
        assert dsc.unpack(packed) == data
        if data:
            for broken in (packed[:40], packed[: len(packed) * 3 // 4], packed[:20] + b"\xff\xff\0\0" + packed[24:]):
                with pytest.raises(ValueError):
                    dsc.unpack(broken)


def test_packed_script_counts_by_its_extension(spark):
    from linequarry.plans import registry
    from linequarry.sources import dsc

    files = [("program", "KrKr2.exe"), ("archive", "arc.nsa"), ("kag", "a.ks"), ("bare", "d"), ("deep", "x/d.dsc"), ("dsc", "D.DSC"), ("ws2", "m.ws2"), ("text", "t.txt"), ("two", "a.dsc"), ("two", "a.exe")]
    listing = spark.createDataFrame([(game, rel, 100, bytearray(dsc.MAGIC)) for game, rel in files], "game string, rel string, length long, head binary")
    got = {r["game"]: r["score"] for r in registry.scores(listing, ["game"]).filter("key = 'bgi'").collect()}
    assert got == {"dsc": 15, "ws2": 20, "text": 15, "two": 15}


def test_cli(spark, game, tmp_path, capsys):
    assert cli.main(["scan", str(game), "-o", str(tmp_path / "o.csv"), "-f", "csv", "--quiet"], spark) == 0
    assert (tmp_path / "o.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    assert cli.main(["scan", str(tmp_path / "nowhere")], spark) == 2
    assert cli.main(["engines"], spark) == 0
    assert "kirikiri" in capsys.readouterr().out


def test_incremental(spark, tmp_path):
    from linequarry.streaming.incremental import append_new

    root = tmp_path / "in"
    root.mkdir()
    (root / "a.txt").write_text("最初の台本です。\n", encoding="utf-8")
    run = lambda: append_new(spark, str(root), str(tmp_path / "out"), str(tmp_path / "cp"))
    run()
    (root / "b.txt").write_text("次の台本です。\n", encoding="utf-8")
    run()
    run()
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["最初の台本です。", "次の台本です。"]

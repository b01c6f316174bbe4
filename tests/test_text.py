"""Functions and operators on rows of our own."""

import random

import pytest
from pyspark.sql import functions as F

from linequarry.functions import binary, clean, codec, dialogue
from linequarry.operators import kag, lines, speakers, versions
from linequarry.options import CleanOptions


def extracted(spark, text, **options):
    opts = CleanOptions(**options)
    df = spark.createDataFrame([(text,)], "line string").withColumn("p", dialogue.prepared(F.col("line"), opts))
    return [(r["speaker"], r["text"]) for r in df.withColumn("e", dialogue.extract(F.col("p"), opts)).first()["e"]]


@pytest.mark.parametrize(
    "text, options, want",
    [
        ("太郎「行こう」", {}, [("太郎", "行こう")]),
        ("「あのね」「うん、なに」", {}, [("", "あのね"), ("", "うん、なに")]),
        ("太郎：行こう", {}, [("太郎", "行こう")]),
        ("[r]空が青い[p]", {}, [("", "空が青い")]),
        ("すごい！！！！！！", {}, [("", "すごい！！")]),
        ("only ascii here", {}, []),
        ("only ascii here", {"drop_ascii_only": False, "require_cjk": False}, [("", "only ascii here")]),
        ("goto 終わり", {}, []),
        ("空", {}, []),
        ("空が青い", {"keep_narration": False}, []),
        ("ひらがなです", {"chinese_only": True}, []),
        ("天气很好", {"chinese_only": True}, [("", "天气很好")]),
        (None, {}, []),
    ],
)
def test_extract(spark, text, options, want):
    assert extracted(spark, text, **options) == want


def test_tracking_follows_order_whatever_the_partitions(spark):
    rows = [("s", i, "", t) for i, t in enumerate(['[name text="太郎"]', "おはよう。", "次郎「やあ」", "またね。", "[name text='花子']", "さようなら。"])]
    want = [(1, "太郎", "おはよう。"), (2, "次郎", "やあ"), (3, "太郎", "またね。"), (5, "花子", "さようなら。")]
    schema = "script_id string, line_no int, hint string, line string"
    for n in (1, 5):
        random.Random(n).shuffle(rows)
        out = speakers.dialogue_rows(spark.createDataFrame(rows, schema).repartition(n), CleanOptions()).collect()
        assert sorted((r["line_no"], r["speaker"], r["text"]) for r in out) == want
    label = speakers.dialogue_rows(spark.createDataFrame(rows, schema), CleanOptions(track_speakers=False, narration_speaker="語り手")).collect()
    assert {r["speaker"] for r in label} == {"語り手", "次郎"}


def test_skip_block_equals_a_fold(spark):
    rnd = random.Random(4)
    kinds = ["[iscript]", "@ignore", "[endscript]", "@endignore", "[endignore]", "かな", "行"]
    scripts = {f"s{k}": [rnd.choice(kinds) for _ in range(rnd.randint(1, 12))] for k in range(40)}
    rows = [(s, i, t) for s, ts in scripts.items() for i, t in enumerate(ts)]
    got = {(r["script_id"], r["line_no"]) for r in kag.skipped_lines(spark.createDataFrame(rows, "script_id string, line_no int, line string"), ["script_id"]).collect()}
    want = set()
    for s, ts in scripts.items():
        block = None
        for i, t in enumerate(ts):
            word = t.strip("[]@")
            if block is None and word in ("iscript", "ignore"):
                block = word
                want.add((s, i))
            elif block is not None:
                want.add((s, i))
                if word == {"iscript": "endscript", "ignore": "endignore"}[block]:
                    block = None
    assert got == want


def test_line_break_rule(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab\n\r\x0b\x0c\x1c\x85  ") for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    got = {}
    for r in lines.explode_lines(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).collect():
        got.setdefault(r["id"], {})[r["line_no"]] = r["line"]
    for i, t in enumerate(texts):
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == t.splitlines()


def test_greedy_budget_equals_a_fold(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(1, 40)) for i in range(200)]
    used, want = 0, []
    for i, s in rows:
        if used + s <= 500:
            used += s
            want.append(i)
    got = versions.greedy_budget(spark.createDataFrame(rows, "ord int, size int").repartition(5), 500, "ord").collect()
    assert sorted(r["ord"] for r in got) == want


def test_override_ties_keep_the_first(spark):
    rows = [(1, "data.xp3", "a.ks"), (2, "patch.xp3", "A.ks"), (3, "", "b.ks"), (4, "data.xp3", "b.ks"), (5, "patch.xp3", "a.ks")]
    df = spark.createDataFrame(rows, "id int, container string, inner string")
    out = {r["id"]: r["kept"] for r in versions.resolve_overrides(df, [F.col("id")], label="id").collect()}
    assert out == {1: False, 2: True, 3: True, 4: False, 5: False}


@pytest.mark.parametrize("encoding, text", [("utf-8", "短い"), ("cp932", "今日はとても良い天気ですね。"), ("cp936", "今天天气很好，我们去散步吧。"), ("utf-16", "今日はとても良い天気ですね。"), ("utf-8-sig", "漢字")])
def test_decode_round_trip(encoding, text):
    assert codec.decode_auto(text.encode(encoding))[0] == text


def test_forced_encoding():
    assert codec.decode_with("漢字".encode("cp950"), "cp950") == "漢字"
    with pytest.raises(ValueError):
        codec.decode_with(b"x", "no-such-codec")


def test_binary_scan():
    rnd = random.Random(99)
    noise = lambda n: bytes(rnd.randrange(256) for _ in range(n))
    text = "「ここに文章があります。」"
    assert any("ここに文章があります" in s for s in binary.scan_strings(noise(512) + b"\0" + text.encode("cp932") + b"\0" + noise(512)))
    assert any("ここに文章があります" in s for s in binary.scan_strings(bytes(64) + text.encode("utf-16-le") + bytes(64)))
    assert len(binary.scan_strings(noise(4096))) < 8
    assert binary.compiled_lines(b"\x01\x02" + "これは台詞です。".encode("cp932") + b"\0") == ["これは台詞です。"]


def test_scalar_helpers(spark):
    row = spark.range(1).select(clean.human_size(F.lit(10)).alias("a"), clean.human_size(F.lit(2048)).alias("b"), clean.extension(F.lit("a/B.KS")).alias("c"), clean.safe_relative(F.lit("/r/a\\b"), "/r").alias("d"), clean.display(F.lit(""), F.lit("x")).alias("e")).first()
    assert tuple(row) == ("10 B", "2.0 KB", ".ks", "a/b", "x")

"""Registered queries of text rules over lines made from the conversations.

Every turn becomes a line (or a few) of a known shape, picked by its number. The SQL beside
a query knows the shape and says what must come out; it shares no pattern with the library.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chars, clean, dialogue
from ..operators import kag, lines, nscript, speakers, versions
from ..options import CleanOptions
from . import fixtures as fx

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def _turns(spark, sf_dir, shapes: int):
    """conv_id, turn, body and k, the number of the shape."""
    return fx.turns(spark, sf_dir).withColumn("k", ((F.col("conv_id") + F.col("turn")) % shapes).cast("int"))


def _sql_turns(shapes: int) -> str:
    return f"(SELECT *, (conv_id + turn) % {shapes} AS k FROM {fx.SQL_TURNS})"


def _shaped(df, shapes: list):
    """The column `line`: shape k of the body."""
    b = F.col("body")
    made = [s(b) for s in shapes]
    out = F.when(F.col("k") == 0, made[0])
    for k, m in enumerate(made[1:], 1):
        out = out.when(F.col("k") == k, m)
    return df.withColumn("line", out)


def _cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _case(expected: list[str]) -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN {e}" for k, e in enumerate(expected)) + " END"


@query(f"SELECT conv_id, turn, {_case(['body', 'body', 'body', chr(39) + ' < y ' + chr(39) + ' || body', chr(39) + '[日本]' + chr(39) + ' || body || ' + chr(39) + '[/ x]' + chr(39)])} AS text FROM {_sql_turns(5)}")
def strip_bracket_tags(spark, sf_dir):
    """bracket tags, angle tags, control escapes; what only looks like them stays."""
    rows = _shaped(_turns(spark, sf_dir, 5), [lambda b: _cat('[name text="乙"]', b, "[/ruby]"), lambda b: _cat("<br>", b, "</color>"), lambda b: _cat(b, "\\n{0x12}\\t"), lambda b: _cat("[bad tag<3>]", " < y ", b), lambda b: _cat("[日本]", b, "[/ x]")])
    return rows.select("conv_id", "turn", clean.strip_tags(F.col("line")).alias("text"))


@query(f"""SELECT conv_id, turn, trim({_case(["body || ' ' || body", "body || '！！' || body || '。。'", "body || 'z'", "body || 'が'", "'!!!? ' || body", "body || ' ' || body || '〜〜〜'"])}) AS text FROM {_sql_turns(6)}""")
def whitespace_normalise(spark, sf_dir):
    """blanks, zero-width characters, repeated marks, composition."""
    rows = _shaped(_turns(spark, sf_dir, 6), [lambda b: _cat("  ", b, "　　", b, "\t"), lambda b: _cat(b, "！！！！！", b, "。。。。"), lambda b: _cat("﻿", b, "​z\r"), lambda b: _cat(b, "が"), lambda b: _cat("!!!? ", b), lambda b: _cat(b, " \n", b, "〜〜〜")])
    return rows.select("conv_id", "turn", clean.normalize_text(F.col("line")).alias("text"))


@query(f"SELECT count(*) FILTER (k > 0 AND body <> '') AS kana_lines, CAST(count(*) FILTER (k > 0 AND body <> '') AS DOUBLE) / count(*) AS ratio FROM {_sql_turns(3)}")
def kana_ratio(spark, sf_dir):
    """A5, F9."""
    return lines.kana_share(_shaped(_turns(spark, sf_dir, 3), [lambda b: _cat("漢字。abc"), lambda b: b, lambda b: _cat("漢", b)]), "line")


_POINTS = "(SELECT event_id, 8192 + (event_id * 53) % 47104 AS p FROM events)"


@query(f"""
SELECT event_id,
  p BETWEEN 12352 AND 12687 OR p BETWEEN 12784 AND 13055 OR p BETWEEN 13312 AND 19903 OR p BETWEEN 19968 AND 40959 OR p BETWEEN 44032 AND 55215 AS cjk_letter,
  p BETWEEN 12352 AND 12543 OR p BETWEEN 12784 AND 12799 AS kana,
  p BETWEEN 12352 AND 12543 OR p BETWEEN 12784 AND 12799 AS full_kana,
  p BETWEEN 13312 AND 19903 OR p BETWEEN 19968 AND 40959 AS ideograph,
  p IN (12290, 12289, 12539, 12300, 12301, 12302, 12303, 12296, 12297, 12298, 12299, 12304, 12305, 8230, 8229, 12316, 8212, 8213, 12288) AS punct
FROM {_POINTS}
""")
def char_class(spark, sf_dir):
    """Code points from U+2000 up to the surrogates, by number."""
    p = 8192 + (F.col("event_id") * 53) % 47104
    s = F.decode(F.unhex(F.lpad(F.hex(p), 4, "0")), "UTF-16BE")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", s.alias("s")).select(
        "event_id", chars.has_cjk_letter(F.col("s")).alias("cjk_letter"), chars.has_kana(F.col("s")).alias("kana"), chars.has_full_kana(F.col("s")).alias("full_kana"),
        chars.has_ideograph(F.col("s")).alias("ideograph"), chars.has_cjk_punct(F.col("s")).alias("punct"),
    )


_ENDS = ["", " x", "(x)", "=1", ".x", "\tx", "x", "：か"]
_PREFIXES = list(dict.fromkeys(clean.COMMANDS))
_STARTED = f"""(SELECT event_id, CASE event_id % 11 WHEN 7 THEN 'ふつう' || event_id WHEN 8 THEN '</a>' WHEN 9 THEN 'see http://a' WHEN 10 THEN '   '
  ELSE CASE WHEN event_id % 2 = 0 THEN p ELSE upper(p) END || e END AS s
  FROM (SELECT event_id, ([{", ".join("'" + p + "'" for p in _PREFIXES)}])[(event_id // 8) % {len(_PREFIXES)} + 1] AS p, ([{", ".join("'" + e + "'" for e in _ENDS)}])[event_id % 8 + 1] AS e FROM events))"""


@query(f"""
SELECT event_id, trim(s) = '' OR starts_with(s, '</') OR contains(s, '://') OR len(list_filter([{", ".join("'" + p.lower() + "'" for p in _PREFIXES)}],
  lambda p: starts_with(lower(s), p) AND (length(p) > 4 OR length(s) = length(p) OR substr(s, length(p) + 1, 1) IN (' ', chr(9), '(', '=', '.')))) > 0 AS command FROM {_STARTED}
""")
def command_prefix(spark, sf_dir):
    """Every prefix in either case with every kind of end."""
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))
    i = F.col("event_id")
    p = pick(_PREFIXES, F.floor(i / 8) % len(_PREFIXES))
    s = F.when(i % 11 == 7, _cat("ふつう", i.cast("string"))).when(i % 11 == 8, "</a>").when(i % 11 == 9, "see http://a").when(i % 11 == 10, "   ").otherwise(F.concat(F.when(i % 2 == 0, p).otherwise(F.upper(p)), pick(_ENDS, i % 8)))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", clean.looks_like_command(s).alias("command"))


_SHAPES = ["body", "body || ';=;='", "'(((' || body", "'((' || body || ')'", "'goto ' || body", "'abc def'", "'{{{x' || body", "'!?' || body"]


@query(f"""
SELECT conv_id, turn, length(s) BETWEEN 2 AND 400 AND body <> '' AND k <> 4 AND k <> 5 AND (length(s) - length(translate(s, '{{}}()[]<>=;:|&!$%^~`', '')) - length(s) + length(replace(s, chr(92), ''))) <= 0.3 * length(s)
  AND abs(len(string_split(s, '(')) - len(string_split(s, ')'))) <= 1 AND abs(len(string_split(s, '{{')) - len(string_split(s, '}}'))) <= 1 AS dialogue
FROM (SELECT *, {_case(_SHAPES)} AS s FROM {_sql_turns(8)})
""")
def dialogue_shape(spark, sf_dir):
    """P1, P3 with default options."""
    rows = _shaped(_turns(spark, sf_dir, 8), [lambda b: b, lambda b: _cat(b, ";=;="), lambda b: _cat("(((", b), lambda b: _cat("((", b, ")"), lambda b: _cat("goto ", b), lambda b: F.lit("abc def"), lambda b: _cat("{{{x", b), lambda b: _cat("!?", b)])
    return rows.select("conv_id", "turn", clean.dialogue_shape(F.col("line"), CleanOptions()).alias("dialogue"))


_PATHS = ["data{}.xp3/a/b.ks", "Patch{}.XP3/a/b.ks", "scenario/loose{}.ks", "sub/data{}.xp3/a.ks", "arc{}.nsa/x\\y.txt", "nscript{}.dat", "a{}.arc/s.ws2", "b{}.pak", "x{}.TJS", "readme{}", "d{}.mes", "q{}.nscript", "a.b/{}.ASD"]
_SQL_PATHS = f"(SELECT event_id, replace(([{", ".join("'" + x + "'" for x in _PATHS)}])[event_id % {len(_PATHS)} + 1], '{{}}', CAST(event_id AS VARCHAR)) AS p FROM events)"


def _paths(spark, sf_dir):
    i = F.col("event_id")
    p = F.replace(F.element_at(F.array(*[F.lit(x) for x in _PATHS]), (i % len(_PATHS) + 1).cast("int")), F.lit("{}"), i.cast("string"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", p.alias("p"))


@query(f"""
SELECT event_id, CASE WHEN packed THEN head ELSE '' END AS container, CASE WHEN packed THEN substr(q, length(head) + 2) ELSE q END AS inner_path FROM (
  SELECT event_id, q, string_split(q, '/')[1] AS head, contains(q, '/') AND list_contains(['xp3', 'nsa', 'sar', 'arc', 'ypf', 'pfs', 'pak', 'g00'], lower(string_split(string_split(q, '/')[1], '.')[-1])) AS packed
  FROM (SELECT event_id, replace(p, chr(92), '/') AS q FROM {_SQL_PATHS}))
""")
def split_path(spark, sf_dir):
    """R5."""
    s = versions.split_virtual_path(F.col("p"))
    return _paths(spark, sf_dir).select("event_id", s["container"].alias("container"), s["inner"].alias("inner_path"))


@query(f"""
SELECT event_id, CASE lower(string_split(p, '.')[-1]) WHEN 'ks' THEN 'kirikiri' WHEN 'tjs' THEN 'kirikiri' WHEN 'asd' THEN 'kirikiri' WHEN 'ws2' THEN 'bgi' WHEN 'mes' THEN 'bgi' WHEN 'nscript' THEN 'nscripter' ELSE 'plaintext' END AS extractor FROM {_SQL_PATHS}
""")
def ext_route(spark, sf_dir):
    """R9, F19."""
    return _paths(spark, sf_dir).select("event_id", versions.extractor(F.lit("plaintext"), F.col("p")).alias("extractor"))


@query("SELECT event_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) ELSE printf('%.1f GB', n / 1073741824) END AS shown, CASE WHEN event_id % 2 = 0 THEN 'a/' || event_id ELSE '/other/' || event_id END AS rel FROM (SELECT event_id, event_id * event_id * 640 AS n FROM events)")
def sizes_and_paths(spark, sf_dir):
    """F20."""
    n = (F.col("event_id") * F.col("event_id") * 640).cast("long")
    path = F.concat(F.when(F.col("event_id") % 2 == 0, "/root\\game/a/").otherwise("/other/"), F.col("event_id").cast("string"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", clean.human_size(n).alias("shown"), clean.safe_relative(path, "/root/game/").alias("rel"))


@query("""
WITH RECURSIVE t AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS ord FROM documents),
f AS (SELECT 0::BIGINT AS ord, 0::BIGINT AS used, false AS kept UNION ALL
  SELECT t.ord, CASE WHEN f.used + t.n_chars <= 1000000 THEN f.used + t.n_chars ELSE f.used END, f.used + t.n_chars <= 1000000 FROM f JOIN t ON t.ord = f.ord + 1)
SELECT doc_id, n_chars FROM f JOIN t USING (ord) WHERE kept
""")
def greedy_budget(spark, sf_dir):
    """Documents in order while they fit into a million characters; later smaller ones may still fit."""
    return versions.greedy_budget(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars"), 1_000_000, "doc_id", "n_chars")


# What a line says. Bodies of 2 to 300 letters, so that every shape is a line of dialogue.
def _said(spark, sf_dir, shapes):
    return _turns(spark, sf_dir, shapes).filter(F.char_length("body").between(2, 300))


def _sql_said(shapes: int) -> str:
    return f"(SELECT * FROM {_sql_turns(shapes)} WHERE length(body) BETWEEN 2 AND 300)"


@query(f"""
SELECT conv_id, turn, 0 AS sub_no, CASE k WHEN 0 THEN '悠斗' WHEN 2 THEN '葵' WHEN 5 THEN '甲' ELSE '' END AS speaker,
  CASE k WHEN 0 THEN body || '、先輩。' WHEN 1 THEN body WHEN 2 THEN body WHEN 3 THEN '私は『' || body || '』を' WHEN 4 THEN body || '！！' WHEN 5 THEN '一' || body WHEN 6 THEN body || 'です' END AS text
FROM {_sql_said(8)} WHERE k < 7
UNION ALL SELECT conv_id, turn, 1, '', CASE k WHEN 1 THEN body || 'と' ELSE body || '四' END FROM {_sql_said(8)} WHERE k IN (1, 5)
""")
def dialogue_extract(spark, sf_dir):
    """Name and quotation, several quotations, a colon, inner quotations, narration, quoted code, ASCII."""
    made = [
        lambda b: _cat("悠斗「", b, "、先輩。」"), lambda b: _cat("「", b, "」と「", b, "と」"), lambda b: _cat("葵：", b), lambda b: _cat("「私は『", b, "』を」と"), lambda b: _cat(b, "！！！！！"),
        lambda b: _cat("甲「一", b, "」乙「", b, "四」"), lambda b: _cat('print("', b, 'です")'), lambda b: F.lit("hello world"),
    ]
    rows = _shaped(_said(spark, sf_dir, 8), made).withColumn("p", dialogue.prepared(F.col("line"), CleanOptions()))
    rows = rows.withColumn("e", dialogue.extract(F.col("p"), CleanOptions())).select("conv_id", "turn", F.posexplode("e").alias("sub_no", "x"))
    return rows.select("conv_id", "turn", "sub_no", F.col("x.speaker").alias("speaker"), F.col("x.text").alias("text"))


@query(f"SELECT conv_id, turn, CASE k WHEN 0 THEN '悠斗' WHEN 3 THEN '葵' WHEN 6 THEN 'nameさん' ELSE '' END AS speaker, CASE WHEN k = 5 THEN '「' || body || '」' ELSE body END AS text FROM {_sql_said(7)}")
def speaker_split(spark, sf_dir):
    """By quotation or colon; placeholder names are none."""
    made = [lambda b: _cat("悠斗「", b, "」"), lambda b: _cat("name「", b, "」"), lambda b: _cat("「", b, "」"), lambda b: _cat(" 葵 ： ", b), lambda b: _cat("　", b, " "), lambda b: _cat("『「", b, "」』"), lambda b: _cat("nameさん「", b, "」")]
    s = dialogue.split_speaker(F.col("line"))
    return _shaped(_said(spark, sf_dir, 7), made).select("conv_id", "turn", s["speaker"].alias("speaker"), s["text"].alias("text"))


@query(f"SELECT conv_id, turn, CASE k WHEN 0 THEN substr(body, 1, 12) WHEN 1 THEN '葵' WHEN 2 THEN substr(body, 1, 12) WHEN 4 THEN 'b' WHEN 5 THEN substr(body, 1, 5) ELSE '' END AS speaker FROM {_sql_said(8)}")
def speaker_declaration(spark, sf_dir):
    """Attributes and positional names of tags that declare, other tags."""
    short = lambda b, n=12: F.substring(b, 1, n)
    made = [
        lambda b: _cat('[name text="', short(b), '"]', b), lambda b: _cat("[chara_mod name=葵 face=a]", b), lambda b: _cat("[name ", short(b), "]"), lambda b: _cat('[bg name="', short(b), '"]'),
        lambda b: _cat("[chara_show facename=a name=b]", b), lambda b: _cat("[NAME value='", short(b, 5), "']", b), lambda b: _cat("[name]", b), lambda b: b,
    ]
    return _shaped(_said(spark, sf_dir, 8), made).select("conv_id", "turn", dialogue.declaration(F.col("line")).alias("speaker"))


# Scripts: the turns of a conversation in order, a few lines each.
_NUMBERED = f"(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM {_sql_said(1)})"


def _numbered(spark, sf_dir):
    return _said(spark, sf_dir, 1).withColumn("n", (F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1).cast("int"))


def _lines_of(rows, parts: list):
    """script_id, line_no, line: len(parts) lines for each turn; a null part is an empty line."""
    made = F.array(*[F.coalesce(p, F.lit("")) for p in parts])
    out = rows.select(F.col("conv_id").alias("script_id"), "n", F.posexplode(made).alias("at", "line"))
    return out.select("script_id", (F.col("n") * len(parts) + F.col("at")).cast("int").alias("line_no"), "line")


@query(f"""
SELECT conv_id AS script_id, CAST(2 * n + 1 AS INTEGER) AS line_no, CASE WHEN n < 2 THEN 'かたり' ELSE (['いちろう', 'はなこ', 'たろう'])[((n - 2) // 3) % 3 + 1] END AS speaker, body || '。' AS text FROM {_NUMBERED}
""")
def bare_name_lead(spark, sf_dir):
    """Every third turn follows a line that only names who speaks; before the first of them the label of narration stands."""
    name = F.element_at(F.array(F.lit("いちろう"), F.lit("はなこ"), F.lit("たろう")), (F.floor((F.col("n") - 2) / 3) % 3 + 1).cast("int"))
    lead = F.when((F.col("n") >= 2) & (F.col("n") % 3 == 2), name)
    rows = _lines_of(_numbered(spark, sf_dir), [lead, F.concat("body", F.lit("。"))]).withColumn("hint", F.lit(""))
    return speakers.dialogue_rows(rows, CleanOptions(guess_bare_speakers=True, narration_speaker="かたり")).select("script_id", "line_no", "speaker", "text")


@query(f"SELECT conv_id AS script_id, n AS line_no, CASE WHEN n % 2 = 0 THEN '葵' ELSE '' END AS speaker, body AS text FROM (SELECT conv_id, CAST(n AS INTEGER) AS n, body FROM {_NUMBERED})")
def dialogue_of_text(spark, sf_dir):
    """Whole texts, one a conversation, to rows of dialogue."""
    line = F.when(F.col("n") % 2 == 0, _cat("葵「", F.col("body"), "」")).otherwise(F.col("body"))
    texts = _numbered(spark, sf_dir).withColumn("line", line).groupBy(F.col("conv_id").alias("script_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\r\n").alias("text"))
    return speakers.dialogue_of_text(texts, CleanOptions(track_speakers=False)).select("script_id", "line_no", "speaker", "text")


@query(f"""SELECT conv_id, turn, {_case(["'[笑] ' || body", "body || 'c'", "'x[' || body", "body || 'y'", "body", "'「' || body || '」'", "'[x]' || body"])} AS text FROM {_sql_turns(7)}""")
def kag_strip(spark, sf_dir):
    """escaped brackets, quotes inside tags, tags without an end."""
    made = [lambda b: _cat("[[笑] ", b), lambda b: _cat('[if exp="a]b"]', b, "c[endif]"), lambda b: _cat("x[", b), lambda b: _cat(b, "[a b=']']y"), lambda b: b, lambda b: _cat("[r][l]「", b, "」"), lambda b: _cat("[[x]", b, "[p]")]
    return _shaped(_turns(spark, sf_dir, 7), made).select("conv_id", "turn", kag.strip_kag_tags(F.col("line")).alias("text"))


@query(f"""
SELECT conv_id AS script_id, CAST(4 * n + 1 AS INTEGER) AS line_no, (['あおい', 'みどり'])[(n // 4) % 2 + 1] AS hint, CASE n % 4 WHEN 0 THEN body ELSE body || body END AS line FROM {_NUMBERED} WHERE n % 4 IN (0, 3)
""")
def skip_block(spark, sf_dir):
    """Declarations, two kinds of skipped blocks (each ends at its own mark), continued lines, comments, labels, commands."""
    n, b = F.col("n"), F.col("body")
    name = F.when(F.floor(n / 4) % 2 == 0, "あおい").otherwise("みどり")
    one = F.when(n % 4 == 0, _cat('[name text="', name, '"]')).when(n % 4 == 1, "[iscript]").when(n % 4 == 2, "@ignore").otherwise("*label")
    two = F.when(n % 4 == 3, _cat(b, "[r]\\")).otherwise(b)
    three = F.when(n % 4 == 0, _cat("; ", b)).when(n % 4 == 1, "[endignore]").when(n % 4 == 2, "[endscript]").otherwise(b)
    four = F.when(n % 4 == 0, _cat("@bg ", b)).when(n % 4 == 1, "[endscript]").when(n % 4 == 2, "@endignore").otherwise(_cat("// ", b))
    return kag.kag_candidates(_lines_of(_numbered(spark, sf_dir), [one, two, three, four]), ["script_id"]).select("script_id", "line_no", "hint", "line")


@query(f"""
SELECT conv_id AS script_id, CAST(5 * n + 1 AS INTEGER) AS line_no, part AS part_no, CASE part WHEN 0 THEN body ELSE '次' END AS line FROM {_NUMBERED}, (VALUES (0), (1)) p(part)
UNION ALL SELECT conv_id, CAST(5 * n + 3 AS INTEGER), 0, '「' || body || '」' FROM {_NUMBERED}
""")
def nscript_lines(spark, sf_dir):
    """Labels, commands with quoted text, comments, lines of text."""
    b = F.col("body")
    rows = _lines_of(_numbered(spark, sf_dir), [F.lit("*label"), _cat('mesbox "', b, '","a","次"'), F.lit(";x"), _cat("「", b, "」"), F.lit("goto *a")])
    return nscript.nscript_candidates(rows, ["script_id"]).select("script_id", "line_no", "part_no", "line")

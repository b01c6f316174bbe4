"""Registered queries of the text engine over the driver tables or inline rows, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chars, clean, dialogue
from ..operators import kag, lines, nscript, speakers, versions
from ..options import CleanOptions
from . import file_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: RE2 spells the blank class of chars.BLANK the same way as Java.
def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '\A{chars.RE_BLANK}+|{chars.RE_BLANK}+\z', '', 'g')"


_BREAK = chars.LINE_BREAK
_SPLIT = f"regexp_split_to_array(text, '{_BREAK}')"
_LINES = f"CASE WHEN {_SPLIT}[-1] = '' THEN {_SPLIT}[:-2] ELSE {_SPLIT} END"


# Lines, cleaning, predicates over the driver tables.
@_query(f"""
WITH l AS (SELECT doc_id, unnest(range(len({_LINES}))) AS line_no, unnest({_LINES}) AS line FROM documents),
s AS (SELECT doc_id, line_no, {_strip("line")} AS line FROM l),
d AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) AS k FROM s WHERE length(line) BETWEEN 2 AND 400)
SELECT row_number() OVER (ORDER BY doc_id, line_no) AS index, doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM d WHERE k = 1
""")
def line_explode(spark, sf_dir):
    """The distinct trimmed lines of 2 to 400 characters, first place wins, numbered in order."""
    rows = lines.explode_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = rows.withColumn("line", chars.strip(F.col("line"))).filter(F.char_length("line").between(2, 400))
    first = versions.first_wins(rows, ["line"], [F.col("doc_id"), F.col("line_no")])
    return lines.dense_index(first, ["doc_id"], ["line_no"]).select("index", "doc_id", "line_no", "line")


@_query(f"SELECT page_id, regexp_replace(html, '{clean.ANGLE_TAG}', '', 'g') AS text FROM pages")
def strip_angle_tags(spark, sf_dir):
    """F7 over real tags."""
    return _table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", clean.ANGLE_TAG, "").alias("text"))


def _sql_normal(c: str) -> str:
    c = rf"regexp_replace(regexp_replace({c}, '{chars.RE_ZERO_WIDTH}|\r', '', 'g'), '[ \t\n\x{{3000}}\x{{A0}}]+', ' ', 'g')"
    # RE2 has no back-references: one replacement for each mark.
    for p in clean.REPEATED:
        c = f"regexp_replace({c}, '{re.escape(p)}{{4,}}', '{p}{p}', 'g')"
    return _strip(f"nfc_normalize({c})")


@_query(f"SELECT doc_id, {_sql_normal('text')} AS text FROM documents")
def normalise_documents(spark, sf_dir):
    """F6 over whole documents."""
    return _table(spark, sf_dir, "documents").select("doc_id", clean.normalize_text(F.col("text")).alias("text"))


def _symbols(c: str) -> str:
    return f"(length({c}) - length(translate({c}, '{clean.CODE_SYMBOLS}', '')))"


@_query(f"SELECT doc_id, CASE WHEN length(text) = 0 THEN 1.0 ELSE CAST({_symbols('text')} AS DOUBLE) / length(text) END AS ratio FROM documents")
def symbol_ratio(spark, sf_dir):
    """P3."""
    return _table(spark, sf_dir, "documents").select("doc_id", clean.symbol_ratio(F.col("text")).cast("double").alias("ratio"))


# Deduplication, versions, ordering.
@_query("SELECT doc_id, lang, text FROM (SELECT *, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def first_wins_dedupe(spark, sf_dir):
    """(lang, text) stands for (speaker, text)."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return lines.dedupe_in(docs, [], [F.col("doc_id")], speaker="lang")


@_query("SELECT doc_id, source, text FROM (SELECT *, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def script_dedupe(spark, sf_dir):
    """A source stands for a script."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text").withColumn("speaker", F.lit(""))
    return lines.dedupe_in(docs, ["source"], [F.col("doc_id")]).drop("speaker")


@_query("SELECT doc_id, md5(text) AS inner_path, source, row_number() OVER w = 1 AS kept, first_value(doc_id) OVER w AS winner FROM documents WINDOW w AS (PARTITION BY md5(text) ORDER BY lower(source) DESC, doc_id)")
def override_winner(spark, sf_dir):
    """The source stands for the archive, the text's digest for the inner path."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("inner_path"), "source")
    out = versions.resolve_overrides(docs, [F.col("doc_id")], inner="inner_path", container="source", label="doc_id")
    return out.select("doc_id", "inner_path", "source", "kept", "winner")


@_query("SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) AS s FROM documents) WHERE s <= 500000")
def prefix_budget(spark, sf_dir):
    """S3: stops at the first row that would overflow."""
    return versions.prefix_budget(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), 500_000, "doc_id", "n_chars")


@_query("SELECT doc_id, text FROM documents WHERE n_chars <= 2000 AND doc_id NOT IN (SELECT conv_id FROM conversations)")
def anti_plaintext(spark, sf_dir):
    """Documents that no conversation covers, up to a size."""
    docs = versions.within_size(_table(spark, sf_dir, "documents"), 2000, "n_chars").select("doc_id", "text")
    return versions.without_paths(docs, _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")), "doc_id")


@_query(
    """SELECT user_id, event_id, event_type, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS scene FROM
    (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS c FROM events)"""
)
def scenes_islands(spark, sf_dir):
    """Runs of equal event types of a user."""
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return lines.scenes(events, ["ts", "event_id"], "event_type", ["user_id"]).select("user_id", "event_id", "event_type", "scene")


@_query("SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN CAST(event_id AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events")
def carry_forward(spark, sf_dir):
    """The last click of a user so far."""
    events = _table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type") == "click", F.col("event_id").cast("string")))
    return speakers.carry_forward(events.select("event_id", "user_id", "ts", "v"), "v", ["user_id"], ["ts", "event_id"]).select("event_id", "carried")


@_query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'tion the')")
def search_contains_ci(spark, sf_dir):
    """R19."""
    docs = _table(spark, sf_dir, "documents").withColumn("speaker", F.lit(""))
    return lines.search(docs, "TION the").select("doc_id", "source")


@_query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100")
def topk_preview(spark, sf_dir):
    """R20."""
    return lines.preview(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.col("n_chars").desc(), "doc_id"], 100)


@_query("SELECT source, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY source")
def positions_by_source(spark, sf_dir):
    """R18, with the lists of positions told by their lengths and ends."""
    docs = _table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("index"))
    p = F.col("positions")
    lists = lines.positions_by_source(docs, 64).select("source", F.size(p).cast("long").alias("n"), p[0].alias("low"), F.element_at(p, -1).alias("high"))
    return lists.groupBy("source").agg(F.sum("n").alias("n"), F.min("low").alias("first_id"), F.max("high").alias("last_id"))


# Aggregates, projections.
@_query("SELECT count(*) AS scripts, count(*) FILTER (line_count > 0) AS scripts_with_text, CAST(sum(line_count) AS BIGINT) AS lines, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT d.doc_id, d.n_chars AS size, count(c.turn) AS line_count FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id GROUP BY ALL)")
def summary_aggs(spark, sf_dir):
    """A1 to A4: documents as scripts, turns as lines."""
    counts = lines.script_counts(_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")), ["doc_id"])
    report = _table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("size")).join(counts, "doc_id", "left").fillna(0, ["line_count"])
    return lines.totals(report)


@_query("SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch")
def charset(spark, sf_dir):
    """A8."""
    return lines.charset(_table(spark, sf_dir, "documents"))


@_query("SELECT row_number() OVER (ORDER BY conv_id, turn) AS index, role AS speaker, text, '' AS translation, CAST(conv_id AS VARCHAR) AS source, CASE WHEN coalesce(role, '') <> '' THEN concat_ws('：', role, text) ELSE text END AS display FROM conversations")
def template_projection(spark, sf_dir):
    """K3, F21."""
    rows = lines.dense_index(_table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"])
    return rows.select("index", F.col("role").alias("speaker"), "text", F.lit("").alias("translation"), F.col("conv_id").cast("string").alias("source"), clean.display(F.col("role"), F.col("text")).alias("display"))


_FIRST = "(SELECT *, min(doc_id) OVER (PARTITION BY md5(text)) AS winner FROM documents)"


@_query(f"""
SELECT source, CASE WHEN doc_id = winner THEN '' ELSE 'overridden by ' || winner || ', skipped' END AS note, count(*) AS n, CAST(sum(CASE WHEN doc_id = winner THEN n_chars ELSE 0 END) AS BIGINT) AS line_count FROM {_FIRST} GROUP BY ALL
""")
def report_rows(spark, sf_dir):
    """A report of kept and overridden scripts, where equal texts are versions of one script and the first wins."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("inner"), F.lit("").alias("container"), F.col("n_chars").alias("line_count"), F.lit("").alias("note"))
    found = versions.resolve_overrides(docs, [F.col("doc_id")], label="doc_id")
    columns = ["source", "line_count", "note"]
    rows = lines.with_overridden(found.filter("kept").select(*columns), found.filter("not kept").select(*columns, F.col("winner").cast("string").alias("winner")))
    return rows.groupBy("source", "note").agg(F.count("*").alias("n"), F.sum("line_count").alias("line_count"))


for _more in (text_queries, file_queries):
    QUERIES |= _more.QUERIES
    ORACLES |= _more.ORACLES

"""Lines: exploding texts, dense numbering, deduplication, scenes, search, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chars
from . import ordered, versions


def explode_lines(df: DataFrame, text: str = "text", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """One row per line as str.splitlines() cuts them; numbers start at 0."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), chars.LINE_BREAK, -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(parts).alias(line_no, line))


def dedupe_in(df: DataFrame, scope: list[str], order: list[Column], speaker: str = "speaker", text: str = "text") -> DataFrame:
    """The first row of each (scope, speaker, text); an empty scope is the whole table."""
    return versions.first_wins(df, [*scope, speaker, text], order)


def dense_index(df: DataFrame, group: list[str], inside: list[str], index: str = "index", start: int = 1) -> DataFrame:
    """Numbers from `start` without gaps, ordered by group, then by the order inside a group.

    Rows are dealt to ranges of the whole order, so neither the table nor one group has to fit a task.
    """
    return ordered.numbered(df, [*group, *inside], index, start)


def scenes(df: DataFrame, order: list[str], source: str = "source", scope: list[str] | None = None) -> DataFrame:
    """scene: number of the run of equal sources in order; a source that comes back is a new scene."""
    if scope:
        return ordered.run_numbers_in(df, scope, order, source, "scene")
    return ordered.run_numbers(df, order, source, "scene")


def search(df: DataFrame, query: str, source: str | None = None) -> DataFrame:
    """Rows of a source whose text or speaker contains the query, whatever the case."""
    q = F.lower(F.lit(query))
    hit = F.contains(F.lower("text"), q) | F.contains(F.lower("speaker"), q)
    return df.filter(hit if source is None else (F.col("source") == source) & hit)


def positions_by_source(df: DataFrame, chunk: int = 100_000) -> DataFrame:
    """source, part, positions: its line numbers in order; a row holds those of one range of `chunk` numbers."""
    return df.groupBy("source", F.floor(F.col("index") / chunk).alias("part")).agg(F.array_sort(F.collect_list("index")).alias("positions"))


def preview(df: DataFrame, order: list, limit: int = 20_000) -> DataFrame:
    """The first rows in a total order."""
    return df.orderBy(*order).limit(limit)


def script_counts(lines: DataFrame, key: list[str]) -> DataFrame:
    """line_count of each script."""
    return lines.groupBy(*key).agg(F.count("*").alias("line_count"))


def totals(report: DataFrame) -> DataFrame:
    """scripts, scripts_with_text, total lines and bytes of a report."""
    return report.agg(
        F.count("*").alias("scripts"),
        F.count_if(F.col("line_count") > 0).alias("scripts_with_text"),
        F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
    )


def kana_share(lines: DataFrame, text: str = "text") -> DataFrame:
    """How many lines still hold kana, and their share."""
    n = F.count_if(chars.has_kana(F.col(text)))
    return lines.agg(n.alias("kana_lines"), (n / F.greatest(F.lit(1), F.count("*"))).alias("ratio"))


def charset(df: DataFrame, text: str = "text") -> DataFrame:
    """Distinct characters of a column, with counts."""
    return df.select(F.explode(F.split(text, "")).alias("ch")).filter("ch != ''").groupBy("ch").agg(F.count("*").alias("n"))


def with_overridden(kept: DataFrame, losers: DataFrame) -> DataFrame:
    """Report rows of kept scripts, then those of overridden ones with a note and no lines."""
    note = F.format_string("overridden by %s, skipped", F.col("winner"))
    return kept.unionByName(losers.withColumn("note", note).withColumn("line_count", F.lit(0).cast("long")).select(*kept.columns))

"""Totals along one order over the whole table, without a task that sees all of it.

Rows are dealt to ranges of the order and numbered inside them while they are written;
what crosses ranges (counts, sums, last values) is one row per range, which the driver
adds up and sends back as a small table. The number of ranges is that of the shuffle
partitions, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import staged

_PLACE = (1 << 33) - 1


def ranged(df: DataFrame, order: list) -> DataFrame:
    """The rows with _range (rising with the order) and _place (from 0 inside a range)."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = staged(placed, "ranges")
    return rows.withColumn("_range", F.shiftright("_id", 33).cast("int")).withColumn("_place", F.col("_id").bitwiseAND(F.lit(_PLACE))).drop("_id")


def _with_offsets(rows: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    table = rows.sparkSession.createDataFrame(offsets, "_range int, _before long")
    # One row per range: bounded by the number of shuffle partitions.
    return rows.join(F.broadcast(table), "_range")


def numbered(df: DataFrame, order: list, out: str = "index", start: int = 1) -> DataFrame:
    """Numbers from `start` without gaps in the given order."""
    rows = ranged(df, order)
    offsets, total = [], start
    for r in rows.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():
        offsets.append((r["_range"], total))
        total += r["n"]
    return _with_offsets(rows, offsets).withColumn(out, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def running_sum(df: DataFrame, order: list, value: str, out: str) -> DataFrame:
    """The sum of `value` over all rows up to and with each row."""
    rows = ranged(df, order)
    offsets, total = [], 0
    for r in rows.groupBy("_range").agg(F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("n")).orderBy("_range").collect():
        offsets.append((r["_range"], total))
        total += r["n"]
    w = W.partitionBy("_range").orderBy("_place").rowsBetween(W.unboundedPreceding, 0)
    return _with_offsets(rows, offsets).withColumn(out, (F.sum(value).over(w) + F.col("_before")).cast("long")).drop("_range", "_place", "_before")


def _new(value: str, w) -> Column:
    same = F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(F.lit(1)).over(w).isNotNull()
    return F.when(same, 0).otherwise(1)


def run_numbers(df: DataFrame, order: list, value: str, out: str) -> DataFrame:
    """Number, from 1, of the run of equal values that each row is in."""
    rows = ranged(df, order)
    w = W.partitionBy("_range").orderBy("_place")
    rows = rows.withColumn("_new", _new(value, w))
    ends = rows.groupBy("_range").agg(F.sum("_new").alias("n"), F.min_by(value, "_place").alias("first"), F.max_by(value, "_place").alias("last")).orderBy("_range").collect()
    offsets, total, last = [], 0, None
    for r in ends:
        # A run that goes on over a border is one run.
        goes_on = last is not None and r["first"] == last[0]
        offsets.append((r["_range"], total - goes_on))
        total, last = total + r["n"] - goes_on, (r["last"],)
    inside = F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))
    return _with_offsets(rows, offsets).withColumn(out, (inside + F.col("_before")).cast("long")).drop("_range", "_place", "_before", "_new")


def run_numbers_in(df: DataFrame, scope: list[str], order: list, value: str, out: str) -> DataFrame:
    """run_numbers, from 1 in each scope."""
    w = W.partitionBy(*scope).orderBy(*order)
    return df.withColumn("_new", _new(value, w)).withColumn(out, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("_new")

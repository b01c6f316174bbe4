"""Which version of a script is read: first-wins, overriding archives, size limits, routing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean
from ..storage import staged
from .ordered import running_sum

# Suffixes of archives, extractors of extensions.
ARCHIVES = (".xp3", ".nsa", ".sar", ".arc", ".ypf", ".pfs", ".pak", ".g00")
ROUTES = {".ks": "kirikiri", ".tjs": "kirikiri", ".asd": "kirikiri", ".ws2": "bgi", ".mes": "bgi", ".nscript": "nscripter"}


def split_virtual_path(path: Column) -> Column:
    """struct<container, inner>: the first segment if it is an archive, and the rest."""
    p = F.translate(path, "\\", "/")
    head = F.regexp_extract(p, r"\A([^/]+)/", 1)
    packed = F.lower(head).rlike(r"(?:" + "|".join("\\" + a for a in ARCHIVES) + r")\z")
    rest = F.substring(p, F.char_length(head) + 2, F.char_length(p))
    return F.struct(F.when(packed, head).otherwise("").alias("container"), F.when(packed, rest).otherwise(p).alias("inner"))


def override_rank(container: Column, inner: Column) -> Column:
    """Greater wins: loose files before archives, then the archive's name, then the path."""
    loose = F.coalesce(container, F.lit("")) == ""
    return F.struct(loose.cast("int").alias("loose"), F.when(loose, "").otherwise(F.lower(container)).alias("container"), F.lower(inner).alias("inner"))


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; the order must be total for a defined result.

    An aggregation with partial results: a key that very many rows share leaves each task as one row.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*[F.col(f"_first.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def without_paths(plain: DataFrame, special: DataFrame, path: str = "virtual_path") -> DataFrame:
    """Rows of `plain` whose path no row of `special` has."""
    return plain.join(special.select(path).distinct(), path, "left_anti").select(*plain.columns)


def resolve_overrides(scripts: DataFrame, order: list[Column], inner: str = "inner", container: str = "container", label: str = "virtual_path") -> DataFrame:
    """All rows with kept (boolean) and winner (label of the kept row of the same inner path); labels are unique.

    Two aggregations with partial results find the winners: the highest rank, then the first of its rows.
    """
    ranked = scripts.withColumn("_key", F.lower(F.col(inner))).withColumn("_rank", override_rank(F.col(container), F.col(inner)))
    best = ranked.groupBy("_key").agg(F.max("_rank").alias("_best"))
    top = ranked.join(best, "_key").filter(F.col("_rank") == F.col("_best"))
    winners = top.groupBy("_key").agg(F.min_by(label, F.struct(*order)).alias("winner"))
    out = ranked.join(winners, "_key")
    return out.withColumn("kept", F.col(label) == F.col("winner")).select(*scripts.columns, "winner", "kept")


def within_size(df: DataFrame, most: int, size: str = "size") -> DataFrame:
    return df.filter(F.col(size) <= most)


def _fitting(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = budget
        for b in batches:
            taken = []
            for k, size in enumerate(b.column(1).to_pylist()):
                if size <= left:
                    left -= size
                    taken.append(k)
            yield b.select([0]).take(pa.array(taken, pa.int64()))

    return run


def greedy_budget(df: DataFrame, budget: int, order: str, size: str = "size") -> DataFrame:
    """Rows taken in order while they fit; a row that would overflow is skipped, later smaller ones may fit.

    `order` is unique. All rows before the first that overflows are taken, found by sums over
    ranges. Only (order, size) of later rows that could still fit go through the one task
    that the rule needs, as a stream in order.
    """
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if total <= budget:
        return df
    sums = staged(running_sum(df.select(F.col(order), F.col(size).cast("long").alias("_size")), [order], "_size", "_sum"), "sums")
    head = sums.filter(F.col("_sum") <= budget)
    left = budget - head.agg(F.coalesce(F.max("_sum"), F.lit(0))).first()[0]
    later = sums.filter((F.col("_sum") > budget) & (F.col("_size") <= left)).select(order, "_size").repartition(1).sortWithinPartitions(order)
    kept = head.select(order).unionByName(later.mapInArrow(_fitting(left), sums.select(order).schema))
    return df.join(kept, order, "left_semi").select(*df.columns)


def prefix_budget(df: DataFrame, budget: int, order: str, size: str = "size") -> DataFrame:
    """Rows in order up to the first that would overflow."""
    return running_sum(df, [order], size, "_sum").filter(F.col("_sum") <= budget).select(*df.columns)


def extractor(engine: Column, path: Column) -> Column:
    """Engine whose extractor reads a script: its own, or for plain files the one of the extension."""
    table = F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair])
    return F.when(engine != "plaintext", engine).otherwise(F.coalesce(table[clean.extension(path)], F.lit("plaintext")))

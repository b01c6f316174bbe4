"""Connected components of an undirected graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, join_counted, shuffle_parts, staged

#: Edges of a graph that one task may solve: 160 kB.
FEW = 10_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Neighbourhoods are aggregated with partial sums; hubs get their rows joined without a shuffle."""
    parts = shuffle_parts(edges.sparkSession)
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
    pairs = ends if large else ends.filter("v < u")
    least = staged(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("up"), F.count("*").alias("n")), "least")
    if large:
        least = least.select("u", F.least("u", "m").alias("m"), F.col("up").alias("n"))
        out = join_counted(pairs.filter("v > u"), least.filter("n > 0"), ["u"], "n", parts).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = least.select("u", "m", "n")
        out = join_counted(pairs, least, ["u"], "n", parts).select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, low[x], least)
        np.minimum.at(new, low[y], least)
        new = new[new]
        if (new == low).all():
            return nodes, nodes[low]
        low = new


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if pairs:
        nodes, low = least_reached(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(low, pa.int64())], names=["node", "component"])


def _settled(edges: DataFrame) -> bool:
    """Are the edges (a above b) stars: every a with one b, no b also an a?"""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("top")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("top")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("top").alias("top")).filter("up > 1 or up = 1 and top = 1").isEmpty()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """node, component (the smallest node that it reaches) for every node of an edge table (a, b).

    Self-loops and nulls are ignored; an empty edge table gives no rows. Every round is
    written to the shared folder; only a count and one answer a round reach the driver.
    Edges that are stars already need no round; a graph of at most FEW edges, by count, is
    solved in one task.
    """
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.count() <= FEW:
        return now.coalesce(1).mapInArrow(_one_task, "node long, component long")
    for _ in range(limit):
        if _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        for large in (True, False):
            last, now = now, staged(_star(now, large), "stars")
            discard(last)
    raise RuntimeError(f"components did not settle in {limit} rounds")

"""What the operators of this subpackage share: shipping code, shared storage, size checks."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only after it was counted and found to need at most this.
BROADCAST_BYTES = 16 << 20


#: Text in one batch for a Python worker. Spark's own limit counts rows alone, whatever their length.
ARROW_BATCH = "3m"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per Spark context, and bound their batches."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH_SETTING, None) in (None, "67108864", "67108864b", "64MB"):
        spark.conf.set(_BATCH_SETTING, ARROW_BATCH)
    if getattr(sc, "_linequarry_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    folder = tempfile.mkdtemp(prefix="linequarry-code-")
    target = os.path.join(folder, "linequarry_code.zip")
    Path(target).write_bytes(packed.getvalue())
    sc.addPyFile(target)
    sc._linequarry_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a session on one machine gets a new folder; on a cluster that is an
    error, because no folder of the driver's machine is there for the executors.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="linequarry-shared-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/linequarry/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared folder and read back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if a count proves that it takes at most `limit` bytes, else `df`.

    `df` should be staged (or otherwise cheap to count).
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], size: str, parts: int) -> DataFrame:
    """Inner join of rows to a staged table with one row per key and, in `size`, how many rows the key has.

    Keys that have more than a quarter of a partition's share are joined by broadcast, the
    rest by shuffle, so no key makes a task large. There are at most 4 * parts such keys,
    whatever the input: that bounds the broadcast. `rows` is read twice and should be staged.
    """
    total, most = table.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    many = max(200, total // (4 * parts))
    if most <= many:
        return rows.join(table.drop(size), on)
    hot = table.filter(F.col(size) > many).drop(size)
    cold = table.filter(F.col(size) <= many).drop(size)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def id_splits(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most parts - 1 increasing values of an integer column that cut it into even ranges.

    Only these values reach the driver. They steer how rows are dealt out, never what comes out.
    """
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(column, shares, 10_000).alias("s")).first()
    return sorted({int(x) for x in (row["s"] or [])})


def range_of(column: Column, splits: list[int]) -> Column:
    """Number of splits at or below the value: 0 for a null."""
    if not splits:
        return F.lit(0)
    cuts = F.array(*[F.lit(x).cast("long") for x in splits])
    return F.coalesce(F.size(F.filter(cuts, lambda x: x <= column)), F.lit(0))


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread_keys(spark: SparkSession, n: int) -> list[int]:
    """n integers that hash partitioning deals to n different partitions, in the order of the partitions."""
    found: dict[int, int] = {}
    tried = 32 * n
    rows = spark.range(tried).select(F.col("id").cast("int").alias("key"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("at"))
    for r in rows.groupBy("at").agg(F.min("key").alias("key")).collect():
        found[r["at"]] = r["key"]
    # For a partition that no tried key reaches any other new key will do.
    return [found.get(i, tried + i) for i in range(n)]


def spread(spark: SparkSession, part: Column, n: int) -> Column:
    """A key for part numbers 0..n-1 that gives each part a partition of its own."""
    keys = spread_keys(spark, n)
    return F.element_at(F.array(*[F.lit(k) for k in keys]), part.cast("int") + 1)

"""New loose scripts since the last run, with a file stream that ends when it has caught up.

Only what needs one script at a time runs here: decoding, extraction, deduplication
inside a script. Versions, global deduplication and numbering need all scripts, so they
run on the table that this appends to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..options import ScanOptions
from ..plans.scan import extract
from ..sources.loose import SCRIPT_EXT

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def append_new(spark: SparkSession, root: str, table_path: str, checkpoint: str, options: ScanOptions | None = None) -> None:
    """Append the lines of scripts that are new below `root` to the Parquet table at `table_path`."""
    options = options or ScanOptions()
    files = spark.readStream.format("binaryFile").schema(_SCHEMA).option("recursiveFileLookup", "true").load(root)
    files = files.filter(clean.extension(F.col("path")).isin(*SCRIPT_EXT) & F.col("length").between(1, options.max_file_bytes))

    def batch(df: DataFrame, number: int) -> None:
        scripts = df.select(F.col("path").alias("script_ord"), F.lit("plaintext").alias("engine"), F.col("path").alias("virtual_path"), F.col("content").alias("data"))
        # A batch that is run again after a failure replaces its own folder.
        extract(scripts, options).withColumnRenamed("script_ord", "source").write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

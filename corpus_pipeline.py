"""Five stages from raw documents to token ids; each stage is one operator of linequarry.llm.

Every function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents.

Defined results: filters work by doc_id, so of rows that share an id all go if one of them
is rejected; rows without an id are kept by every filter and never cut; null and empty
texts pass every stage and end as a document without tokens; an empty table gives an empty
result; very long texts go through whole; other columns than those of documents are
dropped at the first stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linequarry.llm import byte_bpe, decontamination, near_duplicates, quality, repeated_passages
from linequarry.llm.runtime import broadcast_if_small, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids in a broadcast of what a filter drops, in bytes.
DROP_BYTES = 64 << 20


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Documents whose id is not among the dropped ones; texts are shuffled only if those are too many to broadcast."""
    ids = staged(dropped.select("doc_id").filter("doc_id is not null").distinct(), "dropped")
    return docs.select(*COLUMNS).join(broadcast_if_small(ids, 16, DROP_BYTES), "doc_id", "left_anti").select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model trained on good documents does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.judge(docs, labels.filter("quality = 1").select("doc_id"))
    return _without(docs, judged.filter(~F.col("keep")))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five words, 80 %)."""
    return _without(docs, near_duplicates.near_duplicates(docs, words=5, percent=80).filter(~F.col("kept")))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words of 50-word windows that start in an earlier one; untouched texts stay as they are."""
    cut = repeated_passages.cut_repeats(docs, carry=tuple(COLUMNS[1:]))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("carried.text"))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("carried.n_chars"))
    return cut.select("doc_id", text.alias("text"), "carried.lang", "carried.source", n_chars.alias("n_chars"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return _without(docs, decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the digest of the text that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    return made.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("repeated_passages", without_repeated_passages),
    ("decontamination", without_benchmark),
    ("byte_bpe", encoded),
]

#: SQL cannot say the language model or the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs

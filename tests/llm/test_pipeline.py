"""Registered queries against DuckDB, and the pipeline's stages against brute force."""

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from linequarry.llm import byte_bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    rows = queries.QUERIES[name](spark, SF).select(*names).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(want.fetchall(), key=repr)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == corpus_pipeline.COLUMNS, name
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        left = [r["doc_id"] for r in kept.select("doc_id").collect()]
        assert len(left) == len(set(left)) and set(left) <= ids
        if name == "repeated_passages":
            assert set(left) == ids
        docs = corpus_pipeline.staged(kept, name)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 100 < len(texts) < 200
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(texts[r["doc_id"]])


def test_quality_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.good_quality(spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(i in kept for i in bad) <= 0.4 * len(bad)


def test_held_out_documents(spark):
    """Predictions of the registered queries on rows that they did not learn from."""
    folder = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in queries.op6_language_id(spark, folder).collect() if r["held_out"] and langs[r["doc_id"]]]
    assert len(got) > 150 and sum(r["lang_pred"] == langs[r["doc_id"]] for r in got) >= 0.98 * len(got)
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [r for r in queries.op10_toxicity(spark, folder).collect() if r["held_out"] and r["doc_id"] in toxic]
    found = sum(r["predicted"] for r in got if toxic[r["doc_id"]] == 1)
    # A few dozen toxic documents are all that there is to learn from here.
    assert found >= 0.5 * sum(toxic[r["doc_id"]] == 1 for r in got) > 0
    assert sum(r["predicted"] for r in got if toxic[r["doc_id"]] == 0) <= 0.03 * len(got)

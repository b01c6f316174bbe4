"""Every registered query with SQL against DuckDB over the smallest tables."""

import math

import duckdb
import pytest

from linequarry.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def compare(spark, duck, query, sql):
    got = query(spark, SF)
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    left = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    right = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in order) for r in want.fetchall()), key=repr)
    assert left == right


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    compare(spark, duck, queries.QUERIES[name], queries.ORACLES[name])


def test_engine_scores_of_games_that_lack_files(spark, tmp_path):
    # Users with one to three events: most have a few of the eighteen files only.
    rows = [(k, k // 3) for k in range(54)] + [(100 + 18 * k + n, 100 + k) for k in range(6) for n in (5, 8, 14)[: k % 3 + 1]] + [(900 + n, 200 + n) for n in range(18)]
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = queries.QUERIES["engine_scores"](spark, str(tmp_path)).select("game", "key", "score")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.ORACLES["engine_scores"]).fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

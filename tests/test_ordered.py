"""Orders over ranges, versions and budgets against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from linequarry.operators import lines, ordered, versions


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(4)
    made = [(i, rnd.choice("abc") * rnd.randint(0, 2) or None, rnd.randint(0, 50)) for i in rnd.sample(range(10_000), 700)]
    return made, spark.createDataFrame(made, "id long, source string, size long").repartition(5)


def test_numbers_and_runs(rows):
    made, df = rows
    made = sorted(made)
    plan = lines.dense_index(df, ["id"], ["size"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    got = lines.dense_index(df, ["id"], ["size"], start=5).orderBy("index").collect()
    assert [(r["index"], r["id"]) for r in got] == [(k + 5, x[0]) for k, x in enumerate(made)]
    want, scene = {}, 0
    for k, x in enumerate(made):
        scene += k == 0 or x[1] != made[k - 1][1]
        want[x[0]] = scene
    assert {r["id"]: r["scene"] for r in lines.scenes(df, ["id"]).collect()} == want
    sums = {r["id"]: r["s"] for r in ordered.running_sum(df, ["id"], "size", "s").collect()}
    assert all(sums[x[0]] == sum(y[2] for y in made[: k + 1]) for k, x in enumerate(made))


@pytest.mark.parametrize("budget", [0, 1, 100, 5000, 10**9])
def test_budgets(rows, budget):
    made, df = rows
    made = sorted(made)
    used, kept, prefix, total = 0, [], [], 0
    for i, _, size in made:
        if used + size <= budget:
            used += size
            kept.append(i)
        total += size
        if total <= budget:
            prefix.append(i)
    assert sorted(r["id"] for r in versions.greedy_budget(df, budget, "id").collect()) == kept
    assert sorted(r["id"] for r in versions.prefix_budget(df, budget, "id").collect()) == prefix


def test_first_of_ties(spark):
    df = spark.createDataFrame([("k", 2, None), ("k", 1, "x"), ("k", 1, "x"), (None, 9, "n"), (None, 8, None)], "key string, ord int, v string")
    got = {r["key"]: (r["ord"], r["v"]) for r in versions.first_wins(df, ["key"], [F.col("ord")]).collect()}
    assert got == {"k": (1, "x"), None: (8, None)}
    same = spark.createDataFrame([("A", "a.xp3", "1"), ("a", "b.xp3", "2"), ("a", "B.xp3", "3"), ("c", "", "4")], "inner string, container string, virtual_path string")
    got = {r["virtual_path"]: (r["kept"], r["winner"]) for r in versions.resolve_overrides(same, [F.col("virtual_path")]).collect()}
    assert got == {"1": (False, "2"), "2": (True, "2"), "3": (False, "2"), "4": (True, "4")}
    assert versions.first_wins(df.limit(0), ["key"], [F.col("ord")]).collect() == []
    assert lines.dense_index(df.limit(0), ["key"], ["ord"]).collect() == []

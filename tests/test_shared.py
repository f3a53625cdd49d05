import random

import pytest
from pyspark.sql import functions as F

from parley import shared
from parley.operators.graph import connected


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_a_join(spark, monkeypatch, how):
    monkeypatch.setattr(shared, "HEAVY", 3)
    monkeypatch.setattr(shared, "LEAST", 2)
    rows = spark.createDataFrame([(0 if i % 2 else i % 7, i) for i in range(100)], "k int, v int")
    table = rows.where("k <> 5").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    got = shared.spread_join(rows, table, ["k"], 100, "n", how)
    want = rows.join(table.drop("n"), "k", how)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    assert sorted(map(str, got.select("k", "v", "top").collect())) == sorted(map(str, want.select("k", "v", "top").collect()))


@pytest.mark.parametrize("heavy", [10_000, 2], ids=["no hub", "hubs"])
def test_components(spark, monkeypatch, heavy):
    monkeypatch.setattr(shared, "HEAVY", heavy)
    monkeypatch.setattr(shared, "LEAST", 2)
    rng = random.Random(4)
    edges = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in linked}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
    names = {r["node"]: r["component"] for r in connected(spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a, b in edges], "a string, b string")).collect()}
    assert names == {f"n{x:03}": f"n{root(x):03}" for x in linked}


@pytest.mark.parametrize("per", [1000, 7])
def test_salted_join_equals_a_join(spark, per):
    rows = spark.createDataFrame([(0 if i % 2 else i % 7, i) for i in range(100)], "k int, v int")
    table = spark.createDataFrame([(k, f"text {k}") for k in (0, 1, 2, 3, 99)], "k int, t string")
    got, want = shared.salted_join(rows, table, "k", "v", per), rows.join(table, "k")
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert shared.salted_join(rows.limit(0), table, "k", "v", per).count() == 0


def test_ranked_counts_through_all_ranges(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(50), i) for i in range(500)]
    got = shared.ranked(spark.createDataFrame(rows, "k int, i int").repartition(5), ["k", "i"], "rank").collect()
    assert [(r["k"], r["i"]) for r in sorted(got, key=lambda r: r["rank"])] == sorted(rows) and {r["rank"] for r in got} == set(range(500))
    assert shared.ranked(spark.createDataFrame([], "k int"), ["k"], "rank").count() == 0


def test_group_digests_know_the_values_not_their_order(spark):
    rows = [(k % 3, str(k % 40)) for k in range(200)]
    digest = lambda r: {x["g"]: x["d"] for x in shared.group_digests(spark.createDataFrame(r, "g int, v string").repartition(3), ["g"], F.col("v"), "d").collect()}
    assert digest(rows) == digest(rows[::-1]) and len(set(digest(rows).values())) == 3
    assert digest(rows)[0] != digest(rows + [(0, "new")])[0] and digest(rows)[1] == digest(rows + [(0, "new")])[1]


def test_swept_keeps_what_it_is_told_to(spark):
    with shared.swept() as keep:
        a, b = (shared.materialize(spark.range(3), "x") for _ in range(2))
        keep.append(b)
    assert b.count() == 3 and a._parley_path not in shared._LIVE and b._parley_path in shared._LIVE


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session())

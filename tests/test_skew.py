"""Hot keys: every balanced path must agree with the plain one."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pairloom.operators import skew


@pytest.fixture
def table(spark):
    r = random.Random(1)
    data = [(i, "hot" if r.random() < 0.4 else r.choice(["b", None, f"k{r.randrange(50)}"]), r.randrange(9)) for i in range(2000)]
    return data, spark.createDataFrame(data, "id bigint, k string, v int").repartition(7)


def test_hot_keys_are_exact_and_bounded(table):
    data, df = table
    counts = Counter(k for _, k, _ in data if k is not None)
    found = skew.hot_keys(df, "k", len(data), share=0.1, floor=10)
    assert set(found) == {k for k, n in counts.items() if n > 200}
    assert len(found) <= 10
    assert skew.hot_keys(df, "k", 5, share=0.1, floor=10) == []


@pytest.mark.parametrize("floor", [10, 10**6])
def test_lookup_is_a_left_join(spark, table, floor, rows):
    data, df = table
    names = spark.createDataFrame([("hot", "H", None), ("k1", "one", 1)], "k string, name string, x int")
    hot = skew.hot_keys(df, "k", len(data), 0.1, floor)
    assert bool(hot) == (floor == 10)
    got = skew.lookup(df, names, "k", ["name", "x"], hot)
    assert rows(got, "id", "k", "v", "name", "x") == rows(df.join(names, "k", "left"), "id", "k", "v", "name", "x")


@pytest.mark.parametrize("floor", [10, 10**6])
def test_group_minimum(spark, table, floor, rows):
    data, df = table
    hot = skew.hot_keys(df, skew.key_hash("k", "v"), len(data), 0.01, floor)
    least = defaultdict(lambda: 10**9)
    for i, k, v in data:
        least[k, v] = min(least[k, v], i)
    got = skew.with_group_min(df, ["k", "v"], "id", "m", hot)
    assert rows(got, "id", "m") == sorted(((i, least[k, v]) for i, k, v in data), key=repr)


def test_balanced_join_is_an_inner_join(spark, table, rows):
    data, df = table
    other = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), (None, 4)], "k string, w int")
    got = skew.balanced_join(df, other, "k", ["hot"])
    assert rows(got, "id", "w") == rows(df.join(other, "k"), "id", "w")


@pytest.mark.parametrize("floor", [10, 10**6])
def test_per_key_counts(spark, table, floor):
    data, df = table
    want = {}
    for _, k, v in data:
        if k is not None:
            n, p, s = want.get(k, (0, 0, frozenset()))
            want[k] = n + 1, p + (v == 1), s | {v}
    heavy = skew.sketch_heavy_hitters(df, "k", len(data), share=0.1, floor=floor)
    assert ("hot" in heavy) == (floor == 10)
    got = skew.per_key_counts(df.withColumn("other_n", F.lit(1)), "k", "v", F.col("v") == 1, heavy)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {k: (n, p, len(s)) for k, (n, p, s) in want.items()}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id bigint, k string, v int")
    assert skew.hot_keys(df, "k", 0) == [] and skew.sketch_heavy_hitters(df, "k", 0) == []
    assert skew.per_key_counts(df, "k", "v", F.lit(None).cast("boolean"), []).count() == 0
    assert skew.with_group_min(df, ["k"], "id", "m", []).count() == 0


@pytest.mark.parametrize("cell", [3, 1000])
def test_grid_join_is_an_inner_join(spark, cell):
    """Hot keys on one side, on the other, on both, and nulls."""
    r = random.Random(cell)
    left = [(i, r.choice(["both"] * 5 + ["left"] * 5 + ["right", "x", None])) for i in range(300)]
    right = [(i, r.choice(["both"] * 5 + ["right"] * 5 + ["left", "y", None])) for i in range(200)]
    a = spark.createDataFrame(left, "i int, k string").repartition(3)
    b = spark.createDataFrame(right, "j int, k string").repartition(4)
    got = sorted(tuple(x) for x in skew.grid_join(a, b, ["k"], F.col("i"), F.col("j"), cell).select("i", "j", "k").collect())
    assert got == sorted((i, j, k) for i, k in left for j, x in right if k is not None and k == x)
    assert skew.grid_join(a.limit(0), b, ["k"], F.col("i"), F.col("j"), cell).count() == 0


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_endpoint_lookup(spark, broadcast_rows):
    """Small tables are broadcast, large ones looked up without unbalancing hubs; the rows are the same."""
    r = random.Random(6)
    pairs = [(i, r.choice(["hub"] * 4 + ["a", "b", None]), r.choice(["hub", "c", "d", "gone"])) for i in range(400)]
    table = {"hub": 1, "a": 2, "b": 3, "c": 4, "d": None}
    df = spark.createDataFrame(pairs, "i int, protein_a string, protein_b string").repartition(3)
    found = skew.endpoint_lookup(df, spark.createDataFrame(list(table.items()), "p string, v int"), "p", ["v"], broadcast_rows=broadcast_rows, floor=20)
    assert sorted(map(tuple, found.select("i", "v_a", "v_b").collect())) == [(i, table.get(a), table.get(b)) for i, a, b in pairs]

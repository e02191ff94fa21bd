"""Orphan references against brute force: hot keys, hot parents, ties at interval ends, nulls."""

import datetime as dt
import functools
import os
import random

import pytest

from pairloom.operators import orphans
from pairloom.operators.orphans import BloomFilter, orphan_keys, temporal_orphans
from pairloom.session import checkpoint_root

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1)


def living(parents, k, t):
    return t is not None and any(p == k and s is not None and s <= t and (e is None or e > t) for p, s, e in parents)


@pytest.mark.parametrize("split_above", [1, 40, 10**9])
def test_temporal_orphans(spark, split_above):
    r = random.Random(split_above)
    day = lambda: START + DAY * r.randrange(120)
    maybe = lambda x, p: None if r.random() < p else x
    parents = [(r.choice(["hot", "a", "b", "c"]), maybe(day(), 0.05), maybe(day(), 0.4)) for _ in range(60)]
    refs = [(i, maybe(r.choice(["hot"] * 6 + ["a", "b", "c", "gone", "lost"]), 0.05), maybe(day(), 0.05)) for i in range(600)]
    refs += [(1000 + i, "hot", START) for i in range(50)]  # one key, one time
    df = spark.createDataFrame(refs, "id bigint, k string, at timestamp_ntz").repartition(5)
    pf = spark.createDataFrame(parents, "k string, s timestamp_ntz, e timestamp_ntz").repartition(3)
    got = temporal_orphans(df, pf, "k", "at", "s", "e", len(parents), len(refs), split_above)
    assert sorted(x["id"] for x in got.collect()) == [i for i, k, t in refs if k is not None and not living(parents, k, t)]
    assert got.columns == ["id", "k", "at"]


def test_orphan_keys_and_filter(spark):
    refs = spark.createDataFrame([(i,) for i in range(0, 3000, 3)] + [(None,), (3,)], "k bigint")
    parents = spark.createDataFrame([(i,) for i in range(0, 3000, 2)] + [(None,)], "k bigint")
    got = sorted(r[0] for r in orphan_keys(refs, parents, "k", 1501).collect())
    assert got == sorted(i for i in list(range(0, 3000, 3)) + [3] if i % 2)
    bloom = BloomFilter(parents, "k", 1501)
    probed = {r[0]: r[1] for r in bloom.probe(refs, "k", "maybe").collect()}
    assert all(probed[i] for i in range(0, 3000, 6)) and not probed[None]
    assert sum(probed[i] for i in range(3, 3000, 6)) < 50
    assert bloom.n_words * 64 <= 2**27


@pytest.mark.parametrize("broadcast_bits", [0, 2**27])
def test_a_large_filter_is_met_by_chunk(spark, broadcast_bits):
    """Beyond the broadcast bound the filter is shuffled; it answers alike, and rarely lets an orphan pass."""
    parents = spark.createDataFrame([(2 * i,) for i in range(20_000)], "k bigint").repartition(3)
    refs = spark.createDataFrame([(i,) for i in range(30_000)] + [(1,)] * 3000 + [(None,)] * 10, "k bigint").repartition(4)
    bloom = BloomFilter(parents, "k", 20_000, broadcast_bits)
    assert bloom.small == (broadcast_bits > 0) and bloom.n_words >= 4096
    probed = bloom.probe(refs, "k", "maybe")
    assert probed.count() == 33_010 and probed.filter("k % 2 = 0 and not maybe").count() == 0
    assert probed.filter("k is null and maybe").count() == 0
    assert probed.filter("k % 2 = 1 and maybe").count() < 0.02 * 18_000


def test_empty(spark):
    none = spark.createDataFrame([], "id bigint, k string, at timestamp_ntz")
    pf = spark.createDataFrame([], "k string, s timestamp_ntz, e timestamp_ntz")
    one = spark.createDataFrame([(1, "a", START)], "id bigint, k string, at timestamp_ntz")
    assert temporal_orphans(none, pf, "k", "at", "s", "e", 0, 0).count() == 0
    assert temporal_orphans(one, pf, "k", "at", "s", "e", 0, 1).count() == 1


def on_disk(spark):
    """Bytes of the session's shuffle files and of its checkpoint folder."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    local = [d.getPath() for d in env.blockManager().diskBlockManager().localDirs()]
    found = (os.path.join(at, f) for top in [*local, checkpoint_root(spark).removeprefix("file://")] for at, _, files in os.walk(top) for f in files)
    return sum(os.path.getsize(f) for f in found if os.path.exists(f))


def test_a_large_filter_is_not_repeated_on_disk(spark):
    """Rows of a hot key used to carry a chunk of 8 KB each through a shuffle."""
    parents = spark.createDataFrame([(2 * i,) for i in range(20_000)], "k bigint").repartition(3)
    refs = spark.range(60_000).selectExpr("if(id % 3 = 0, id, 2) as k").repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for filters that are large indeed
    try:
        before = on_disk(spark)
        bloom = BloomFilter(parents, "k", 20_000, 0)
        assert not bloom.small
        counted = bloom.probe(refs, "k", "maybe").groupBy("maybe").count()  # while it is held, so are its shuffle files
        n = {r["maybe"]: r["count"] for r in counted.collect()}
        assert n[True] >= 46_667 and n[True] + n[False] == 60_000
        assert on_disk(spark) - before < 8e6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    bloom.discard()


def test_large_filters_give_the_same_orphans(spark, monkeypatch):
    monkeypatch.setattr(orphans, "BloomFilter", functools.partial(BloomFilter, broadcast_bits=2**17))
    parents = [(f"p{i}", START, START + DAY if i % 5 == 0 else None) for i in range(0, 30_000, 2)]
    refs = [(i, "p0" if i % 4 == 0 else f"p{i}", START + DAY * (i % 3)) for i in range(20_000)] + [(-1, None, START), (-2, "p2", None)]
    df = spark.createDataFrame(refs, "id bigint, k string, at timestamp_ntz").repartition(5)
    pf = spark.createDataFrame(parents, "k string, s timestamp_ntz, e timestamp_ntz").repartition(3)
    assert orphans.BloomFilter(pf, "k", len(parents)).n_slices > 1
    end = {k: e for k, _, e in parents}
    lives = lambda k, t: t is not None and k in end and (end[k] is None or end[k] > t)
    got = temporal_orphans(df, pf, "k", "at", "s", "e", len(parents), len(refs))
    assert sorted(r["id"] for r in got.collect()) == sorted(i for i, k, t in refs if k is not None and not lives(k, t))
    got = orphan_keys(df.select("k"), pf.select("k"), "k", len(parents))
    assert sorted(r["k"] for r in got.collect()) == sorted(k for _, k, _ in refs if k is not None and k not in end)
    assert temporal_orphans(df.limit(0), pf, "k", "at", "s", "e", len(parents), 0).count() == 0

"""Training-data operators against brute force: hot keys, nulls, ties, empty tables, clashing columns."""

import datetime as dt
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.llm import calibrate, dedup, grouped_split, mixture, overlap, spam, stable_sample, tokenize
from pairloom.llm.grouped_split import GroupedSplit, Unit, place
from pairloom.operators.components import connected_components

FLOORS = [5, 10**6]  # with and without hot keys


# --- hidden duplicates -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("floor", FLOORS)
def test_copies_and_collapse(spark, rows, floor):
    r = random.Random(floor)
    data = [(i, *(("h", 1) if r.random() < 0.4 else (r.choice(["a", "b", None]), r.choice([0, 1, None]))), "x") for i in r.sample(range(5000), 600)]
    df = spark.createDataFrame(data, "id bigint, k string, label int, n_copies string").repartition(6)
    groups = defaultdict(list)
    for i, k, l, _ in data:
        groups[k, l].append(i)
    got = dedup.copies(df, ["k", "label"], "id", len(data), 0.1, floor)
    assert sorted(map(tuple, got.collect())) == sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    got = dedup.collapse(df, ["k", "label"], "id", len(data), 0.1, floor)
    assert rows(got) == sorted(((k, l, min(g), len(g)) for (k, l), g in groups.items()), key=repr)


def test_no_rows_no_copies(spark):
    df = spark.createDataFrame([], "id bigint, k string")
    assert dedup.copies(df, ["k"], "id", 0).count() == 0 and dedup.collapse(df, ["k"], "id", 0).count() == 0


# --- stable sample -----------------------------------------------------------------------------------------------------

SPECS = [("a", 0.1, 7), ("b", 0.25, 8), ("all", 1.0, 1)]


def sampled(df, n, floor=10**6):
    df = df.withColumn("spec_name", F.lit("clash")).withColumn("sequence", F.lit(0))
    out = stable_sample.stable_sample(df, "unit", "id", "at", SPECS, n, 0.05, floor)
    return {tuple(r) for r in out.select("spec_name", "id", "unit").collect()}


@pytest.mark.parametrize("floor", FLOORS)
def test_sample_is_stable(spark, floor):
    r = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    data = []
    for i in range(6000):
        unit = None if i % 97 == 0 else "hot" if r.random() < 0.2 else f"u{r.randrange(2500)}"
        data.append((i * 3 + r.randrange(3), unit, None if i % 101 == 0 and i < 4000 else start + dt.timedelta(hours=i)))
    schema = "id bigint, unit string, at timestamp_ntz"
    early, everything = data[:4000], data
    before = sampled(spark.createDataFrame(early, schema).repartition(3), 4000, floor)
    after = sampled(spark.createDataFrame(everything, schema).repartition(8), 6000)
    assert before <= after and before == {x for x in after if x[1] in {d[0] for d in early}}
    assert after == sampled(spark.createDataFrame(everything[::-1], schema).repartition(5), 6000, floor)
    units = Counter((s, u) for s, _, u in after)
    whole = Counter(u for _, u, _ in data if u is not None)
    assert all(n == whole[u] for (s, u), n in units.items())
    assert {u for s, u in units if s == "all"} == set(whole)
    assert abs(len([1 for s, _ in units if s == "a"]) / len(whole) - 0.1) < 0.03


def test_each_block_grants_its_share(spark):
    for fraction in (0.1, 0.5):
        got = spark.range(0, 1024 * 300).filter(stable_sample.chosen(F.col("id"), fraction, 5)).groupBy(F.shiftright("id", 10)).count().select("count").distinct()
        assert {r[0] for r in got.collect()} <= {int(fraction * 1024), int(fraction * 1024) + 1}
    hits = spark.range(0, 1024 * 300).filter(stable_sample.chosen(F.col("id"), 0.1, 5)).groupBy((F.col("id") % 16)).count().collect()
    assert min(r[1] for r in hits) > 0.9 * 0.1 * 1024 * 300 / 16  # no position is favoured


def test_sample_of_nothing(spark):
    assert sampled(spark.createDataFrame([], "id bigint, unit string, at timestamp_ntz"), 0) == set()


# --- calibrated sample ---------------------------------------------------------------------------------------------------


def categories(available, per_mille):
    return [calibrate.Category((str(i),), p, a) for i, (a, p) in enumerate(zip(available, per_mille))]


def test_targets_floors_and_gaps():
    c = categories([1000, 1000, 3, 50, 0], [500, 400, 60, 2, 38])
    calibrate.set_targets(c, 200, 5, 200)
    assert [x.wanted for x in c] == [100, 80, 12, 5, 7]
    assert sum(x.target for x in c) == pytest.approx(200) and c[2].target == 3 and c[3].target == 5 and c[4].target == 0
    assert c[0].target / c[1].target == pytest.approx(5 / 4)
    steps = calibrate.tilt(c, 200, 2053)
    assert 1 < steps < 60
    assert all(x.probability * x.available == pytest.approx(x.target) for x in c)


def test_more_wanted_than_there_is():
    c = categories([10, 5], [500, 500])
    calibrate.set_targets(c, 15, 0, 100)
    calibrate.tilt(c, 15, 15)
    assert [x.target for x in c] == [10, 5] and all(x.probability == 1 for x in c)


def test_pivotal_keeps_sums_and_expectations():
    p = np.array([0.2, 0.7, 0.5, 0.9, 0.3, 0.4, 1.0, 0.0, 0.6, 0.4])
    out = np.array([calibrate.pivotal(p, np.random.default_rng(s)) for s in range(4000)])
    assert np.allclose(out.sum(1), p.sum()) and ((out > -1e-9) & (out < 1 + 1e-9)).all()
    assert ((out > 1e-6) & (out < 1 - 1e-6)).sum(1).max() <= 1
    assert np.abs(out.mean(0) - p).max() < 0.04


def test_draw_is_exact_and_layout_free(spark, monkeypatch):
    monkeypatch.setattr(calibrate, "BLOCK_ROWS", 50)  # several levels
    data = [(i, i % 3) for i in range(3000)]
    c = categories([1000, 1000, 1000], [700, 299, 1])
    calibrate.set_targets(c, 301, 2, 301)
    calibrate.tilt(c, 301, 3000)
    a, b = (sorted(map(tuple, calibrate.draw(spark.createDataFrame(data, "unit_id bigint, category int").repartition(n), c, 5).collect())) for n in (2, 7))
    assert a == b and len(a) == len(set(a)) == 301
    assert all(abs(n - c[k].target) < 1 for k, n in Counter(k for _, k in a).items())


@pytest.mark.parametrize("n", [49_000, 50_001, 120_000])
def test_levels_of_the_draw_end(n):
    """Blocks shrink from level to level for any number of open categories."""
    blocks, left, levels = {i: 1 + i % 3 for i in range(n)}, None, 0
    while left is None or left > calibrate.BLOCK_ROWS:
        left = sum(blocks.values()) if blocks else -(-left // calibrate.BLOCK_ROWS)
        blocks = {i: -(-b // calibrate.BLOCK_ROWS) for i, b in blocks.items()} if any(b > 1 for b in blocks.values()) else {}
        levels += 1
    assert levels <= 4


def test_draw_from_more_categories_than_a_block_holds(spark, monkeypatch):
    monkeypatch.setattr(calibrate, "BLOCK_ROWS", 20)
    c = categories([3] * 90, [1] * 90)
    for x in c:
        x.probability = 0.5
    units = spark.createDataFrame([(i, i // 3) for i in range(270)], "unit_id bigint, category int")
    drawn = calibrate.draw(units, c, 3).collect()
    assert len(drawn) == len({r["unit_id"] for r in drawn}) == 135
    assert set(Counter(r["category"] for r in drawn).values()) <= {1, 2}


def test_margins_are_met_together():
    cells = {("x", 0): 500, ("x", 1): 100, ("y", 0): 300, ("y", 1): 400, ("z", 0): 50, ("z", 1): 5}
    targets = [{"x": 60.0, "y": 120.0, "z": 20.0}, {0: 90.0, 1: 110.0}]
    p = calibrate.tilt_margins(cells, targets, 200, 1355)
    for m, t in enumerate(targets):
        for v, want in t.items():
            assert sum(p[k] * n for k, n in cells.items() if k[m] == v) == pytest.approx(want, rel=1e-6)
    assert p["x", 0] * p["y", 1] == pytest.approx(p["x", 1] * p["y", 0])  # one multiplier per value
    scarce = calibrate.tilt_margins(cells, [{"x": 60.0, "y": 90.0, "z": 50.0}, {0: 90.0, 1: 110.0}], 200, 1355)
    assert scarce["z", 1] == 1.0 and sum(scarce[k] * n for k, n in cells.items() if k[0] == "z") == pytest.approx(50, rel=1e-6)
    assert calibrate.tilt_margins({}, [{}, {}], 10, 0) == {} and calibrate.tilt_margins({("q", 0): 5}, targets, 5, 5) == {("q", 0): 0.0}


# --- cross-split overlap ---------------------------------------------------------------------------------------------------


def brute_overlap(data, threshold):
    sets = [(i, s == "train", frozenset(w)) for i, s, w in data if w]
    return sorted((a, b) for a, t, x in sets if t for b, u, y in sets if not u and len(x & y) / len(x | y) >= threshold)


@pytest.mark.parametrize("floor", FLOORS)
def test_equal_pairs_across_splits(spark, floor, monkeypatch):
    monkeypatch.setattr(overlap, "PART_ROWS", 3)
    r = random.Random(8)
    data = [(i, r.choice(["train"] * 4 + ["val", "test"]), ["H", "H2"] if r.random() < 0.3 else [r.choice(["H", "a", "b"]), f"p{r.randrange(40)}"]) for i in range(500)]
    data += [(900, "val", None), (901, "train", [])]
    df = spark.createDataFrame(data, "row_id bigint, split string, shingles array<string>").withColumn("is_train", F.col("split") == "train").withColumn("part", F.lit("x"))
    o = overlap.CrossSplitOverlap(df.repartition(4), len(data), 0.8, 2, 0.05, floor)
    want = brute_overlap(data, 0.8)
    assert sorted(map(tuple, o.row_pairs().collect())) == want
    split = {i: s for i, s, _ in data}
    got = {x["split"]: (x["n_rows"], x["n_pairs"]) for x in o.report("split").collect()}
    assert got == {s: (len({b for _, b in want if split[b] == s}), sum(split[b] == s for _, b in want)) for s in {split[b] for _, b in want}}


def test_near_texts_across_splits(spark):
    r = random.Random(3)
    base = [[f"w{r.randrange(10**6)}" for _ in range(60)] for _ in range(40)]
    data = []
    for i, words in enumerate(base):
        data.append((2 * i, "train", words))
        data.append((2 * i + 1, "val", words[: 60 - r.randrange(12)] + [f"n{r.randrange(10**6)}" for _ in range(r.randrange(6))]))
    df = spark.createDataFrame(data, "row_id bigint, split string, shingles array<string>").withColumn("is_train", F.col("split") == "train")
    found = set(map(tuple, overlap.CrossSplitOverlap(df, len(data)).row_pairs().collect()))
    want = set(brute_overlap(data, 0.8))
    assert found <= want and len(found) >= 0.95 * len(want) and want


def test_band_plan():
    assert overlap.band_plan(0.8, 2) == (1, 16) and overlap.band_plan(0.8, 4) == (1, 16)
    for s in (0.5, 0.8, 0.9):
        b, r = overlap.band_plan(s)
        assert (1 - s**r) ** b <= 1e-3 and b <= 40


# --- components and grouped splits ------------------------------------------------------------------------------------------


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("floor", FLOORS)
def test_components(spark, floor):
    r = random.Random(floor)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(r.randrange(1000, 1200), r.randrange(1000, 1200)) for _ in range(110)]
    df = spark.createDataFrame(edges + [(5, 5), (None, 4), (101, 100)], "u bigint, v bigint").repartition(5)
    got = dict(map(tuple, connected_components(df, 0.05, floor).collect()))
    assert got == brute_components([e for e in edges if e[0] != e[1]])
    assert connected_components(df.limit(0)).count() == 0


def test_place_meets_shares():
    r = random.Random(1)
    units = [Unit(f"u{i}", (r.randrange(20), r.randrange(8), int(r.random() < 0.2))) for i in range(300)]
    shares = {"train": 0.8, "val": 0.1, "test": 0.1}
    out = place(units, shares)
    total = sum(sum(u.labels) for u in units)
    for s, w in shares.items():
        assert abs(sum(sum(u.labels) * out[u.name][s] for u in units) / total - w) < 0.02
    assert all(sum(out[u.name].values()) == 1 for u in units)
    assert place([], shares) == {}


def test_place_of_many_like_units_is_the_one_by_one_greedy():
    """Levelling the needs gives each split as many units as placing them one after the other, within one."""
    shares = {"train": 0.7, "val": 0.2, "test": 0.1}
    for labels in ((3, 0, 1), (0, 2, 0), (5, 5, 5)):
        many = place([Unit("x", labels, 997)], shares)["x"]
        need = {s: w * 997 for s, w in shares.items()}
        one = Counter()
        for _ in range(997):
            s = max(need, key=lambda k: need[k])
            one[s] += 1
            need[s] -= 1
        assert sum(many.values()) == 997 and all(abs(many[s] - one[s]) <= 1 for s in shares)


@pytest.mark.parametrize("most", [4, 60, 100_000])
def test_classes_get_coarser_not_cut(spark, monkeypatch, most):
    """However few classes are allowed, every group is placed whole and shares are kept."""
    monkeypatch.setattr(grouped_split, "MOST_CLASSES", most)
    monkeypatch.setattr(grouped_split, "LARGE_SHARE", 1)
    r = random.Random(7)
    data, i = [], 0
    for g in range(400):
        for _ in range(r.randrange(1, 12)):
            data.append((i, 10 * g, 10 * g + r.randrange(4), r.choice([0, 1, None])))
            i += 1
    df = spark.createDataFrame(data, "row_id bigint, a bigint, b bigint, label int")
    out = GroupedSplit(df, len(data)).assign({"train": 0.6, "val": 0.2, "test": 0.2}).collect()
    assert sorted(x["row_id"] for x in out) == list(range(len(data)))
    by_root = defaultdict(set)
    for x in out:
        by_root[x["root"]].add(x["split"])
    assert all(len(v) == 1 for v in by_root.values())
    sizes = Counter(x["split"] for x in out)
    assert all(abs(sizes[s] / len(data) - w) < 0.05 for s, w in (("train", 0.6), ("val", 0.2), ("test", 0.2)))


@pytest.mark.parametrize("floor", FLOORS)
def test_grouped_split(spark, floor):
    r = random.Random(2)
    data = []
    for i in range(1500):
        g = r.randrange(150) * 10
        a, b = g + r.randrange(5), g + r.randrange(5)
        data.append((i, a if r.random() < 0.9 else None, b if r.random() < 0.9 else None, r.choice([0, 0, 1, None])))
    df = spark.createDataFrame(data, "row_id bigint, a bigint, b bigint, label int").repartition(4)
    for clash in ("split", "root", "node", "unit"):
        df = df.withColumn(clash, F.lit("x"))
    g = GroupedSplit(df, len(data), share=0.05, floor=floor)
    out = {x["row_id"]: (x["root"], x["split"]) for x in g.assign({"train": 0.8, "val": 0.1, "test": 0.1}).collect()}
    root = brute_components([(a, b) for _, a, b, _ in data if a is not None and b is not None])
    where = {}
    for i, a, b, _ in data:
        node = a if a is not None else b
        assert out[i][0] == (None if node is None else root.get(node, node))
        if node is not None:
            assert where.setdefault(out[i][0], out[i][1]) == out[i][1]
    sizes = Counter(s for _, s in out.values())
    assert len(out) == 1500 and abs(sizes["train"] - 1200) < 60 and abs(sizes["val"] - 150) < 60
    splits = [(i, r.choice(["train", "train", "train", "val"])) for i in range(0, 1500, 2)]
    seen = defaultdict(set)
    for i, s in splits:
        if out[i][0] is not None:
            seen[out[i][0]].add(s)
    torn = {x[0] for x in g.torn(spark.createDataFrame(splits, "row_id bigint, split string")).collect()}
    assert torn == {k for k, v in seen.items() if len(v) > 1}


def test_grouped_split_of_nothing(spark):
    df = spark.createDataFrame([], "row_id bigint, a bigint, b bigint, label int")
    g = GroupedSplit(df, 0)
    assert g.assign({"train": 1.0}).count() == 0 and g.torn(spark.createDataFrame([], "row_id bigint, split string")).count() == 0


# --- tokens ------------------------------------------------------------------------------------------------------------------

TEXTS = ["", None, " ", "Hello  world's\n\n tail  ", "naïve café 你好 🧬 ​ x", "a" * 5000, "<|endoftext|> ▁x", "\x00\x01\t\r\n", "it's IT'S 12345 x²", "é ﻿"]


def test_ids_equal_the_published_encoding(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    data = [(i, t, "extra") for i, t in enumerate(TEXTS * 2)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids string").repartition(3)
    out = tokenize.encode_documents(df, "doc_id", "text")
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert got == {i: (ref.encode_ordinary(t) if t else []) for i, t, _ in data}
    back = {r["doc_id"]: r["text"] for r in tokenize.decode_documents(out, "doc_id").collect()}
    assert back == {i: t or "" for i, t, _ in data}
    sizes = {r["doc_id"]: r["n_tokens"] for r in tokenize.encode_documents(df, "doc_id", "text", counts=True).collect()}
    assert sizes == {i: len(x) for i, x in got.items()}
    assert tokenize.encode_documents(df.limit(0), "doc_id", "text").count() == 0


def test_byte_alphabet_is_one_to_one():
    letters = tokenize.byte_alphabet()
    assert len(letters) == len(set(letters.values())) == 256 and letters[ord("A")] == "A" and letters[32] == "Ġ"
    assert not any(c.isspace() for c in letters.values())


@pytest.mark.parametrize("threshold", [0.02, 0.1, 0.15, 0.2, 0.5, 0.8])
def test_band_plan_keeps_the_promised_loss(threshold):
    bands, width = overlap.band_plan(threshold)
    assert (1 - threshold**width) ** bands <= 1e-3


# --- mixture -----------------------------------------------------------------------------------------------------------------


def test_budget_goes_to_siblings_first():
    leaves = {("s", "en", "a"): (0.3, 10), ("s", "en", "b"): (0.3, 1000), ("s", "de", "a"): (0.4, 1000)}
    got = mixture.budget(leaves, 100)
    assert got == pytest.approx({("s", "en", "a"): 10, ("s", "en", "b"): 50, ("s", "de", "a"): 40})
    got = mixture.budget({("x", "a"): (0.5, 10), ("x", "b"): (0.1, 5), ("y", "a"): (0.4, 1000)}, 100)
    assert got == pytest.approx({("x", "a"): 10, ("x", "b"): 5, ("y", "a"): 85})
    assert mixture.budget({("x",): (1.0, 5)}, 100) == {("x",): 5} and mixture.budget({}, 10) == {}
    assert mixture.budget({("x",): (0.0, 50), ("y",): (1.0, 5)}, 10) == {("x",): 0, ("y",): 5}


@pytest.mark.parametrize("total", [1000, 5000, 50000])
def test_mixture(spark, total):
    r = random.Random(total)
    data = []
    for i in range(400):
        s = "big" if i % 3 else "small" if i % 6 else "mid"
        data.append((i, f"d{i if i % 50 else 0}", r.randrange(0, 30), s, r.choice(["en", "de", None])))
    shares = {"big": (0.5, 1), "mid": (0.25, 3), "small": (0.15, 2), "absent": (0.1, 9)}
    df = spark.createDataFrame(data, "doc_id bigint, digest string, n_tokens bigint, source string, lang string").fillna("und", ["lang"])
    m = mixture.Mixture(df.repartition(4), shares, ("source", "lang"), 3, len(data), total)
    picked = [x.asDict() for x in m.selection().collect()]
    digest = {i: d for i, d, *_ in data}
    assert len(picked) == len({p["doc_id"] for p in picked}) == len({digest[p["doc_id"]] for p in picked})
    assert all(1 <= p["copies"] <= shares[p["source"]][1] for p in picked)
    again = mixture.Mixture(df.repartition(7), shares, ("source", "lang"), 3, len(data), total)
    assert sorted((p["doc_id"], p["copies"]) for p in picked) == sorted((x["doc_id"], x["copies"]) for x in again.selection().collect())
    report = {x["source"]: x for x in m.report().collect()}
    assert report["absent"]["used_tokens"] == 0 and report["absent"]["missing_tokens"] == int(0.1 * total)
    for s, x in report.items():
        assert abs(x["used_tokens"] - x["planned_tokens"]) <= 3 * 30
        assert x["used_tokens"] <= x["available_tokens"] * shares[s][1]


def test_mixture_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, digest string, n_tokens bigint, source string, lang string")
    m = mixture.Mixture(df, {"a": (1.0, 1)}, ("source", "lang"), 1, 0)
    assert m.selection().count() == 0 and m.report().first()["used_tokens"] == 0


# --- keyword pages -----------------------------------------------------------------------------------------------------------

PROSE = "The interaction between the two proteins was seen by affinity capture and is weak. It is not known whether the subunit reaches the membrane before transport begins."
SPAM = [
    "buy protein kit | cheap protein kit | protein kit near me | best protein kit | order protein kit | discount protein kit",
    "Order protein powder. Discount protein powder. Cheap protein powder? Order protein powder wholesale. Sale lab reagents! Order lab reagents.",
    "#protein #kit #cheap #buy #protein_kit #proteinkit #discount",
    "* https://a.example/x/y\n* www.b.example/z\n* data.c.test/q\n* Next page\n* Sitemap",
    '[Home](https://a.example/x) | <a href="https://b.example/y">click here</a> | antibody (https://c.example/z)',
    "SKU ABC-12345 protein kit tag: cheap 12.50; Art. DEF-999 enzyme mix size: sale 3.10; Item GHI-4321 lab reagents category: best 7.77",
    "Tags: protein kit, enzyme mix, lab reagents, cheap beads\nFiled under: peptide, antibody, discount peptide\nkeywords=a kit, b kit, c kit",
    "what is the best protein kit - price of protein kit - what is the best enzyme mix - price of enzyme mix - who sells protein kit - who sells enzyme mix",
    "where to buy protein kit who sells lab reagents reviews of lab reagents what is the best protein kit who sells protein kit reviews of protein kit where to buy lab reagents",
    "price of enzyme mix, where to buy enzyme mix, price of peptide beads, who sells enzyme mix, where to buy peptide beads, price of enzyme mix, who sells peptide beads",
    "is it cheap antibody - compare antibody? - who sells antibody - how to order antibody in Town - is it cheap antibody - price of antibody - who sells antibody - price of antibody",
    "protein kit septum placement hashed features length enzyme mix peptide export vesicle docking sequence analysis lab reagents cilium growth",
]
CLEAN = [
    PROSE, PROSE + " See also what the curators wrote at https://a.example/x, in case it is needed again later.",
    PROSE * 3 + "\n#protein #kit #cheap", "", None, "   ", "ok", "Sequence missing.", "Nothing else changed.",
    "The list agreed upon at the last meeting names hashed k-mers, length and charge, hashed k-mers, pooled embeddings, hashed k-mers, length and charge, and these were kept in the end.",
    "Nothing was found for the cell cortex, the bud neck, the cytosol, late endosomes, the bud neck, the cytosol, the axoneme, the cell cortex, the bud neck, the axoneme.",
    "run a/b seed=3 rows=100\n[000] epoch=0 loss=1.75 val_F1=0.1\n[001] epoch=1 loss=1.55 val_F1=0.2\nWARN pair (AB12345C, AB12345D): no sequence, dropped",
    ">sp|AB12345C|X_Y Name OS=Some species\nMKVLAAGGHHTTRREEWWQQPPLLMMNNKKSSTTYYVVCC\nMKVLAAGGHHTTRREEWWQQPPLLMMNNKKSSTTYYVVCC",
    "protein_a\tprotein_b\tlabel\tscore\nAB12345C\tAB12345D\t0\t0.4\nAB12345E\tAB12345F\t1\t0.7",
    "Protocol: a titration\n1. Samples were incubated for 10 minutes at 25 degrees.\n2. The beads were washed and the band was cut out.\n3. The peptides were eluted.",
    "Release 4.5\n* removed 89 reversed rows.\n- dropped AB12345C at the wish of the reviewers.\n* fixed the taxon of AB12345D.\n- removed 12 reversed rows.",
    "この結果は新しい種でも確認された。温度を上げると信号は消えた。", "Белок связывается с мембраной в клетках. Мы проверили сто пар.",
]


FOREIGN_PROSE = [
    "Tutkimus osoittaa, että proteiini sitoutuu kalvoon vasta lämpötilan noustessa. Emme tiedä, miksi signaali katoaa toisen pesun jälkeen. Näytteet säilytettiin jääkaapissa yön yli.",
    "Badanie pokazuje, że białko wiąże się z błoną dopiero po podniesieniu temperatury. Nie wiemy jednak, dlaczego sygnał znika po drugim płukaniu. Próbki przechowywano przez noc w lodówce.",
    "Çalışma, proteinin zara ancak sıcaklık yükseldiğinde bağlandığını gösteriyor. Sinyalin ikinci yıkamadan sonra neden kaybolduğunu bilmiyoruz. Örnekler gece boyunca buzdolabında saklandı.",
    "Studien visar att proteinet binder till membranet först när temperaturen stiger. Vi vet inte varför signalen försvinner efter den andra tvätten. Proverna förvarades i kylskåp över natten.",
    "研究表明，温度升高后蛋白质才与膜结合。我们不知道为什么信号在第二次洗涤后消失。样品在冰箱中保存过夜。",
]
FOREIGN_SPAM = [
    "便宜 蛋白 试剂盒 | 购买 蛋白 试剂盒 | 蛋白 试剂盒 价格 | 便宜 蛋白 试剂盒 | 购买 蛋白 试剂盒 | 蛋白 试剂盒 价格 | 便宜 蛋白 试剂盒",
    "купить набор белков дешево, набор белков цена, набор белков купить онлайн, дешево набор белков, лучший набор белков, набор белков доставка, купить набор белков",
    "αγορά κιτ πρωτεΐνης φθηνά | κιτ πρωτεΐνης τιμή | κιτ πρωτεΐνης online | φθηνά κιτ πρωτεΐνης | καλύτερο κιτ πρωτεΐνης | κιτ πρωτεΐνης προσφορά",
]


def _cut_by_regex(text):
    """Segments as (characters, words) by the regular expressions that define them."""
    prepared, known = spam._prepared(text)
    parts = prepared.split("\0") if known else [] if known == [] else [p.strip() for p in spam._CUT.split(prepared + "\n") if p.strip()]
    lengths = [n for n, _ in known] if known is not None else [len(p) for p in parts]
    return [(n, len(spam._WORD.findall(p))) for n, p in zip(lengths, parts, strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBß三µ1٣² _-'’.,;:!?。|»•/*#<>=@\n\t\u00a0\u200b\0")), max_size=6))
def test_texts_are_cut_like_the_expressions_say(texts):
    texts += ["see https://a.example/b now", "<a href='x'>y</a> | z", "It's 3-mer, 1,000.5 or k-mer; end. Next", "SKU ABC-123 kit"]
    sizes, lengths, _, counts, words = spam.cut_texts(texts)
    want = [_cut_by_regex(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    assert list(zip(lengths.tolist(), counts.tolist(), strict=True)) == [x for w in want for x in w]
    assert len(words) == counts.sum()


@pytest.fixture(scope="module")
def crawl(spark):
    """Texts that give the corpus its counts; the texts to be judged are added under ids below 0."""
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")


@pytest.mark.parametrize("copies", [1, 20])
def test_spam_pages(spark, crawl, copies):
    """Every kind of page in any language is found, no prose is, and copies change nothing."""
    spam_texts, clean = SPAM + FOREIGN_SPAM, CLEAN + FOREIGN_PROSE + [PROSE * 6 + "\n" + t[:120] for t in SPAM]
    texts = spam_texts * copies + clean
    added = spark.createDataFrame([(-i - 1, t, None) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string").repartition(3)
    got = {-r[0] - 1 for r in spam.spam_pages(crawl.unionByName(added), "doc_id", "text", share=0.002, floor=15).filter("doc_id < 0").collect()}
    assert {texts[i] for i in range(len(texts)) if (i in got) != (i < len(spam_texts) * copies)} == set()


def test_spam_pages_of_few_texts(spark):
    """Without a corpus, form and repetition are left as evidence; a foreign text is still no spam."""
    texts = [*CLEAN, *FOREIGN_PROSE, *FOREIGN_SPAM, SPAM[2], SPAM[3], SPAM[4]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, doc string")
    got = [r[0] for r in spam.spam_pages(df.unionByName(df), "doc_id", "text").collect()]
    want = range(len(CLEAN) + len(FOREIGN_PROSE), len(texts))
    assert sorted(got) == sorted([*want, *want])  # repeated rows come out repeated
    assert spam.spam_pages(df.limit(0), "doc_id", "text").count() == 0
    nameless = spark.createDataFrame([(None, SPAM[3]), (1, SPAM[3])], "doc_id int, text string")
    assert [r[0] for r in spam.spam_pages(nameless, "doc_id", "text").collect()] == [1]


def test_rare_pairs_are_looked_up_exactly(spark, crawl, monkeypatch):
    """Whether counts come from the tables of frequent pairs and words or from the join makes no difference."""
    some = crawl.filter("doc_id % 20 = 3")
    found = []
    for most in (2**22, 300, 1):
        monkeypatch.setattr(spam, "FREQUENT", most)
        found.append(sorted(r[0] for r in spam.spam_pages(some, "doc_id", "text").collect()))
    assert found[0] and found[0] == found[1] == found[2]


@pytest.mark.parametrize("floor", [3, 10**9])
def test_coherence_is_the_definition(spark, floor):
    import math

    texts = ["a b a b a b c", "c a", "a", None, "", "b c d", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc"]: r for r in spam.coherence(df, "doc_id", "text", share=0.01, floor=floor).collect()}
    docs = {i: list(itertools.pairwise(t.split())) for i, t in enumerate(texts) if t and len(t.split()) > 1}
    pairs = Counter(p for d in docs.values() for p in d)
    left, right = Counter(), Counter()
    for (a, b), n in pairs.items():
        left[a] += n
        right[b] += n
    total = sum(pairs.values())
    pmi = {p: math.log(n * total / left[p[0]] / right[p[1]]) for p, n in pairs.items()}
    assert set(got) == set(docs)
    for i, d in docs.items():
        own = Counter(d)
        assert got[i]["mean_pmi"] == pytest.approx(sum(map(pmi.get, d)) / len(d))
        assert got[i]["repeated"] == pytest.approx(sum(n for p, n in own.items() if n >= 3 and pmi[p] > 0) / len(d))
        assert got[i]["loose"] == pytest.approx(sum(pmi[p] < spam.LOOSE for p in d) / len(d))

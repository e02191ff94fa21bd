"""Small literal frames for the pair operators."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.functions.accession import accession, decode_accession, encode_accession
from pairloom.operators import audit, degree, features, mapping, metrics, ordering, residues, sampling, splits, summaries
from pairloom.operators import pairs as pr

PAIRS = "protein_a string, protein_b string, label int"


def one(spark, expr, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr).first()[0]


def test_accessions(spark):
    for raw, want in [("sp|gh29808n|X", "GH29808N"), ("Yr​14424​s", "YR14424S"), ("AB1234567C", None), ("", None), (None, None), ("AB12345C9DE67890F", "AB12345C")]:
        assert one(spark, accession(F.col("x")), raw) == want
    codes = [one(spark, encode_accession(F.col("x")), a) for a in ("AA00000A", "AA00000Z", "AA00001A", "ZZ99999Z")]
    assert codes == sorted(codes)
    assert one(spark, decode_accession(encode_accession(F.col("x"))), "QX90817M") == "QX90817M"


def test_normalize_and_canonicalize(spark, rows):
    df = spark.createDataFrame([(" B ", "A", 1), ("A", "B", 1), ("A", "A", 1), ("C", "A", 0), ("A", "C", 1), ("", "A", 1), (None, "A", 1), ("X", "Y", 5)], PAIRS)
    normal = pr.normalize_pairs(df)
    assert pr.invalid_pairs(normal).count() == 3
    canon = pr.canonicalize(normal)
    assert rows(canon) == [("A", "B", 1), ("A", "C", 0), ("A", "C", 1)]
    assert rows(pr.contradictions(canon)) == [("A", "C", 2)]
    assert rows(pr.consistent(canon)) == [("A", "B", 1)]
    counters = pr.canonical_counters(normal).first().asDict()
    assert counters == {"n_rows": 8, "n_incomplete": 3, "n_self": 1, "n_duplicates": 1, "n_canonical": 3}
    with pytest.raises(pr.ConstraintError):
        pr.require_empty(pr.contradictions(canon), "both labels")
    with pytest.raises(pr.ConstraintError):
        pr.normalize_pairs(df.drop("label"))


def test_empty_pairs(spark):
    df = spark.createDataFrame([], PAIRS)
    assert pr.canonicalize(df).count() == 0 and pr.assign_pair_ids(df).count() == 0
    assert pr.canonical_counters(df).first()["n_rows"] == 0
    assert pr.pair_counts(df).first().asDict() == {"n_positive": 0, "n_negative": 0, "n_pairs": 0, "n_proteins": 0}


def test_pair_ids_put_negatives_first(spark, rows):
    df = spark.createDataFrame([("A", "B", 1), ("C", "D", 0), ("A", "C", 0)], PAIRS)
    assert rows(pr.assign_pair_ids(df)) == [("pair_0", "A", "C", 0), ("pair_1", "C", "D", 0), ("pair_2", "A", "B", 1)]


def test_drop_reasons_and_filters(spark, rows):
    df = spark.createDataFrame([("A", "B", 1), ("A", "X", 1), ("X", "A", 1), ("X", "Y", 0)], PAIRS)
    seqs = spark.createDataFrame([("A", "MK"), ("B", "MM")], "protein_id string, sequence string")
    got = {(r[0], r[1]): r[3] for r in pr.with_drop_reason(df, seqs).collect()}
    assert got == {("A", "B"): None, ("A", "X"): "missing_protein_b_sequence", ("X", "A"): "missing_protein_a_sequence", ("X", "Y"): "missing_both_sequences"}
    multi = spark.createDataFrame([("P1|P2", "Q"), ("P1", "Q"), (None, "Q")], "a string, b string")
    assert pr.drop_ambiguous(multi, ["a", "b"], "drop").count() == 2
    with pytest.raises(pr.ConstraintError):
        pr.drop_ambiguous(multi, ["a", "b"])


def test_mapping(spark, rows):
    table = spark.createDataFrame([("r1", "P1"), ("r2", "P2"), ("r3", "P3"), ("r3", "P4"), (" r2 ", "P2")], "raw string, canon string")
    m = mapping.build_mapping(table, "raw", "canon")
    df = spark.createDataFrame([("r1", "r2", 1), ("r1", "r3", 1), ("r9", "r3", 1), ("r9", "r1", 1)], PAIRS)
    assert rows(mapping.mapping_counts(mapping.map_pairs(df, m))) == [("ambiguous", 2), ("mapped", 1), ("unmapped", 1)]
    merged, clash = mapping.merge_maps(spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string"), spark.createDataFrame([("b", "3"), ("c", "4")], "k string, v string"), "k", "v")
    assert rows(merged) == [("a", "1"), ("b", "3"), ("c", "4")] and rows(clash) == [("b", "2", "3")]


def test_dense_index_and_running_sums(spark):
    r = random.Random(3)
    data = [(r.randrange(10**6), r.choice("xyz"), r.randrange(5)) for _ in range(3000)]
    df = spark.createDataFrame(data, "u bigint, g string, n bigint").repartition(9)
    got = [x[1] for x in sorted((tuple(t) for t in ordering.dense_index(df, ["u", "g", "n"], "i").select("u", "i").collect()), key=lambda t: t[1])]
    assert got == list(range(3000))
    unique = list({(u, g): n for u, g, n in data}.items())
    df = spark.createDataFrame([(u, g, n) for (u, g), n in unique], "u bigint, g string, n bigint").repartition(5)
    for down in (True, False):
        out = ordering.running_sums(df, ["g"], "u", {"s": "n"}, descending=down, slices=7)
        for u, g, s in out.select("u", "g", "s").collect():
            assert s == sum(n for (v, h), n in unique if h == g and (v >= u if down else v <= u))


def test_reversed_pairs_are_leaks(spark):
    df = spark.createDataFrame([("train", "A", "B", 1), ("val", "B", "A", 1), ("test", "X", "Y", 0)], "split string, " + PAIRS)
    got = {r["kind"]: (r["n_shared"], r["is_leak"]) for r in audit.leakage_audit(df).collect()}
    assert got == {"proteins": (2, False), "unordered_pairs": (1, True)}


def test_duplicates(spark):
    df = spark.createDataFrame([("train", "A", "B", 1), ("train", "A", "B", 1), ("train", "B", "A", 1), ("train", "C", "D", 0)], "split string, " + PAIRS)
    r = audit.duplicates(df).first()
    assert (r["n_duplicate_ordered_pairs"], r["n_duplicate_unordered_pairs"], r["n_distinct_proteins"]) == (1, 2, 4)


TRAIN = [("A", "B", 1), ("B", "A", 1), ("A", "C", 1), ("D", "A", 0)]


def test_training_degrees(spark):
    got = {r[0]: tuple(r)[1:] for r in degree.degree_profile(spark.createDataFrame(TRAIN, PAIRS)).collect()}
    assert {k: v[:2] for k, v in got.items()} == {"A": (2, 4), "B": (1, 2), "C": (1, 1), "D": (0, 1)}
    assert got["D"][2] == "zero"
    empty = spark.createDataFrame([], PAIRS)
    assert degree.degree_profile(empty).count() == 0


def test_degree_features(spark):
    import math

    train = spark.createDataFrame(TRAIN, PAIRS)
    profile, edges = degree.degree_profile(train), degree.positive_edges(train)
    for a, b in (("A", "C"), ("C", "A")):
        row = spark.createDataFrame([(a, b, 1)], PAIRS)
        full = degree.degree_features(row, profile).first()
        assert tuple(full)[3:] == pytest.approx((math.log1p(1), math.log1p(2), math.log1p(1) * math.log1p(2)))
        own = degree.degree_features(row, profile, edges).first()
        assert tuple(own)[3:] == pytest.approx((0, math.log1p(1), 0))


def brute_ap(pairs):
    p = sum(t for t, _ in pairs)
    out = last = 0.0
    for s in sorted({s for _, s in pairs}, reverse=True):
        tp, n = sum(t for t, x in pairs if x >= s), sum(1 for _, x in pairs if x >= s)
        out += (tp - last) / p * tp / n
        last = tp
    return out


def test_metrics_against_brute_force(spark):
    r = random.Random(5)
    data = [(g, int(r.random() < 0.3), r.randrange(20) / 10) for g in ("a", "b", None) for _ in range(200)]
    df = spark.createDataFrame(data, "g string, target int, score double").withColumn("prediction", metrics.predict_at(F.col("score"), 1.0))
    for row in metrics.all_metrics(df, "g").collect():
        mine = [(t, s) for g, t, s in data if g == row["g"]]
        assert row["auprc"] == pytest.approx(brute_ap(mine))
        pos, neg = [s for t, s in mine if t], [s for t, s in mine if not t]
        assert row["auroc"] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
        tp = sum(t and s >= 1 for t, s in mine)
        assert row["precision"] == pytest.approx(tp / sum(s >= 1 for _, s in mine))


def test_one_class_metrics(spark):
    df = spark.createDataFrame([(0, 0.1, 0), (0, 0.2, 0)], "target int, score double, prediction int")
    m = metrics.all_metrics(df).first()
    assert m["accuracy"] == 1 and m["precision"] is None and m["recall"] == 0 and m["f1"] == 0 and m["auprc"] is None and m["auroc"] is None


@pytest.mark.parametrize("seed", range(4))
def test_threshold_is_the_best_of_all(spark, seed):
    """Against all candidates: greatest F1, then closest to the default, then the higher one."""
    r = random.Random(seed)
    data = [(r.randrange(2), r.randrange(12) / 8 - 0.5) for _ in range(60)]
    default = r.choice([0.0, 0.3])

    def f1(t):
        tp = sum(y and x >= t for y, x in data)
        return 2 * tp / (sum(y for y, _ in data) + sum(x >= t for _, x in data))

    want = max({x for _, x in data} | {default}, key=lambda t: (round(f1(t), 12), -abs(t - default), t))
    got = metrics.select_threshold(spark.createDataFrame(data, "target int, score double"), default).first()
    assert (got["threshold"], got["f1"]) == pytest.approx((want, f1(want)))


def test_fixed_threshold_and_bad_rows(spark):
    df = spark.createDataFrame([(0, 0.2), (1, 0.4), (1, 0.9)], "target int, score double")
    assert metrics.fixed_threshold(df, 0.5).first()["f1"] == pytest.approx(2 / 3)
    bad = spark.createDataFrame([(2, 0.1), (1, None), (0, float("nan")), (1, 0.3)], "target int, score double")
    assert metrics.invalid_predictions(bad).count() == 3




def test_pair_space(spark):
    n = 50
    space = spark.range(n * (n - 1) // 2).withColumn("n", F.lit(n))
    got = [tuple(r) for r in sampling.with_pair(space, "id", "n").orderBy("id").select("i", "j").collect()]
    assert got == list(itertools.combinations(range(n), 2))
    big = 3_000_000_000
    pairs = [(0, 1), (0, big - 1), (big - 2, big - 1), (12345678, 2_999_999_998), (1_500_000_000, 1_500_000_001)]
    numbers = [(i * (2 * big - i - 1) // 2 + j - i - 1, big) for i, j in pairs]
    df = sampling.with_pair(spark.createDataFrame(numbers, "number bigint, n bigint"), "number", "n")
    assert sorted(tuple(r) for r in df.select("i", "j").collect()) == sorted(pairs)
    back = df.select((sampling.pair_number(F.col("i"), F.col("j"), F.col("n")) - F.col("number")).alias("d")).collect()
    assert {r[0] for r in back} == {0}


def test_allocation():
    assert sampling.allocate({"a": 3, "b": 1}, {"a": 2, "b": 10}, 6) == {"a": 2, "b": 4}
    assert sum(sampling.allocate({"a": 5, "b": 5, "c": 1}, {"a": 9, "b": 9, "c": 9}, 7).values()) == 7
    with pytest.raises(ValueError):
        sampling.allocate({"a": 1}, {"a": 2}, 3)
    assert sampling.negative_count(5, 0.5) == 2 and sampling.negative_count(1, 0.1) == 1


def test_star_graph_negatives_avoid_the_hub(spark):
    star = spark.createDataFrame([("P0000", f"P{i:04}", 1) for i in range(1, 5000)], PAIRS)
    out = sampling.sample_negatives(star, sampling.NegativeSpec("global", 0.001, 9)).collect()
    assert len(out) == 5 and all("P0000" not in (r[0], r[1]) for r in out) and all(r[0] < r[1] for r in out)


def test_taxon_matched_negatives_keep_proportions(spark):
    pos = [(f"A{i}", f"A{i + 1}", 1) for i in range(20)] + [(f"A{i}", f"B{i}", 1) for i in range(20)]
    taxa = spark.createDataFrame([(f"{t}{i}", t) for t in "AB" for i in range(30)], "protein_id string, taxon_id string")
    df = spark.createDataFrame(pos, PAIRS)
    out = sampling.sample_negatives(df, sampling.NegativeSpec(ratio=1.0, seed=1), taxa)
    got = [tuple(r)[:2] for r in out.collect()]
    assert len(got) == len(set(got)) == 40 and not set(got) & {(a, b) for a, b, _ in pos}
    assert sum(a[0] == b[0] for a, b in got) == 20
    with pytest.raises(pr.ConstraintError):
        sampling.sample_negatives(df, sampling.NegativeSpec(), taxa.filter("protein_id <> 'A3'"))


def test_cohorts_are_nested_and_proportional(spark):
    df = spark.createDataFrame([(i, int(i >= 120)) for i in range(200)], "id int, label int")
    small, large = (sampling.select_cohort(df, "id", sampling.CohortSpec(max_examples=n, seed=3, minimum_per_stratum=1), ["label"]) for n in (40, 80))
    a, b = ({r["id"]: r["sampling_rank"] for r in x.collect()} for x in (small, large))
    assert len(a) == 40 and a.items() <= b.items() and sum(i < 120 for i in a) == 24
    with pytest.raises(ValueError):
        sampling.select_cohort(df, "id", sampling.CohortSpec(max_examples=1, minimum_per_stratum=1), ["label"])


COMPLETE = [(i, f"P{a:02}", f"P{b:02}", (a + b) % 2) for i, (a, b) in enumerate(itertools.combinations(range(14), 2))]


@pytest.mark.parametrize("mode", ["c1", "c2", "c3"])
def test_disjoint_splits_keep_their_promise(spark, mode):
    df = spark.createDataFrame(COMPLETE + [(500, "P01", "P00", 1)], "source_row_index int, " + PAIRS)
    options = {} if mode == "c1" else {"n_trials": 15}
    out = splits.split_pairs(df, mode, val=0.2, test=0.2, **options).persist()
    assert {r[0] for r in out.select("split").distinct().collect()} >= {"train", "val", "test"}
    assert out.count() == 92
    assert all(r["n_violations"] == 0 for r in splits.invariants(out, mode).collect())


def test_groups_stay_together(spark):
    df = spark.createDataFrame(COMPLETE, "source_row_index int, " + PAIRS)
    groups = spark.createDataFrame([(f"P{i:02}", f"G{i // 2}") for i in range(14)], "protein_id string, group_id string")
    out = splits.entity_split(df, groups, "c3", 0.2, 0.2, seed=4, n_trials=20).filter("split <> 'dropped'")
    seen = {}
    for r in out.collect():
        for p in (r["protein_a"], r["protein_b"]):
            assert seen.setdefault(int(p[1:]) // 2, r["split"]) == r["split"]
    with pytest.raises(pr.ConstraintError):
        splits.entity_split(df, groups.limit(3), "c2", 0.2, 0.2)


def test_leaves_stay_in_training(spark):
    edges = [("A", "B"), ("B", "C"), ("A", "C")] + [("A", f"L{i}") for i in range(12)]
    df = spark.createDataFrame([(i, a, b, i % 2) for i, (a, b) in enumerate(edges)], "source_row_index int, " + PAIRS)
    held = [(r["protein_a"], r["protein_b"]) for r in splits.c1(df, 0.0, 0.1, 0).filter("split <> 'train'").collect()]
    assert all(not p.startswith("L") for pair in held for p in pair)


def test_partition_counts():
    for mode in ("c2", "c3"):
        for n in (3, 4, 7, 100):
            counts = splits.partition_counts(mode, n, 0.1, 0.1)
            assert sum(counts) == n and min(counts) >= 1
    assert splits.held_out_fraction("c2", 0.5) == pytest.approx(1 / 3)
    with pytest.raises(pr.ConstraintError):
        splits.partition_counts("c3", 2, 0.1, 0.1)


def test_kmers_and_vocabulary(spark, rows):
    df = spark.createDataFrame([("t", "AAAA"), ("v", "CCCC"), ("s", "A"), ("n", None)], "id string, s string")
    counts = features.term_counts(df, "id", "s", 2)
    train = spark.createDataFrame([("t",)], "row_id string")
    assert rows(features.feature_table(counts, train, "count")) == [("t", "AA", 3.0)]
    assert features.feature_table(counts, train, "tfidf").first()["value"] == pytest.approx(1.0)
    assert features.feature_table(counts, train, "bm25").count() == 1


def test_pair_composition(spark, rows):
    table = spark.createDataFrame([("A", "x", 1.0), ("A", "y", 2.0), ("B", "x", 3.0), ("B", "y", 4.0)], "row_id string, term string, value double")
    for a, b in (("A", "B"), ("B", "A")):
        got = features.compose_sparse(spark.createDataFrame([("p", a, b)], "pair_id string, protein_a string, protein_b string"), table)
        assert rows(got, "part", "term", "value") == [("difference", "x", 2.0), ("difference", "y", 2.0), ("product", "x", 3.0), ("product", "y", 8.0), ("sum", "x", 4.0), ("sum", "y", 6.0)]
    dense = spark.range(1).select(features.compose_dense(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))).first()[0]
    assert dense == [4, 6, 2, 2, 3, 8]


def test_residues(spark):
    rows_ = spark.createDataFrame([("A", 0, "A", 1), ("A", 4, "F", 0), ("B", 2, "K", 1)], "protein_id string, residue_index int, residue string, label int")
    ex = residues.residue_examples(rows_)
    assert {r[0] for r in ex.select("example_id").collect()} == {"A:0:unspecified", "A:4:unspecified", "B:2:unspecified"}
    part = spark.createDataFrame([("A", "train")], "protein_id string, split string")
    with pytest.raises(pr.ConstraintError):
        residues.split_by_protein(ex, part)
    assert residues.split_by_protein(ex, part, strict=False).count() == 2
    seqs = spark.createDataFrame([("A", "ACDEF"), ("B", "MMR")], "protein_id string, sequence string")
    got = {r["example_id"]: (r["window"], r["target_index"], r["residue_ok"]) for r in residues.windows(ex, seqs, 2).collect()}
    assert got == {"A:0:unspecified": ("ACD", 0, True), "A:4:unspecified": ("DEF", 2, True), "B:2:unspecified": ("MMR", 2, False)}


def test_text_functions(spark):
    x = F.col("x")
    assert one(spark, text.normalize_sequence(x), " a c\nd ") == "ACD"
    assert one(spark, text.prottrans_sequence(x), "AUB") == "A X X"
    assert one(spark, text.header_id(x, "uniprot_accession"), "sp|P12345|NAME_X text") == "P12345"
    assert one(spark, text.header_taxon(x), "a OX=0559292 OX=559292 b") == "559292"
    with pytest.raises(Exception, match="several taxa"):
        one(spark, text.header_taxon(x), "a OX=1 OX=2")
    assert [one(spark, text.normalize_taxon(x), v) for v in (" 007 ", "0", "x", "", None)] == ["7", None, None, None, None]
    assert [one(spark, text.safe_component(x), v) for v in ("a b/c", "..", "", None, "é")] == ["a_b_c", "unnamed", "unnamed", "unnamed", "unnamed"]
    assert one(spark, text.plant_motif(x, F.lit("MM"), F.lit(1)), "AAAA") == "AMMA"
    s = spark.range(2).select(text.random_sequence(F.lit(30), F.lit(1), F.col("id"))).collect()
    assert len(s[0][0]) == 30 and s[0][0] != s[1][0]


def control_rows(spark, delta, seeds=range(5)):
    data = [("val", "global", "ctx", m, st, s, 0.6 + (delta if m == "degree_hgb" else 0)) for m in ("degree_logistic", "degree_hgb") for st in ("random", "c1") for s in seeds]
    return spark.createDataFrame(data, "split string, stratification_axis string, control_selection_context_sha256 string, model_name string, split_strategy string, split_seed int, auprc double")


@pytest.mark.parametrize("n_seeds", [4, 5])
@pytest.mark.parametrize("above", [-0.011, -0.004, 0.0, 0.004, 0.011])
def test_control_selection(spark, n_seeds, above):
    """The other control is taken only above the limit and with all seeds."""
    want = "degree_hgb" if n_seeds == len(summaries.CONTROL_SEEDS) and above > 0 else "degree_logistic"
    found = summaries.select_control(control_rows(spark, summaries.LEAST_MEDIAN_GAIN + above, range(n_seeds)))
    assert found.first()["selected_control"] == want


@pytest.mark.parametrize("target", [1, 7, 100, 333, 500])
def test_allocation_of_tables_is_that_of_the_driver(spark, target):
    r = random.Random(target)
    weights = {f"s{i:02d}": r.randrange(1, 40) for i in range(30)}
    capacities = {k: r.randrange(0, 40) for k in weights}
    if sum(capacities.values()) < target:
        return
    df = spark.createDataFrame([(k, weights[k], capacities[k]) for k in weights], "stratum string, weight bigint, capacity bigint")
    got = {x["stratum"]: x["given"] for x in sampling.allocate_rows(df, target).collect()}
    assert got == sampling.allocate(weights, capacities, target)


def test_negatives_of_many_strata(spark, monkeypatch):
    """The way for very many pairs of taxa draws the same pairs."""
    r = random.Random(4)
    pairs = [(f"p{r.randrange(40)}", f"p{r.randrange(40)}") for _ in range(80)]
    df = spark.createDataFrame([(a, b, 1) for a, b in pairs if a != b], "protein_a string, protein_b string, label int")
    known = spark.createDataFrame([(f"p{i}", f"t{i % 3}") for i in range(40)], "protein_id string, taxon_id string")
    spec = sampling.NegativeSpec("taxon_pair_matched", 1.5, 3)
    one = sorted(map(tuple, sampling.sample_negatives(df, spec, known).collect()))
    monkeypatch.setattr(sampling, "DRIVER_STRATA", 0)
    assert sorted(map(tuple, sampling.sample_negatives(df, spec, known).collect())) == one and one


def test_ties_of_the_order_are_broken(spark):
    rows = spark.createDataFrame([(1.0, i, 1) for i in range(50)] + [(2.0, i, 1) for i in range(50)], "u double, i int, n int").repartition(5)
    got = {(r["u"], r["i"]): r["upto"] for r in ordering.running_sums(rows, [], "u", {"upto": "n"}, descending=False, slices=4, ties=["i"]).collect()}
    assert got == {(float(1 + k // 50), k % 50): k + 1 for k in range(100)}


@pytest.mark.parametrize("top", [0, 100])
def test_first_rows(spark, top):
    rows = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "v int").repartition(4)
    assert sorted(r[0] for r in ordering.first_rows(rows, ["v"], 20, top).collect()) == list(range(20))
    assert ordering.first_rows(rows.limit(0), ["v"], 20, top).count() == 0


def lift_rows(spark, **change):
    base = {g: "g" for g in summaries.GATES} | {"split_seed": "0", "grouping_sha256": None}
    data = []
    for name, role, value in (("mlp", "predictive_model", 0.8), ("degree_logistic", "control", 0.6), ("preferential_attachment", "control", 0.5)):
        row = dict(base)
        if role == "control" and name == change.get("model"):
            row |= change["gate"]
        data.append((name, role, "global", value, *(row[g] for g in summaries.GATES)))
    return spark.createDataFrame(data, "model_name string, model_role string, stratification_axis string, auprc double, " + ", ".join(f"{g} string" for g in summaries.GATES))


def test_lift_and_refusals(spark):
    none = spark.createDataFrame([], "control_selection_context_sha256 string, selected_control string")
    r = summaries.degree_lift(lift_rows(spark), none).first()
    assert (r["absolute_lift"], r["absolute_lift_vs_pa"], r["fitting_gain"]) == pytest.approx((0.2, 0.3, 0.1))
    for gate in ("evaluation_cohort_sha256", "grouping_sha256", "protocol_instance_sha256"):
        for model in ("degree_logistic", "preferential_attachment"):
            with pytest.raises(pr.ConstraintError, match="other gates"):
                summaries.degree_lift(lift_rows(spark, model=model, gate={gate: "other"}), none)
    with pytest.raises(pr.ConstraintError, match="no control"):
        summaries.degree_lift(lift_rows(spark, model="degree_logistic", gate={"split": "other"}), none)


def test_summaries(spark, rows):
    df = spark.createDataFrame([("m", None, 0.2), ("m", None, 0.4), ("n", "x", 0.5)], "model_name string, g string, f1 double")
    got = rows(summaries.summarize(df, ["model_name", "g", "absent"], ["f1"]))
    assert got[0][:3] == ("m", None, 2) and got[0][3:] == pytest.approx((0.3, 0.1)) and got[1] == ("n", "x", 1, 0.5, None)
    a = spark.createDataFrame([("m", None, 1.0)], "k string, h string, v double")
    b = spark.createDataFrame([("m", None, 2.0), (None, None, 3.0)], "k string, h string, v double")
    assert rows(summaries.align_splits(a, b, ["k", "h"], ["v"])) == [("m", None, 1.0, 2.0), (None, None, None, 3.0)]
    pa = spark.createDataFrame([("preferential_attachment", 1.0, "r1"), ("preferential_attachment", 1.0, "r2"), ("m", 1.0, "r1"), ("m", 1.0, "r2")], "model_name string, auprc double, run_dir string")
    assert summaries.deduplicate_attachment(pa).count() == 3

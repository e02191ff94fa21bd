"""Files, runs and grids end to end on toy data, and their refusals."""

import bz2
import gzip
import json
import lzma
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pairloom.__main__ import main
from pairloom.functions.digests import content_checksum, table_sha256
from pairloom.models.estimators import SparkBackend, dense_vector
from pairloom.models.runner import fit_and_evaluate
from pairloom.operators.pairs import ConstraintError
from pairloom.sinks import writers
from pairloom.sources import fasta, interactions, runs, sidecars, tables
from pairloom.streaming import ingest
from pairloom.workflow import grid, identity, prepare, toy, train

FASTA = ">sp|P1|A_X OX=9606 first\nMKV\nAAC\n>P2 OX=10090\r\nMMMM\r\n>P3\nACDE"


def test_separators():
    assert [tables.infer_separator(p) for p in ("a.csv", "a.tsv.gz", "a.TXT.bz2", "a.tab.xz")] == [",", "\t", "\t", "\t"]
    with pytest.raises(ConstraintError):
        tables.infer_separator("a.parquet")


@pytest.mark.parametrize("suffix", ["", ".gz", ".bz2", ".xz"])
def test_tables_are_text(spark, tmp_path, suffix, rows):
    data = b'id,v\n001,NA\n"a,b",x\n007,\n'
    path = tmp_path / f"t.csv{suffix}"
    path.write_bytes({"": bytes, ".gz": gzip.compress, ".bz2": bz2.compress, ".xz": lzma.compress}[suffix](data))
    assert rows(tables.read_table(spark, str(path))) == [("001", None), ("007", None), ("a,b", "x")]
    assert tables.header(spark, str(path)) == ["id", "v"]


def test_archives(spark, tmp_path, rows):
    path = tmp_path / "t.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("first.tsv", "id\tv\n001\tx\n")
        z.writestr("second.tsv", "id\tv\n002\ty\n")
    assert rows(tables.read_table(spark, str(path), "second.tsv", ["id"])) == [("002",)]
    for member in (None, "third.tsv"):
        with pytest.raises(ConstraintError):
            tables.read_table(spark, str(path), member)
    (tmp_path / "t.csv").write_text("a\n1\n")
    with pytest.raises(ConstraintError):
        tables.read_table(spark, str(tmp_path / "t.csv"), "x")


@pytest.mark.parametrize("suffix", ["", ".gz", ".xz"])
def test_fasta(spark, tmp_path, suffix, rows):
    path = tmp_path / f"p.fasta{suffix}"
    path.write_bytes({"": bytes, ".gz": gzip.compress, ".xz": lzma.compress}[suffix](FASTA.encode()))
    assert rows(fasta.read_fasta(spark, str(path))) == [("P2", "MMMM", "10090"), ("P3", "ACDE", None), ("sp|P1|A_X", "MKVAAC", "9606")]


@pytest.mark.parametrize("text", [">A\nMK\n>A\nMM\n", ">A\n>B\nMK\n", "MK\n>A\nMK\n", ">\nMK\n"])
def test_bad_fasta(spark, tmp_path, text):
    (tmp_path / "p.fasta").write_text(text)
    with pytest.raises(ConstraintError):
        fasta.read_fasta(spark, str(tmp_path / "p.fasta"))


def test_interactions(spark, tmp_path, rows):
    lines = ["Official Symbol Interactor A\tOfficial Symbol Interactor B\tOrganism A\tOrganism B\tSystem Type"]
    lines += ["a\tb\t559292\t559292\tphysical", "a\tc\t559292\t559292\tgenetic", "b\tc\t559292\t6239\tphysical", "c\td\t559292\t559292\tphysical"]
    (tmp_path / "i.tsv").write_text("\n".join(lines) + "\n")
    pairs, seen = interactions.read_interactions(spark, str(tmp_path / "i.tsv"), organism="559292", organism_columns=("Organism A", "Organism B"), system_types=["physical"], ambiguous="drop")
    assert rows(pairs) == [("a", "b", 1), ("c", "d", 1)]
    assert seen.get == {"n_rows": 4, "n_other_organism": 1, "n_other_system": 1, "n_kept": 2}
    with pytest.raises(ConstraintError):
        interactions.infer_column(["x"], None, ["y"], "role")
    with pytest.raises(ConstraintError):
        interactions.check_mapping_options("f", None, "c")


def test_sidecars(spark, tmp_path, rows):
    (tmp_path / "m.csv").write_text("protein_id,taxon_id\n A ,007\nB,\n")
    assert rows(sidecars.read_taxa(spark, str(tmp_path / "m.csv"))) == [("A", "7")]
    (tmp_path / "c.csv").write_text("protein_id,cluster_id,x\n B , c1 ,1\nA,c1,2\n")
    need = spark.createDataFrame([("A",)], "protein_id string")
    assert [tuple(r) for r in sidecars.read_clusters(spark, str(tmp_path / "c.csv")).collect()] == [("A", "c1"), ("B", "c1")]
    with pytest.raises(ConstraintError):
        sidecars.read_clusters(spark, str(tmp_path / "c.csv"), need, reject_unknown=True)
    (tmp_path / "l.tsv").write_text("A\tA\nA\tB\nC\tC\n")
    got = dict(map(tuple, sidecars.read_cluster_members(spark, str(tmp_path / "l.tsv")).collect()))
    (tmp_path / "l.tsv").write_text("B\tB\nB\tA\nC\tC\n")
    assert got == dict(map(tuple, sidecars.read_cluster_members(spark, str(tmp_path / "l.tsv")).collect())) and got["A"] == got["B"] != got["C"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    writers.append_table(df, str(tmp_path / "t"))
    writers.append_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    with pytest.raises(ConstraintError):
        writers.append_table(df.select("v", "k"), str(tmp_path / "t"))
    path = str(tmp_path / "once")
    writers.append_once(df, path, ["k"], ["v"])
    writers.append_once(df.unionByName(spark.createDataFrame([("c", None)], "k string, v double")), path, ["k"], ["v"])
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ConstraintError):
        writers.append_once(spark.createDataFrame([("a", 1.1)], "k string, v double"), path, ["k"], ["v"])
    writers.create_or_equal({"a": 1}, tmp_path / "lock.json")
    writers.create_or_equal({"a": 1}, tmp_path / "lock.json")
    with pytest.raises(ConstraintError):
        writers.create_or_equal({"a": 2}, tmp_path / "lock.json")


def test_digests_ignore_order(spark):
    df = spark.createDataFrame([(i, str(i % 7)) for i in range(500)] + [(None, None)], "a int, b string")
    other = df.orderBy(F.desc("a")).repartition(7).select("b", "a")
    assert table_sha256(df, ["a", "b"]) == table_sha256(other, ["b", "a"]) != table_sha256(df.limit(400), ["a", "b"])
    assert content_checksum(df) == content_checksum(other.select("a", "b"))


def test_old_result_schemas(spark):
    one = spark.createDataFrame([("lr", "lr-tfidf", "tfidf", 0.5)], "classifier string, model_name string, features string, f1 double")
    names = {"lr": {"estimator_id": "e", "estimator_params": "{}", "matrix_source": "configured", "reporting_group": "model"}}
    r = runs.normalize_results(one, names, allow_unversioned=True).first()
    assert (r["model_name"], r["configuration_id"], r["estimator_id"], r["feature_identity"]) == ("lr", "lr-tfidf", "e", "tfidf")
    with pytest.raises(ConstraintError):
        runs.normalize_results(one, names)
    with pytest.raises(ConstraintError):
        runs.normalize_results(one, {}, allow_unversioned=True)
    mixed = spark.createDataFrame([(1,), (2,)], "evaluation_schema_version int")
    with pytest.raises(ConstraintError):
        runs.normalize_results(mixed)


def test_models(spark):
    import random

    r = random.Random(2)
    data = [(i, "train" if i < 200 else "val" if i < 260 else "test", int(i % 4 == 0), (i % 4 == 0) + r.gauss(0, 0.3), r.random()) for i in range(320)]
    df = dense_vector(spark.createDataFrame(data, "source_row_index int, split string, label int, x double, y double"), ["x", "y"])
    for name in ("always_positive", "logistic", "linear_svm"):
        m, frame = fit_and_evaluate(df, name, evaluate=("train", "val", "test"))
        got = {x["split"]: x for x in m.collect()}
        assert set(got) == {"train", "val", "test"} and frame.filter("score is null").count() == 0
        assert got["test"]["auroc"] == 0.5 if name == "always_positive" else got["test"]["auroc"] > 0.9
    with pytest.raises(ValueError):
        SparkBackend("nope")


def test_grid_options(tmp_path):
    base = {"pairs": "p.csv", "fasta": "f", "out_dir": "o", "run_name": "r"}
    path = tmp_path / "g.toml"
    path.write_text('[grid]\npairs = "x.csv"\nfasta = "f"\nout_dir = "o"\nrun_name = "n"\nmax_pairs = 50.0\nsplit_seeds = [0, 1]\n')
    config = grid.resolve({"pairs": "mine.csv", "profile": "laptop"}, str(path))
    assert config.pairs == "mine.csv" and config.max_pairs == 50 and config.n_split_trials == 25
    assert len(grid.cells(config)) == 4 * 2 * (1 + 2)
    whole = grid.resolve({"full_cohort": True}, str(path))  # the exhaustive profile is the default
    assert whole.max_pairs is None and whole.n_split_trials == 100 and len(grid.cells(whole)) == 4 * 2 * (1 + 5)
    assert grid.resolve({"full_cohort": True, "max_pairs": 7}, str(path)).max_pairs == 7
    path.write_text('[grid]\npairs = "x.csv"\nfasta = "f"\nout_dir = "o"\nrun_name = "n"\nmax_pairs = 50.5\n')
    for bad in ({"config": str(path)}, {"options": base | {"run_name": "a/b"}}, {"options": base | {"classifiers": ()}}, {"options": base | {"sequence_clusters": "c"}}, {"options": base | {"profile": "x"}}):
        with pytest.raises(ConstraintError):
            grid.resolve(bad.get("options", {}), bad.get("config"))


def test_run_claims(tmp_path):
    ident = identity.run_identity("pairs", {"pairs": "a"}, {"seed": 1}, [], {"m": {"matrix_sha256": "x"}})
    identity.claim(str(tmp_path / "r"), ident)
    with pytest.raises(identity.RunError):
        identity.claim(str(tmp_path / "r"), ident)
    with pytest.raises(identity.RunError):
        identity.read_fingerprint(str(tmp_path / "r"))
    (tmp_path / "r" / "x.csv").write_text("1")
    identity.fingerprint(str(tmp_path / "r"), ident)
    identity.read_fingerprint(str(tmp_path / "r"))
    (tmp_path / "r" / "x.csv").write_text("2")
    with pytest.raises(identity.RunError):
        identity.read_fingerprint(str(tmp_path / "r"))
    other = json.loads(json.dumps(ident))
    assert identity.compare(ident, other).matches
    other["matrices"]["m"]["matrix_sha256"] = "y"
    found = identity.compare(ident, other)
    assert found.statuses["matrix_value_match"] == "false" and found.statuses["encoder_contract_match"] == "not_applicable"


@pytest.fixture(scope="module")
def toy_files(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("toy")
    o = toy.ToyOptions(proteins=60, pairs=240, components=3, seed=5, positive_rate=0.4, min_length=40, max_length=60)
    members = toy.proteins(spark, o).persist()
    made = toy.pairs(members, o).persist()
    assert made.count() == 240 and made.select("protein_a", "protein_b").distinct().count() == 240
    assert members.filter("length(sequence) < 40 or length(sequence) > 60").count() == 0
    assert made.groupBy("component_id").agg(F.count_distinct("label").alias("n")).filter("n < 2").count() == 0
    assert toy.label_summary(made).count() == 2 and toy.relation_summary(made).agg(F.sum("n")).first()[0] == 240
    writers.write_single_csv(made.filter("label = 1").select("protein_a", "protein_b"), base / "pos.csv")
    writers.write_single_csv(made.filter("label = 0").select("protein_a", "protein_b"), base / "neg.csv")
    writers.write_fasta(members, members, str(base / "p.fasta"))
    return base


def test_prepare_train_aggregate(spark, toy_files):
    base = toy_files
    o = prepare.PrepareOptions(fasta=str(base / "p.fasta"), out_dir=str(base / "data"), positive_pairs=str(base / "pos.csv"), negative_pairs=str(base / "neg.csv"), taxon_id="9606")
    manifest = prepare.prepare(spark, o)
    assert manifest["n_positive"] + manifest["n_negative"] == 240
    assert sidecars.read_manifest(str(base / "data/pairs.csv"))["dataset_name"] == "dataset"
    with pytest.raises(ConstraintError):
        prepare.prepare(spark, o)
    config = grid.GridConfig(
        pairs=str(base / "data/pairs.csv"), fasta=str(base / "data/proteins.fasta"), out_dir=str(base), run_name="g", split_strategies=("random", "c1"), split_seeds=(0,),
        model_seeds=(1,), classifiers=("degree_logistic", "always_positive", "logistic"), feature_sets=(("count",),), max_pairs=200, max_iter=20,
    )
    folder = grid.run_grid(spark, config)
    assert len(runs.run_directories(str(folder))) == 4
    assert (folder / "summary.csv").is_file() and (folder / "degree_summary.csv").is_file() and (folder / "train_val_f1.csv").is_file()
    lift = tables.read_table(spark, str(folder / "degree_lift.csv")).collect()
    assert {(r["model_name"], r["split_strategy"], r["split"]) for r in lift} == {("logistic", "random", "val"), ("logistic", "c1", "val")}
    for r in lift:
        assert float(r["absolute_lift"]) == pytest.approx(float(r["model_auprc"]) - float(r["degree_control_auprc"]))
    assert list(json.loads((folder / "selected_controls.json").read_text()).values()) == ["degree_logistic"]
    control = folder / "runs/random/split_seed_0/controls/val_degree_metrics.csv"
    text = control.read_text()
    digest = lift[0]["training_examples_sha256"] if lift[0]["split_strategy"] == "random" else lift[1]["training_examples_sha256"]
    control.write_text(text.replace(digest, "0" * 64))
    with pytest.raises(ConstraintError, match="refused lift"):  # behind a changed gate
        grid.aggregate(spark, str(folder))
    control.write_text(text)
    with pytest.raises(ConstraintError):
        grid.run_grid(spark, config)
    a = str(folder / "runs/random/split_seed_0/controls")
    assert identity.compare_directories(a, a).matches
    assert main(["compare-runs", a, a]) == 0
    assert main(["compare-runs", a, str(folder / "runs/c1/split_seed_0/controls")]) == 1
    assert main(["compare-runs", a, str(base / "nothing")]) == 2
    with open(base / "data/pairs.csv", "a") as f:
        f.write("\n")
    with pytest.raises(ConstraintError):
        sidecars.read_manifest(str(base / "data/pairs.csv"))


def test_sampled_negatives(spark, toy_files):
    base = toy_files
    o = prepare.PrepareOptions(fasta=str(base / "p.fasta"), out_dir=str(base / "sampled"), positive_pairs=str(base / "pos.csv"), taxon_id="9606", sample_negatives=True, negative_ratio=0.5)
    m = prepare.prepare(spark, o)
    assert m["n_negative"] == round(m["n_positive"] * 0.5) and m["negatives"]["source"] == "generated"


def test_pairs_without_known_kmers_keep_a_row(spark):
    o = train.TrainOptions("p", "f", "r")
    pairs = spark.createDataFrame([(0, "A", "B", "train"), (1, "S", "T", "train"), (2, "U", "U", "test")], "source_row_index bigint, protein_a string, protein_b string, split string")
    sequences = spark.createDataFrame([("A", "MKVLAA"), ("B", "MKVGGA"), ("S", "MK"), ("T", "V"), ("U", "WWWWW")], "protein_id string, sequence string")
    got = {r[0]: r[1] for r in train.feature_rows(pairs, sequences, o).collect()}
    assert set(got) == {0, 1, 2} and len({v.size for v in got.values()}) == 1
    assert got[0].numNonzeros() > 0 and got[1].numNonzeros() == got[2].numNonzeros() == 0


def test_train_options():
    base = {"pairs": "p", "fasta": "f", "run_dir": "r"}
    for bad in ({"train_size": 0.9, "val_size": 0.1}, {"degree_bin_quantiles": (0.9, 0.5)}, {"sequence_clusters": "c"}, {"model_seeds": (1, 1)}, {"max_pairs": 1, "sample_fraction": 0.1}, {"features": ("x",)}, {"classifier": ("x",)}):
        with pytest.raises(ValueError):
            train.TrainOptions(**base | bad)


def test_stream(spark, tmp_path):
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = [(i, f"AA0000{i % 4}A", "BB00000B", 1, day(i)) for i in range(8)]
    schema = "source_row_index bigint, protein_a string, protein_b string, label int, ingested_at timestamp"
    spark.createDataFrame(rows[:4], schema).write.parquet(str(tmp_path / "in"))
    stream = ingest.pair_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    ingest.run_once(ingest.first_deliveries(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    spark.createDataFrame(rows[4:], schema).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.run_once(ingest.first_deliveries(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    ingest.run_once(ingest.degree_updates(ingest.first_deliveries(stream)), str(tmp_path / "deg"), str(tmp_path / "cp2"), "update")
    got = spark.read.parquet(*(str(p) for p in Path(tmp_path / "deg").iterdir())).filter("protein_id = 'BB00000B'")
    assert got.agg(F.max("positive_degree")).first()[0] == 4

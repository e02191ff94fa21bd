"""Encoders, embedding tables, clusters and weighted samples."""

import random

import pytest
from pyspark.sql import functions as F

from pairloom.models import encoders
from pairloom.operators import clustering, features, sampling
from pairloom.operators.components import connected_components
from pairloom.operators.pairs import ConstraintError


def test_token_batches():
    assert list(encoders.token_budget_batches([5, 6, 20, 21, 22], 42, 3)) == [[0, 1], [2, 3], [4]]
    assert list(encoders.token_budget_batches([99], 10, 3)) == [[0]] and list(encoders.token_budget_batches([], 10, 3)) == []


def test_sequences_are_encoded_once(spark, tmp_path):
    table = encoders.EmbeddingTable(spark, str(tmp_path / "e"))
    encoder = encoders.HashedKmerEncoder(16)
    df = spark.createDataFrame([("A", "mkv aac"), ("B", "MKVAAC"), ("C", "MMMMKK")], "protein_id string, sequence string")
    out = {r[0]: r[1] for r in table.encode(df, encoder).collect()}
    assert out["A"] == out["B"] != out["C"] and sum(x * x for x in out["A"]) == pytest.approx(1, abs=1e-5)
    assert table.read(encoder.spec).count() == 2
    more = df.unionByName(spark.createDataFrame([("D", "ACDEF")], df.schema))
    assert table.encode(more, encoder).count() == 4 and table.read(encoder.spec).count() == 3
    assert table.corrupt(encoder.spec).count() == 0 and table.read(encoders.HashedKmerEncoder(8).spec).count() == 0
    path = f"{tmp_path}/e/fingerprint={encoder.spec.fingerprint}"
    bad = spark.createDataFrame([("x", [0.5] * 16, "0")], "sequence_sha256 string, embedding array<float>, embedding_sha256 string")
    bad.write.mode("append").parquet(path)
    with pytest.raises(ConstraintError):
        table.encode(df, encoder)


def test_specs():
    a, b = encoders.HashedKmerEncoder(8).spec, encoders.HashedKmerEncoder(16).spec
    assert a.fingerprint != b.fingerprint and a.identity_strength == "pinned"
    with pytest.raises(ConstraintError):
        encoders.EncoderSpec("x", "y", None, 8, pooling="max")
    x = features.feature_identity(["tfidf", "bm25", "tfidf"])
    assert x["features"] == "tfidf+bm25" and x["feature_identity"].startswith("tfidf+bm25-k3-")
    assert features.feature_identity(["tfidf"], k1=9.0) == features.feature_identity(["tfidf"])


def test_residue_tokens(spark):
    df = spark.createDataFrame([("p", [True, False, False, True])], "id string, special_mask array<boolean>")
    assert [tuple(r) for r in encoders.residue_tokens(df).collect()] == [("p", 0, 1), ("p", 1, 2)]


@pytest.mark.parametrize("floor", [3, 10**6])
def test_clusters(spark, floor):
    r = random.Random(1)
    data = []
    for f in range(6):
        base = "".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(150))
        for m in range(8):
            s = list(base)
            for _ in range(4):
                s[r.randrange(150)] = r.choice("ACDEFGHIKLMNPQRSTVWY")
            data.append((f"P{f}{m}", "".join(s)))
    data += [("Q1", "M"), ("Q2", None)]
    df = spark.createDataFrame(data, "protein_id string, sequence string")
    got = dict(map(tuple, clustering.cluster_sequences(df, floor=floor, share=0.01).collect()))
    assert len(got) == len(data) and got["Q1"] == "Q1" and got["Q2"] == "Q2"
    assert all(got[p] == f"{p[:2]}0" for p, _ in data[:-2])


@pytest.mark.parametrize(("floor", "block"), [(3, 2), (10**6, None)])
def test_clusters_next_to_strangers_in_a_bucket(spark, floor, block):
    r = random.Random(2)
    sequence = lambda n: "".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))
    data, want = [], {}
    for f in range(6):
        own = sequence(60)
        for m in range(3):
            data.append((f"P{f}{m}", own + sequence(2 * m)))
            want[f"P{f}{m}"] = f"P{f}0"
    # with one hash a bucket, each holds the sequence of just its term, which is the least member and similar to no other
    terms = {s[i : i + 3] for _, s in data for i in range(len(s) - 2)}
    data += [(f"A{t}", t) for t in terms] + [("Z", data[0][1])]
    want |= {f"A{t}": f"A{t}" for t in terms} | {"Z": "P00"}
    df = spark.createDataFrame(data, "protein_id string, sequence string")
    options = {} if block is None else {"block": block}
    got = clustering.cluster_sequences(df, 0.6, bands=6, width=1, floor=floor, share=0.001, **options)
    assert dict(map(tuple, got.collect())) == want


def test_bands_keep_the_promised_loss():
    for threshold in (0.3, 0.5, 0.9, 1.0):
        for width in (1, 3, 5):
            assert (1 - threshold**width) ** clustering.bands_for(threshold, width) <= clustering.MISSED
    assert [clustering.width_for(n) for n in (0, 20_000, 20_001, 600_000, 600_001)] == [3, 3, 4, 4, 5]


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(None, 1), (7, 7)], "u bigint, v bigint")
    assert {r["root"] for r in connected_components(df).collect()} == {0}


def test_weighted_sample(spark):
    df = spark.range(3000).withColumn("w", F.when(F.col("id") < 1000, 0).when(F.col("id") < 2000, 1).otherwise(3))
    out = [r[0] for r in sampling.weighted_sample(df.repartition(5), F.col("w"), 400, 2, "id").select("id").collect()]
    assert len(set(out)) == 400 and min(out) >= 1000
    assert 2.2 < sum(i >= 2000 for i in out) / sum(i < 2000 for i in out) < 4.2

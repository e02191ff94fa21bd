"""Models for pair classification on Spark ML, behind one fit / score contract."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark import SparkContext
from pyspark.ml import classification as ml
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import dense_index


class Scorer(Protocol):
    """What fitting gives: a score per row (higher is more positive)."""

    def score(self, rows: DataFrame) -> DataFrame: ...


class Backend(Protocol):
    """A model that can be fitted on rows with ``features`` and ``label``."""

    threshold: float
    constant: bool

    def fit(self, train: DataFrame, validation: DataFrame | None, seed: int) -> Scorer: ...


@dataclass(frozen=True)
class Spec:
    """A model by name: what builds it, which feature matrix it reads, its default operating point."""

    build: Callable[[int, dict[str, Any]], Any] | None
    matrix: str  # none, training_degree or configured
    threshold: float
    constant: float | None = None
    params: dict[str, Any] = field(default_factory=dict)


def _mlp(seed: int, p: dict[str, Any]):
    return ml.MultilayerPerceptronClassifier(layers=[p["width"], p.get("hidden", 64), 2], maxIter=p.get("max_iter", 100), seed=seed, solver="l-bfgs")


SPECS: dict[str, Spec] = {
    "always_positive": Spec(None, "none", 0.5, 1.0),
    "always_negative": Spec(None, "none", 0.5, 0.0),
    "degree_logistic": Spec(lambda s, p: ml.LogisticRegression(maxIter=p.get("max_iter", 1000), regParam=0.0), "training_degree", 0.5),
    "degree_hgb": Spec(lambda s, p: ml.GBTClassifier(maxIter=p.get("trees", 100), stepSize=0.05, maxDepth=3, seed=s), "training_degree", 0.5),
    "logistic": Spec(lambda s, p: ml.LogisticRegression(maxIter=p.get("max_iter", 1000), regParam=1e-4), "configured", 0.5),
    "sgd_logistic": Spec(lambda s, p: ml.LogisticRegression(maxIter=p.get("max_iter", 100), regParam=1e-4, tol=1e-3), "configured", 0.5),
    "linear_svm": Spec(lambda s, p: ml.LinearSVC(maxIter=p.get("max_iter", 1000), regParam=1e-4), "configured", 0.0),
    "hgb": Spec(lambda s, p: ml.GBTClassifier(maxIter=p.get("trees", 100), stepSize=0.05, maxDepth=3, seed=s), "configured", 0.5),
    "torch_mlp": Spec(_mlp, "configured", 0.5),
}


def spec(name: str) -> Spec:
    try:
        return SPECS[name]
    except KeyError:
        raise ValueError(f"unknown model {name!r}; there are {sorted(SPECS)}") from None


def with_weights(rows: DataFrame) -> DataFrame:
    """``weight`` n / (2 n_class), so that both classes weigh the same."""
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    return rows.withColumn("weight", F.coalesce(*(F.when(F.col("label") == k, total / (2.0 * n)) for k, n in counts.items())))


class _Constant:
    def __init__(self, value: float):
        self.value = value

    def score(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("score", F.lit(self.value))


class _Fitted:
    def __init__(self, model):
        # the training summary holds the session, which tasks cannot serialise once the session observes metrics
        if getattr(model, "hasSummary", False):
            model._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
        self.model = model

    def score(self, rows: DataFrame) -> DataFrame:
        out = self.model.transform(rows)
        column = "probability" if "probability" in out.columns else "rawPrediction"
        return out.select(*rows.columns, vector_to_array(column)[1].alias("score"))


class SparkBackend:
    """A model of :data:`SPECS` as a :class:`Backend`."""

    def __init__(self, name: str, **params):
        self.spec, self.params = spec(name), params
        self.threshold, self.constant = self.spec.threshold, self.spec.constant is not None

    def fit(self, train: DataFrame, validation: DataFrame | None = None, seed: int = 0) -> Scorer:
        if self.spec.constant is not None:
            return _Constant(self.spec.constant)
        params = dict(self.params)
        if self.spec.build is _mlp:
            params["width"] = train.select(F.size(vector_to_array("features"))).first()[0]
        estimator = self.spec.build(seed, params)
        rows = with_weights(train.withColumn("label", F.col("label").cast("double")))
        if estimator.hasParam("weightCol"):
            estimator = estimator.setWeightCol("weight")
        return _Fitted(estimator.fit(rows))


def dense_vector(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``features`` from numeric columns, without Python."""
    return rows.withColumn("features", array_to_vector(F.array(*(F.col(c).cast("double") for c in columns))))


def sparse_vectors(table: DataFrame, train_rows: DataFrame, row_id: str = "pair_id", terms: Sequence[str] = ("part", "term"), rows: DataFrame | None = None) -> DataFrame:
    """(row_id, features) from a long feature table; columns are the terms of the training rows, in order.

    With ``rows``, each of its ids has a vector, of zeros where the table has none of the columns.

    Spark has no built-in that makes a sparse vector, so the last step runs in Python, once per row.
    """
    key = F.concat_ws(":", *terms)
    columns = dense_index(table.join(train_rows.select(row_id), row_id, "left_semi").select(key.alias("column")).distinct(), ["column"], "i")
    size = columns.count()
    cells = table.withColumn("column", key).join(columns, "column").groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), "value"))).alias("c"))
    if rows is not None:
        cells = rows.select(row_id).join(cells, row_id, "left").withColumn("c", F.coalesce("c", F.array().cast(cells.schema["c"].dataType)))

    def vector(c):
        return Vectors.sparse(size, [x[0] for x in c], [x[1] for x in c])

    return cells.select(row_id, F.udf(vector, VectorUDT())("c").alias("features"))

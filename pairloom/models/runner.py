"""Fit once, choose the operating point on validation, evaluate each split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics
from ..session import materialize
from .estimators import SparkBackend


def prediction_frame(rows: DataFrame, task: str, example: str, schema_version: int = 3) -> DataFrame:
    """Predictions with the common columns."""
    return rows.select(
        F.lit(schema_version).alias("evaluation_schema_version"), F.lit(task).alias("task"), "split",
        F.col(example).cast("string").alias("example_id"), F.col("label").cast("int").alias("target"), "score", "prediction",
    )


def fit_and_evaluate(
    rows: DataFrame, model: str, seed: int = 0, policy: str = "validation_f1", evaluate: Sequence[str] = ("train", "val"), task: str = "pairs", example: str = "source_row_index", **params
) -> tuple[DataFrame, DataFrame]:
    """(metrics per evaluated split, predictions) of one fit on ``rows`` (``split``, ``label``, ``features``).

    The threshold is chosen on validation rows only, each row being scored once; without validation rows, and for
    constant models, it is the model's default.
    """
    backend = SparkBackend(model, **params)
    fitted = backend.fit(rows.filter("split = 'train'"), rows.filter("split = 'val'"), seed)
    scored = materialize(fitted.score(rows.filter(F.col("split").isin(sorted({*evaluate, "val"})))).select(example, "split", "label", "score"), "scored")
    validation = scored.filter("split = 'val'").withColumn("target", F.col("label").cast("int"))
    tuned = policy == "validation_f1" and not backend.constant and validation.limit(1).count() > 0
    wanted = scored.filter(F.col("split").isin(list(evaluate)))
    predicted = metrics.apply_policy(validation, wanted, backend.threshold, "validation_f1" if tuned else "fixed")
    frame = prediction_frame(predicted, task, example)
    return metrics.all_metrics(frame, "split").withColumn("model_name", F.lit(model)).withColumn("model_seed", F.lit(seed)), frame


def rerun(rows: DataFrame, model: str, seeds: Sequence[int], **options) -> DataFrame:
    """Metrics of one fit per seed; a constant model is fitted once."""
    out = None
    for number, seed in enumerate(list(seeds)[:1] if SparkBackend(model).constant else seeds):
        part = fit_and_evaluate(rows, model, seed, **options)[0].withColumn("run_number", F.lit(number))
        out = part if out is None else out.unionByName(part)
    return out

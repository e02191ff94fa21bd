"""Exact binary-classification metrics as grouped queries; an undefined metric is null.

Everything that depends on the order of scores works on distinct scores with their counts, and the running counts are
split over slices of the score range, so one large group doesn't end in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import running_sums

_TOLERANCE_DIGITS = 12


def predict_at(score: Column, threshold: Column | float) -> Column:
    return (score >= threshold).cast("int")


def invalid_predictions(rows: DataFrame) -> DataFrame:
    """Rows with a target or prediction other than 0 and 1, or a score that is no finite number."""
    bad_score = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    bad = F.coalesce(~F.col("target").isin(0, 1), F.lit(True)) | bad_score
    if "prediction" in rows.columns:
        bad = bad | ~F.coalesce(F.col("prediction").isin(0, 1), F.lit(True))
    return rows.filter(bad)


def _ratio(n: Column, d: Column) -> Column:
    return F.try_divide(n.cast("double"), d.cast("double"))


def threshold_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """accuracy, precision (null when nothing is predicted positive), recall and F1 (0 when undefined) per group."""
    hit = lambda t, p: F.count_if((F.col("target") == t) & (F.col("prediction") == p))
    tp, fp, fn = hit(1, 1), hit(0, 1), hit(1, 0)
    return rows.groupBy(*by).agg(
        F.avg((F.col("prediction") == F.col("target")).cast("double")).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        F.coalesce(_ratio(tp, tp + fn), F.lit(0.0)).alias("recall"),
        F.coalesce(_ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
    )


def score_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Positives and negatives at each distinct score."""
    return rows.groupBy(*by, "score").agg(F.count_if(F.expr("target = 1")).alias("pos"), F.count_if(F.expr("target = 0")).alias("neg"))


def ranking_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Per group: examples, positives, negatives, prevalence, auprc (average precision) and auroc (ties count half).

    auprc is null without positives, auroc without either class.
    """
    counts = score_counts(rows, *by)
    run = running_sums(counts, list(by), "score", {"tp": "pos", "fp": "neg"})
    pos, neg = F.sum("pos"), F.sum("neg")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    # a positive beats all negatives below its score, and half of those at it
    beaten = F.col("pos") * F.col("fp").cast("double") - F.col("pos") * F.col("neg") / 2.0
    out = run.groupBy(*by).agg(
        (pos + neg).alias("n_examples"), pos.alias("n_positive"), neg.alias("n_negative"),
        _ratio(pos, pos + neg).alias("prevalence"),
        F.when(pos > 0, F.sum(F.col("pos") * precision) / pos).alias("auprc"),
        F.when((pos > 0) & (neg > 0), 1 - F.sum(beaten) / (pos.cast("double") * neg)).alias("auroc"),
    )
    return out


def all_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Ranking metrics, and threshold metrics where there is a prediction."""
    ranked, fixed = ranking_metrics(rows, *by), threshold_metrics(rows, *by)
    if not by:
        return ranked.join(fixed)
    same = F.lit(True)
    right = fixed.select(*(F.col(b).alias(f"__{b}") for b in by), "accuracy", "precision", "recall", "f1")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
    return ranked.join(right, same).drop(*(f"__{b}" for b in by))


def select_threshold(rows: DataFrame, default: float, *by: str) -> DataFrame:
    """Per group the score (or ``default``) that maximises F1 of ``score >= threshold``; ties, within 12 digits, go to
    the candidate closest to ``default``, then to the higher one. Columns threshold, f1, n_candidates."""
    counts = score_counts(rows, *by)
    groups = counts.select(*by).distinct() if by else rows.sparkSession.range(1).drop("id")
    extra = groups.select(*by, F.lit(float(default)).alias("score"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("neg"))
    candidates = counts.withColumn("score", F.col("score").cast("double")).unionByName(extra).groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    run = running_sums(candidates, list(by), "score", {"tp": "pos", "fp": "neg"})
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("__p"))
    if by:
        same = F.lit(True)
        totals = totals.select(*(F.col(b).alias(f"__{b}") for b in by), "__p")
        for b in by:
            same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
        run = run.join(totals, same)
    else:
        run = run.join(totals)
    f1 = F.coalesce(_ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("__p")), F.lit(0.0))
    far = F.round(F.abs(F.col("score") - F.lit(float(default))), _TOLERANCE_DIGITS)
    best = F.max_by(F.struct(F.col("score").alias("s"), F.col("f").alias("f")), F.struct(F.round("f", _TOLERANCE_DIGITS), -far, F.col("score")))
    out = run.withColumn("f", f1).groupBy(*by).agg(best.alias("b"), F.count(F.lit(1)).alias("n_candidates"))
    return out.select(*by, F.col("b.s").alias("threshold"), F.col("b.f").alias("f1"), "n_candidates")


def fixed_threshold(rows: DataFrame, threshold: float, *by: str) -> DataFrame:
    """The given threshold with the F1 it reaches; nothing is tuned."""
    predicted = rows.withColumn("prediction", predict_at(F.col("score"), threshold))
    return threshold_metrics(predicted, *by).select(*by, F.lit(float(threshold)).alias("threshold"), "f1")


def apply_policy(validation: DataFrame, evaluated: DataFrame, default: float, policy: str = "validation_f1", constant: bool = False) -> DataFrame:
    """``evaluated`` with predictions at an operating point that never sees its targets; a constant model's is fixed."""
    if policy not in ("validation_f1", "fixed"):
        raise ValueError(f"unknown policy {policy!r}")
    if policy == "fixed" or constant:
        return evaluated.withColumn("threshold", F.lit(float(default))).withColumn("prediction", predict_at(F.col("score"), default))
    chosen = F.broadcast(select_threshold(validation, default).select("threshold"))  # one row
    return evaluated.join(chosen).withColumn("prediction", predict_at(F.col("score"), F.col("threshold")))


def degree_invariants(rows: DataFrame, *by: str) -> DataFrame:
    """Groups whose scores should be constant: their spread, and AUPRC and AUROC next to prevalence and one half."""
    spread = rows.groupBy(*by).agg((F.max("score") - F.min("score")).alias("spread"))
    ranked = ranking_metrics(rows, *by)
    joined = ranked.join(spread, list(by)) if by else ranked.join(spread)
    holds = (F.col("spread") < 1e-12) & (F.abs(F.col("auprc") - F.col("prevalence")) < 1e-12) & (F.coalesce(F.abs(F.col("auroc") - 0.5), F.lit(0.0)) < 1e-12)
    return joined.withColumn("holds", holds)




def metric_rows(metrics: DataFrame, metadata: dict, splits: Sequence[str] | None = None) -> DataFrame:
    """Metric rows with constant metadata columns in front."""
    rows = metrics if splits is None else metrics.filter(F.col("split").isin(list(splits)))
    return rows.select(*(F.lit(v).alias(k) for k, v in metadata.items()), *metrics.columns)

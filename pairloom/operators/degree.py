"""Training-graph degrees and what is derived from them: bins, features, scores, strata and distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .mapping import project_endpoints
from .pairs import unordered

# Bin orders and protocol names.
DEGREE_BINS = ("unseen", "zero", "low", "mid", "high")
EXPOSURE_BINS = ("unseen", "low", "mid", "high")
C2, C3 = "c2", "c3"


def positive_edges(train: DataFrame) -> DataFrame:
    """Distinct unordered positive training pairs (lo, hi)."""
    lo, hi = unordered("protein_a", "protein_b")
    return train.filter("label = 1").select(lo.alias("lo"), hi.alias("hi")).distinct()


def degree_table(train: DataFrame) -> DataFrame:
    """(protein_id, positive_degree, training_exposure) of every protein in the training rows.

    The degree counts distinct positive partners, the exposure every training row, repeated ones and any label included.
    One union and one aggregation; hub proteins are combined on the map side.
    """
    edges = positive_edges(train).select(F.explode(F.array("lo", "hi")).alias("protein_id"), F.lit(1).alias("d"), F.lit(0).alias("e"))
    rows = train.select(F.explode(F.array("protein_a", "protein_b")).alias("protein_id"), F.lit(0).alias("d"), F.lit(1).alias("e"))
    return edges.unionByName(rows).groupBy("protein_id").agg(F.sum("d").alias("positive_degree"), F.sum("e").alias("training_exposure"))


def cutoffs(degrees: DataFrame, quantiles: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """One row (d_low, d_high, e_low, e_high): exact, linearly interpolated quantiles of the positive degrees above 0
    and of all exposures; 0 where there are none. The values are counted first, so the quantiles see few rows."""
    q = F.array(*(F.lit(x) for x in quantiles))
    by = lambda c: degrees.filter(F.col(c) > 0).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n")).agg(F.percentile("v", q, F.col("n")).alias("p"))
    d, e = by("positive_degree"), by("training_exposure")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    first = d.select(zero(F.get("p", F.lit(0))).alias("d_low"), zero(F.get("p", F.lit(1))).alias("d_high"))
    return first.join(e.select(zero(F.get("p", F.lit(0))).alias("e_low"), zero(F.get("p", F.lit(1))).alias("e_high")))


def degree_bin(degree: Column, seen: Column, low: Column, high: Column) -> Column:
    return F.when(~seen, "unseen").when(degree == 0, "zero").when(degree <= low, "low").when(degree <= high, "mid").otherwise("high")


def exposure_bin(exposure: Column, seen: Column, low: Column, high: Column) -> Column:
    return F.when(~seen, "unseen").when(exposure <= low, "low").when(exposure <= high, "mid").otherwise("high")


def degree_profile(train: DataFrame, quantiles: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """:func:`degree_table` with bins."""
    degrees = materialize(degree_table(train), "degrees")  # one row per protein, read three times
    seen = F.lit(True)
    joined = degrees.join(F.broadcast(cutoffs(degrees, quantiles)))  # one row
    return joined.select(
        *degrees.columns,
        degree_bin(F.col("positive_degree"), seen, F.col("d_low"), F.col("d_high")).alias("positive_degree_bin"),
        exposure_bin(F.col("training_exposure"), seen, F.col("e_low"), F.col("e_high")).alias("training_exposure_bin"),
    )


def with_degrees(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """Both endpoints' degree, exposure, bins and whether they occur in training."""
    values = ["positive_degree", "training_exposure", "positive_degree_bin", "training_exposure_bin"]
    out = project_endpoints(pairs, profile, "protein_id", values)
    for s in ("a", "b"):
        out = out.withColumn(f"seen_{s}", F.col(f"training_exposure_{s}").isNotNull())
        for c in values[:2]:
            out = out.withColumn(f"{c}_{s}", F.coalesce(f"{c}_{s}", F.lit(0)))
        for c in values[2:]:
            out = out.withColumn(f"{c}_{s}", F.coalesce(f"{c}_{s}", F.lit("unseen")))
    return out


def preferential_attachment(a: Column, b: Column) -> Column:
    return F.log1p(a * b)


def degree_features(pairs: DataFrame, profile: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``f_min``, ``f_max``, ``f_product`` of the logged degrees. With ``edges`` (those of training), a positive row that
    is itself an edge leaves its own edge out of both degrees."""
    rows = with_degrees(pairs, profile)
    a, b = F.col("positive_degree_a"), F.col("positive_degree_b")
    if edges is not None:
        lo, hi = unordered("protein_a", "protein_b")
        rows = rows.withColumn("__lo", lo).withColumn("__hi", hi).join(
            edges.select(F.col("lo").alias("__elo"), F.col("hi").alias("__ehi")), (F.col("__lo") == F.col("__elo")) & (F.col("__hi") == F.col("__ehi")), "left"
        )
        own = (F.col("__elo").isNotNull() & (F.col("label") == 1)).cast("int")
        a, b = a - own, b - own
    la, lb = F.log1p(a), F.log1p(b)
    return rows.select(*pairs.columns, F.least(la, lb).alias("f_min"), F.greatest(la, lb).alias("f_max"), (la * lb).alias("f_product"))


def _ranked(bins: Sequence[str], a: str, b: str) -> tuple[Column, Column, Column]:
    order = F.array(*(F.lit(x) for x in bins))
    first = F.array_position(order, F.col(a)) <= F.array_position(order, F.col(b))
    least, greatest = F.when(first, F.col(a)).otherwise(F.col(b)), F.when(first, F.col(b)).otherwise(F.col(a))
    return least, greatest, F.concat_ws("|", least, greatest)


def annotate(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """``pairs`` with the ordinal least, greatest and paired bins, the novelty of the endpoints, the bins of the one
    familiar endpoint, and the attachment score."""
    rows = with_degrees(pairs, profile)
    d = _ranked(DEGREE_BINS, "positive_degree_bin_a", "positive_degree_bin_b")
    e = _ranked(EXPOSURE_BINS, "training_exposure_bin_a", "training_exposure_bin_b")
    both, none = F.col("seen_a") & F.col("seen_b"), ~F.col("seen_a") & ~F.col("seen_b")
    familiar = lambda c: F.when(both | none, "not_applicable").when(F.col("seen_a"), F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))
    names = ("least", "greatest", "pair")
    return rows.select(
        *pairs.columns,
        *(c.alias(f"positive_degree_{n}") for c, n in zip(d, names, strict=True)),
        *(c.alias(f"training_exposure_{n}") for c, n in zip(e, names, strict=True)),
        F.when(both, "both_seen").when(none, "neither_seen").otherwise("one_seen").alias("endpoint_novelty"),
        familiar("positive_degree_bin").alias("positive_degree_familiar"),
        familiar("training_exposure_bin").alias("training_exposure_familiar"),
        preferential_attachment(F.col("positive_degree_a"), F.col("positive_degree_b")).alias("pa_score"),
    )


def strata_axes(strategy: str) -> list[str]:
    """Stratification axes that apply to a protocol, besides ``global``."""
    if strategy == C3:
        return []
    if strategy == C2:
        return ["positive_degree_familiar", "training_exposure_familiar"]
    sides = ("least", "greatest", "pair")
    return [f"{m}_{s}" for m in ("positive_degree", "training_exposure") for s in sides] + ["endpoint_novelty"]


def stratified(annotated: DataFrame, strategy: str, keep: Sequence[str]) -> DataFrame:
    """Long form (``keep``..., axis, stratum), one row per applicable axis, in one pass."""
    axes = [F.struct(F.lit("global").alias("axis"), F.lit("all").alias("stratum"))]
    axes += [F.struct(F.lit(a).alias("axis"), F.col(a).alias("stratum")) for a in strata_axes(strategy)]
    return annotated.select(*keep, F.explode(F.array(*axes)).alias("s")).select(*keep, "s.axis", "s.stratum")


def novelty_violations(annotated: DataFrame, strategy: str) -> DataFrame:
    """Rows that break the promise of C2 (exactly one familiar endpoint) or C3 (none)."""
    want = {C2: "one_seen", C3: "neither_seen"}.get(strategy)
    return annotated.filter(F.col("endpoint_novelty") != want) if want else annotated.filter(F.lit(False))


# --- degrees of all rows, for comparing splits ------------------------------------------------------------------------------


def row_degrees(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., protein_id, degree): every row counts, repeated ones as well."""
    return rows.select(*by, F.explode(F.array("protein_a", "protein_b")).alias("protein_id")).groupBy(*by, "protein_id").agg(F.count(F.lit(1)).alias("degree"))


def degree_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Per group: number, least, greatest, mean, population deviation and quartiles of the degrees."""
    counted = row_degrees(rows, *by).groupBy(*by, "degree").agg(F.count(F.lit(1)).alias("n"))
    n, d = F.col("n"), F.col("degree").cast("double")
    mean = F.sum(n * d) / F.sum(n)
    q = lambda p: F.percentile("degree", F.lit(p), n)
    spread = F.sqrt(F.greatest(F.sum(n * d * d) / F.sum(n) - mean * mean, F.lit(0.0)))
    return counted.groupBy(*by).agg(
        F.sum(n).alias("n_proteins"), F.min("degree").alias("min"), F.max("degree").alias("max"), mean.alias("mean"), spread.alias("std"),
        q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"),
    )


def degree_distance(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Mean absolute difference of 21 quantiles of degree / mean degree between two splits; infinite if one is empty."""
    counted = row_degrees(rows, "split").groupBy("split", "degree").agg(F.count(F.lit(1)).alias("n"))
    points = F.array(*(F.lit(i / 20) for i in range(21)))
    shapes = counted.groupBy("split").agg(F.percentile("degree", points, F.col("n")).alias("q"), (F.sum(F.col("n") * F.col("degree")) / F.sum("n")).alias("m"))
    scaled = shapes.select("split", F.transform("q", lambda x: x / F.col("m")).alias("q"))
    both = scaled.agg(*(F.max(F.when(F.col("split") == s, F.col("q"))).alias(n) for s, n in ((left, "l"), (right, "r"))))
    gap = F.aggregate(F.zip_with("l", "r", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / 21
    return both.select(F.coalesce(gap, F.lit(float("inf"))).alias("distance"))

"""Aggregation over runs: means and errors, control selection, gated lift, aligned and pivoted tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pairs import require_empty

# Names of the controls and the limits of their selection.
PRIMARY_CONTROL, SENSITIVITY_CONTROL = "degree_logistic", "degree_hgb"
ATTACHMENT = "preferential_attachment"
CONTROL_STRATEGIES = ("random", "c1", "c2")
CONTROL_SEEDS = (0, 1, 2, 3, 4)
LEAST_MEDIAN_GAIN, LEAST_WINS = 0.02, 4
NOMINAL = ("task", "split", "split_strategy", "protocol_id", "protocol_version", "split_seed", "dataset_sha256")
GATES = NOMINAL + (
    "training_positive_edges_sha256", "training_examples_sha256", "split_assignments_sha256", "evaluation_cohort_sha256",
    "negative_construction_sha256", "grouping_sha256", "protocol_instance_sha256", "degree_provenance_sha256",
    "control_selection_context_sha256",
)


def null_safe(left: Sequence[Column], right: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right, strict=True)])


def summarize(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Runs, mean and standard error (null for one run) per group; null keys are groups; absent keys are skipped."""
    keys = [k for k in keys if k in rows.columns]
    aggs = [F.count(F.lit(1)).alias("n_runs")]
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias(f"{v}_standard_error")]
    return rows.groupBy(*keys).agg(*aggs)


def deduplicate_attachment(rows: DataFrame, ignored: Sequence[str] = ("execution_id", "run_dir")) -> DataFrame:
    """Attachment rows once each, whatever run delivered them; other rows as they are."""
    mine = F.col("model_name") == ATTACHMENT
    keys = [c for c in rows.columns if c not in ignored]
    return rows.filter(mine).dropDuplicates(keys).unionByName(rows.filter(~mine | F.col("model_name").isNull()))


def summarize_over_seeds(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """First the mean per split seed, then mean and standard error over the seeds, with the numbers of both."""
    keys = [k for k in keys if k in rows.columns]
    per_seed = rows.groupBy(*keys, "split_seed").agg(F.count(F.lit(1)).alias("n"), *(F.avg(v).alias(v) for v in values))
    aggs = [F.count_distinct("split_seed").alias("n_split_seeds"), F.sum("n").alias("n_model_runs")]
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias(f"{v}_standard_error")]
    return per_seed.groupBy(*keys).agg(*aggs)


def control_evidence(rows: DataFrame, context: Sequence[str] = ("control_selection_context_sha256",)) -> DataFrame:
    """Per context, strategy and seed: the mean validation AUPRC of both controls, side by side."""
    wanted = rows.filter(
        (F.col("split") == "val") & (F.col("stratification_axis") == "global")
        & F.col("model_name").isin(PRIMARY_CONTROL, SENSITIVITY_CONTROL) & F.col("split_strategy").isin(*CONTROL_STRATEGIES)
    )
    return wanted.groupBy(*context, "split_strategy", "split_seed").pivot("model_name", [PRIMARY_CONTROL, SENSITIVITY_CONTROL]).agg(F.avg("auprc"))


def select_control(rows: DataFrame, context: Sequence[str] = ("control_selection_context_sha256",)) -> DataFrame:
    """``selected_control`` per context: the sensitivity control where, in any strategy, all seeds are there, it wins at
    least four of them, and its median gain is clearly above the limit."""
    seeds = F.col("split_seed").isin(*CONTROL_SEEDS)
    delta = F.col(SENSITIVITY_CONTROL) - F.col(PRIMARY_CONTROL)
    per = control_evidence(rows, context).filter(seeds).groupBy(*context, "split_strategy").agg(
        (F.count(delta) == len(CONTROL_SEEDS)).alias("complete"), F.percentile(delta, 0.5).alias("median_delta"), F.count_if(delta > 0).alias("wins")
    )
    clearly = F.col("median_delta") - LEAST_MEDIAN_GAIN > 1e-12 * (1 + LEAST_MEDIAN_GAIN)
    promotes = F.col("complete") & clearly & (F.col("wins") >= LEAST_WINS)
    chosen = F.when(F.bool_or(promotes), SENSITIVITY_CONTROL).otherwise(PRIMARY_CONTROL)
    return per.groupBy(*context).agg(chosen.alias("selected_control"))


def _references(rows: DataFrame, value: str, control: bool) -> DataFrame:
    keys = [*GATES, "model_name"] if control else list(GATES)
    aggs = [F.avg("auprc").alias(value)]
    if not control:
        aggs.append((F.max("auprc") - F.min("auprc")).alias("__spread"))
    return rows.groupBy(*keys).agg(*aggs)


def lift_refusals(rows: DataFrame, selection: DataFrame) -> DataFrame:
    """Model rows without a reference in their nominal context, or with one only behind other identity gates."""
    models, out = _with_control(rows, selection), None
    everything = rows.filter("stratification_axis = 'global'")
    for kind, names in (("control", "selected"), ("attachment", "pa")):
        refs = everything.filter(F.col("model_name") == ATTACHMENT) if names == "pa" else everything.filter(F.col("model_name").isin(PRIMARY_CONTROL, SENSITIVITY_CONTROL))

        def matched(columns, refs=refs, names=names):
            right = refs.select(*(F.col(c).alias(f"__{c}") for c in columns), F.col("model_name").alias("__model")).distinct()
            same = null_safe([F.col(c) for c in columns], [F.col(f"__{c}") for c in columns])
            return right, same if names == "pa" else same & (F.col("__model") == F.col("__control"))

        right, same = matched(NOMINAL)
        absent = models.join(right, same, "left_anti").select("model_name", *NOMINAL, F.lit(f"no {kind}").alias("refusal"))
        present = models.join(right, same, "left_semi")
        right, same = matched(GATES)
        gated = present.join(right, same, "left_anti").select("model_name", *NOMINAL, F.lit(f"{kind} behind other gates").alias("refusal"))
        part = absent.unionByName(gated)
        out = part if out is None else out.unionByName(part)
    return out


def _with_control(rows: DataFrame, selection: DataFrame) -> DataFrame:
    context = "control_selection_context_sha256"
    models = rows.filter("stratification_axis = 'global' and model_role = 'predictive_model'")
    chosen = selection.select(F.col(context).alias("__context"), F.col("selected_control").alias("__chosen"))
    joined = models.join(F.broadcast(chosen), F.col(context).eqNullSafe(F.col("__context")), "left")
    return joined.withColumn("__control", F.coalesce("__chosen", F.lit(PRIMARY_CONTROL))).drop("__context", "__chosen")


def safe_ratio(n: Column, d: Column) -> Column:
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), F.try_divide(n, d))


def degree_lift(rows: DataFrame, selection: DataFrame, strict: bool = True) -> DataFrame:
    """Each global row of a predictive model next to its selected control and the attachment score.

    Both references are averaged per gate first and joined null-safely on every gate column. ``strict`` refuses rows
    without a matching reference and attachment scores that differ behind equal gates; otherwise such rows are left out.
    """
    models = _with_control(rows, selection)
    everything = rows.filter("stratification_axis = 'global'")
    controls = _references(everything.filter(F.col("model_name").isin(PRIMARY_CONTROL, SENSITIVITY_CONTROL)), "degree_control_auprc", True)
    pa = _references(everything.filter(F.col("model_name") == ATTACHMENT), "pa_auprc", False)
    if strict:
        require_empty(lift_refusals(rows, selection), "refused lift")
        require_empty(pa.filter("__spread > 1e-12"), "attachment scores differ behind equal gates")
    c = controls.select(*(F.col(g).alias(f"__c_{g}") for g in GATES), F.col("model_name").alias("__c_model"), "degree_control_auprc")
    p = pa.select(*(F.col(g).alias(f"__p_{g}") for g in GATES), "pa_auprc")
    gates = [F.col(g) for g in GATES]
    joined = models.join(c, null_safe(gates, [F.col(f"__c_{g}") for g in GATES]) & (F.col("__control") == F.col("__c_model")))
    joined = joined.join(p, null_safe(gates, [F.col(f"__p_{g}") for g in GATES]))
    model, control, attachment = F.col("auprc"), F.col("degree_control_auprc"), F.col("pa_auprc")
    return joined.select(
        *[x for x in ("run_dir", "execution_id", "model_name", "model_seed") if x in rows.columns], *GATES,
        F.col("__control").alias("selected_fitted_control"), model.alias("model_auprc"), control, attachment,
        (model - control).alias("residual_over_degree_control"), (model - control).alias("absolute_lift"), safe_ratio(model, control).alias("metric_ratio"),
        (model - attachment).alias("absolute_lift_vs_pa"), safe_ratio(model, attachment).alias("metric_ratio_vs_pa"), (control - attachment).alias("fitting_gain"),
    )


def lift_table(lift: DataFrame) -> DataFrame:
    """Mean lift per protocol and model."""
    keys = ["split_strategy", "grouping_sha256", "split", "model_name"]
    values = ["model_auprc", "degree_control_auprc", "pa_auprc", "absolute_lift", "metric_ratio", "fitting_gain"]
    return lift.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *(F.avg(v).alias(v) for v in values))


def align_splits(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], suffixes: tuple[str, str] = ("_train", "_test")) -> DataFrame:
    """Full outer alignment of two summaries on null-safe keys, values with suffixes."""
    a = left.select(*(F.col(k).alias(f"__l_{k}") for k in keys), *(F.col(v).alias(v + suffixes[0]) for v in values))
    b = right.select(*(F.col(k).alias(f"__r_{k}") for k in keys), *(F.col(v).alias(v + suffixes[1]) for v in values))
    # a row that exists is told from one that doesn't by a marker, as its keys may be null
    joined = a.withColumn("__l", F.lit(True)).join(b.withColumn("__r", F.lit(True)), null_safe([F.col(f"__l_{k}") for k in keys], [F.col(f"__r_{k}") for k in keys]), "full")
    merged = [F.when(F.col("__l"), F.col(f"__l_{k}")).otherwise(F.col(f"__r_{k}")).alias(k) for k in keys]
    return joined.select(*merged, *(v + s for s in suffixes for v in values))


def train_val_f1(summary: DataFrame, execution_prefix: str | None = None) -> DataFrame:
    """Mean train and validation F1 per strategy, grouping, model and negative context; rows with only one side are
    dropped, and a missing context reads as legacy."""
    rows = summary if execution_prefix is None else summary.filter(F.col("execution_id").startswith(execution_prefix))
    context = F.coalesce(F.nullif(F.trim("negative_context"), F.lit("")), F.lit("legacy"))
    wide = rows.withColumn("negative_context", context).groupBy("split_strategy", "grouping", "model_name", "negative_context")
    return wide.pivot("summary_split", ["train", "val"]).agg(F.avg("f1_mean")).dropna(subset=["train", "val"])


def panel_order(f1: DataFrame) -> DataFrame:
    """Models of each panel by falling mean validation F1, ``position`` from 1."""
    from pyspark.sql import Window as W

    mean = f1.groupBy("split_strategy", "grouping", "model_name").agg(F.avg("val").alias("val"))
    return mean.withColumn("position", F.row_number().over(W.partitionBy("split_strategy", "grouping").orderBy(F.desc("val"), "model_name")))

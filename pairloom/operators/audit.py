"""Audits of a split: sizes, labels, duplicates, overlaps and species, each as one grouped pass over a split column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .mapping import project_endpoints
from .pairs import unordered


def label_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def split_sizes(rows: DataFrame) -> DataFrame:
    """Rows, share of all rows and label counts per split."""
    counts = rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.expr("label = 1")).alias("n_positive"), F.count_if(F.expr("label = 0")).alias("n_negative")
    )
    return counts.withColumn("fraction", F.col("n_rows") / F.sum("n_rows").over(W.partitionBy()))


def _per_split(values: DataFrame, name: str) -> DataFrame:
    """Distinct and repeated values per split; values are counted per (split, value) first, so hot ones stay cheap."""
    counted = values.groupBy("split", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("split").agg(F.count(F.lit(1)).alias(f"n_distinct_{name}"), (F.sum("n") - F.count(F.lit(1))).alias(f"n_duplicate_{name}"))


def _values(rows: DataFrame, what: str) -> DataFrame:
    lo, hi = unordered("protein_a", "protein_b")
    if what == "proteins":
        return rows.select("split", F.explode(F.array("protein_a", "protein_b")).alias("value"))
    pair: Column = F.struct(lo, hi) if what == "unordered_pairs" else F.struct("protein_a", "protein_b")
    return rows.select("split", pair.alias("value"))


def duplicates(rows: DataFrame) -> DataFrame:
    """Per split: distinct and duplicate ordered and unordered pairs, and distinct proteins."""
    out = _per_split(_values(rows, "ordered_pairs"), "ordered_pairs").join(_per_split(_values(rows, "unordered_pairs"), "unordered_pairs"), "split")
    return out.join(_per_split(_values(rows, "proteins"), "proteins").drop("n_duplicate_proteins"), "split")


def overlaps(rows: DataFrame, what: str) -> DataFrame:
    """Values that two splits share, per pair of splits (in alphabetical order), with the ten least as examples.

    ``what``: proteins, ordered_pairs or unordered_pairs. The splits of a value are gathered as a set of at most three
    names, not joined with each other.
    """
    present = _values(rows, what).groupBy("value").agg(F.collect_set("split").alias("s")).filter("size(s) > 1")
    shown = F.col("value") if what == "proteins" else F.to_json("value")
    pairs = present.select(shown.alias("value"), F.explode(F.array_sort("s")).alias("split_l"), "s").select("value", "split_l", F.explode("s").alias("split_r"))
    pairs = pairs.filter("split_l < split_r")
    # the ten least per pair of splits: a group-limited window, then one row per pair
    rank = F.row_number().over(W.partitionBy("split_l", "split_r").orderBy("value"))
    examples = pairs.withColumn("r", rank).filter("r <= 10").groupBy("split_l", "split_r").agg(F.concat_ws(" ", F.array_sort(F.collect_list("value"))).alias("examples"))
    counts = pairs.groupBy("split_l", "split_r").agg(F.count(F.lit(1)).alias("n_shared"))
    return counts.join(examples, ["split_l", "split_r"])


def leakage_audit(rows: DataFrame) -> DataFrame:
    """Per pair of splits and kind of value, what they share, and whether that is a leak of pairs.

    One pass: every row gives its values of all kinds, one aggregation gathers the splits of each value (three names at
    most), another counts.
    """
    lo, hi = unordered("protein_a", "protein_b")
    blank = F.lit(None).cast("string")
    value = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    a, b = F.col("protein_a"), F.col("protein_b")
    kinds = F.array(value("proteins", a, blank), value("proteins", b, blank), value("ordered_pairs", a, b), value("unordered_pairs", lo, hi))
    present = rows.select("split", F.explode(kinds).alias("v")).groupBy("v.kind", "v.x", "v.y").agg(F.array_sort(F.collect_set("split")).alias("s")).filter("size(s) > 1")
    met = present.groupBy("kind", "s").agg(F.count(F.lit(1)).alias("n"))  # a few sets of splits per kind
    pairs = met.select("kind", "n", F.explode("s").alias("split_l"), "s").select("kind", "n", "split_l", F.explode("s").alias("split_r")).filter("split_l < split_r")
    counts = pairs.groupBy("kind", "split_l", "split_r").agg(F.sum("n").alias("n_shared"))
    return counts.withColumn("is_leak", (F.col("kind") != "proteins") & (F.col("n_shared") > 0))


def taxon_summary(proteins: DataFrame, taxa: DataFrame) -> DataFrame:
    """Proteins per taxon; a null taxon counts those without one."""
    return proteins.join(taxa, "protein_id", "left").groupBy("taxon_id").agg(F.count(F.lit(1)).alias("n_proteins"))


def taxon_composition(pairs: DataFrame, taxa: DataFrame, *by: str) -> DataFrame:
    """Pairs per combination of endpoint taxa ``lo|hi`` (as strings) and its kind: same, cross or missing."""
    lo, hi = unordered("taxon_id_a", "taxon_id_b")
    named = project_endpoints(pairs, taxa, "protein_id", ["taxon_id"]).select(*by, F.concat_ws("|", lo, hi).alias("combination"), lo.alias("lo"), hi.alias("hi"))
    kind = F.when(F.col("lo").isNull(), "missing").when(F.col("lo") == F.col("hi"), "same").otherwise("cross")
    combination = F.when(F.col("lo").isNotNull(), F.col("combination"))
    return named.groupBy(*by, kind.alias("kind"), combination.alias("taxon_pair")).agg(F.count(F.lit(1)).alias("n_pairs"))

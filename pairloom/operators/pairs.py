"""Pair tables: normalisation, canonical form, constraints and counts.

A constraint is a DataFrame of its violations, empty when it holds; :func:`require_empty` turns it into an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import dense_index

PAIR = ["protein_a", "protein_b"]
#: Interactors that name several identifiers at once.
AMBIGUOUS = r"[|;,]"


class ConstraintError(ValueError):
    """Data that a step cannot accept; the message shows up to ten cases."""


def require_empty(violations: DataFrame, message: str) -> None:
    cases = violations.limit(10).collect()
    if cases:
        raise ConstraintError(f"{message}: {[r.asDict() for r in cases]}")


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ConstraintError(f"missing columns {missing}; there are {df.columns}")


def unordered(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    """Endpoints in code-point order; null if either is (``least`` alone would skip nulls)."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, F.least(a, b)), F.when(both, F.greatest(a, b))


def normalize_labels(label: Column) -> Column:
    """0 or 1 from numbers or their text, null for anything else."""
    value = label.try_cast("double")
    return F.when(value.isin(0.0, 1.0), value.cast("int"))


def normalize_pairs(pairs: DataFrame, a: str = "protein_a", b: str = "protein_b", label: str = "label", keep: Sequence[str] = ()) -> DataFrame:
    """Trimmed string endpoints (blank is null) and an integer label, with the columns of ``keep``."""
    require_columns(pairs, [a, b, label, *keep])
    # the text between the outer blanks, null if there is none; evaluated once, unlike nullif
    blank_null = lambda c: F.get(F.regexp_extract_all(F.col(c).cast("string"), F.lit(r"(?s)[^ ](?:.*[^ ])?"), F.lit(0)), F.lit(0))
    return pairs.select(*keep, blank_null(a).alias("protein_a"), blank_null(b).alias("protein_b"), normalize_labels(F.col(label)).alias("label"))


def invalid_pairs(pairs: DataFrame) -> DataFrame:
    """Normalised rows that lack an endpoint or a binary label."""
    return pairs.filter("protein_a is null or protein_b is null or label is null")


def with_source_row_index(rows: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Dense 0-based row identity in the given order; the name is reserved."""
    if "source_row_index" in rows.columns:
        raise ConstraintError("source_row_index is a reserved column")
    return dense_index(rows, order, "source_row_index")


def without_self_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.filter("protein_a <> protein_b")


def canonicalize(pairs: DataFrame) -> DataFrame:
    """Distinct (endpoint, endpoint, label) with ordered endpoints, without self pairs and incomplete rows."""
    lo, hi = unordered("protein_a", "protein_b")
    complete = pairs.filter("protein_a is not null and protein_b is not null and label is not null and protein_a <> protein_b")
    return complete.select(lo.alias("protein_a"), hi.alias("protein_b"), "label").distinct()


def contradictions(canonical: DataFrame) -> DataFrame:
    """Unordered pairs that carry more than one label."""
    return canonical.groupBy(*PAIR).agg(F.count_distinct("label").alias("n_labels")).filter("n_labels > 1")


def consistent(canonical: DataFrame) -> DataFrame:
    """Canonical pairs without contradictory ones: one shuffle, as a pair with two labels has two different ones."""
    grouped = canonical.groupBy(*PAIR).agg(F.min("label").alias("label"), F.max("label").alias("__high"))
    return grouped.filter("label = __high").drop("__high")


def canonical_counters(pairs: DataFrame) -> DataFrame:
    """One row of counters of the canonicalisation: rows read, incomplete, self pairs, duplicates and pairs kept."""
    lo, hi = unordered("protein_a", "protein_b")
    keyed = pairs.select(lo.alias("lo"), hi.alias("hi"), "label")
    complete = F.col("lo").isNotNull() & F.col("label").isNotNull()
    per_key = keyed.groupBy("lo", "hi", "label").agg(F.count(F.lit(1)).alias("n"))
    proper = complete & (F.col("lo") != F.col("hi"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(~complete, F.col("n"))), F.lit(0)).alias("n_incomplete"),
        F.coalesce(F.sum(F.when(complete & (F.col("lo") == F.col("hi")), F.col("n"))), F.lit(0)).alias("n_self"),
        F.coalesce(F.sum(F.when(proper, F.col("n") - 1)), F.lit(0)).alias("n_duplicates"),
        F.count_if(proper).alias("n_canonical"),
    )


def assign_pair_ids(pairs: DataFrame, prefix: str = "pair_") -> DataFrame:
    """``pair_id`` by (label, protein_a, protein_b), so negatives come first."""
    numbered = dense_index(pairs, ["label", *PAIR], "__n")
    return numbered.select(F.concat(F.lit(prefix), F.col("__n").cast("string")).alias("pair_id"), *pairs.columns)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Positive and negative pairs and distinct proteins, in one pass."""
    sides = pairs.select("label", F.explode(F.array(*PAIR)).alias("protein"))
    proteins = sides.agg(F.count_distinct("protein").alias("n_proteins"))
    counts = pairs.agg(F.count_if(F.expr("label = 1")).alias("n_positive"), F.count_if(F.expr("label = 0")).alias("n_negative"), F.count(F.lit(1)).alias("n_pairs"))
    return counts.join(proteins)


def proteins_in(pairs: DataFrame) -> DataFrame:
    """Distinct endpoints of both columns."""
    return pairs.select(F.explode(F.array(*PAIR)).alias("protein_id")).filter("protein_id is not null").distinct()


def filter_organism(table: DataFrame, a: str, b: str, organism: str) -> DataFrame:
    return table.filter((F.trim(a) == organism) & (F.trim(b) == organism))


def filter_system_types(table: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    return table.filter(F.col(column).isin(list(allowed)))


def ambiguous_interactors(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which any of ``columns`` names several identifiers."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).rlike(AMBIGUOUS), F.lit(False))
    return table.filter(found)


def drop_ambiguous(table: DataFrame, columns: Sequence[str], policy: str = "error") -> DataFrame:
    if policy not in ("error", "drop"):
        raise ConstraintError(f"unknown policy {policy!r}")
    if policy == "error":
        require_empty(ambiguous_interactors(table, columns), "interactors name several identifiers")
        return table
    keep = F.lit(True)
    for c in columns:
        keep = keep & ~F.coalesce(F.col(c).rlike(AMBIGUOUS), F.lit(False))
    return table.filter(keep)


def with_drop_reason(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """``pairs`` with ``drop_reason``: which endpoint has no sequence (``protein_id`` of ``sequences``), else null."""
    ids = sequences.select("protein_id").distinct()
    known = lambda side: ids.select(F.col("protein_id").alias(f"__{side}"))
    joined = pairs.join(known("a"), F.col("protein_a") == F.col("__a"), "left").join(known("b"), F.col("protein_b") == F.col("__b"), "left")
    a, b = F.col("__a").isNull(), F.col("__b").isNull()
    reason = F.when(a & b, "missing_both_sequences").when(a, "missing_protein_a_sequence").when(b, "missing_protein_b_sequence")
    return joined.select(*pairs.columns, reason.alias("drop_reason"))


def with_sequences(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """Pairs whose endpoints both have a sequence."""
    return with_drop_reason(pairs, sequences).filter("drop_reason is null").drop("drop_reason")


def check_input(pairs: DataFrame) -> DataFrame:
    """One row of checks of a training input: rows, blank ids, repeated pair ids, labels present."""
    return pairs.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.coalesce(F.trim("pair_id"), F.lit("")) == "").alias("n_blank_ids"),
        (F.count("pair_id") - F.count_distinct("pair_id")).alias("n_repeated_ids"),
        F.count_if(F.expr("label = 0")).alias("n_negative"),
        F.count_if(F.expr("label = 1")).alias("n_positive"),
        F.count_if(F.expr("label is null or label not in (0, 1)")).alias("n_bad_labels"),
    )


def split_problems(rows: DataFrame, splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Splits that are empty or lack a class."""
    wanted = rows.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    counts = rows.groupBy("split").agg(F.count_if(F.expr("label = 0")).alias("n_negative"), F.count_if(F.expr("label = 1")).alias("n_positive"))
    joined = F.broadcast(wanted).join(counts, "split", "left").fillna(0)
    return joined.filter("n_negative = 0 or n_positive = 0")


def assignment_differences(rows: DataFrame, assignments: DataFrame, split: str = "train") -> DataFrame:
    """Row ids of ``rows`` and of the rows assigned to ``split`` that don't correspond one to one."""
    mine = rows.groupBy("source_row_index").agg(F.count(F.lit(1)).alias("n_rows"))
    theirs = assignments.filter(F.col("split") == split).groupBy("source_row_index").agg(F.count(F.lit(1)).alias("n_assigned"))
    joined = mine.join(theirs, "source_row_index", "full").fillna(0, ["n_rows", "n_assigned"])
    return joined.filter("n_rows <> 1 or n_assigned <> 1")


def identity_collisions(frame: DataFrame, short: str, spec: str) -> DataFrame:
    """Short ids that stand for more than one specification."""
    return frame.groupBy(short).agg(F.count_distinct(spec).alias("n_specs")).filter("n_specs > 1")

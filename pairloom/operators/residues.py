"""Residue-level examples: defaults, split by protein, windows around a residue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairs import require_columns, require_empty


def residue_examples(rows: DataFrame) -> DataFrame:
    """Examples with defaults: ``ptm_type`` 'unspecified', ``example_id`` protein:index:type where it is missing."""
    require_columns(rows, ["protein_id", "residue_index", "label"])
    out = rows
    for c in ("ptm_type", "residue", "example_id"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    kind = F.coalesce("ptm_type", F.lit("unspecified"))
    ident = F.coalesce("example_id", F.concat_ws(":", "protein_id", F.col("residue_index").cast("string"), kind))
    return out.select(ident.alias("example_id"), "protein_id", F.col("residue_index").cast("int"), F.upper("residue").alias("residue"), kind.alias("ptm_type"), "label")


def split_by_protein(examples: DataFrame, splits: DataFrame, strict: bool = True) -> DataFrame:
    """Examples with the split of their protein; unassigned proteins are refused, or left out if not ``strict``."""
    if strict:
        require_empty(examples.join(splits, "protein_id", "left_anti").select("protein_id").distinct(), "proteins without a split")
    return examples.join(splits.select("protein_id", "split"), "protein_id")


def windows(examples: DataFrame, sequences: DataFrame, radius: int) -> DataFrame:
    """``window`` of up to 2 * radius + 1 residues around the residue, clipped at both ends, and ``target_index``, its
    place in the window; ``residue_ok`` is false where the sequence has another residue or is too short."""
    joined = examples.join(sequences.select("protein_id", "sequence"), "protein_id")
    i = F.col("residue_index")
    start = F.greatest(i - radius, F.lit(0))
    stop = F.least(i + radius + 1, F.length("sequence"))
    found = F.substr("sequence", i + 1, F.lit(1))
    ok = (i < F.length("sequence")) & F.coalesce(found == F.col("residue"), F.lit(True))
    return joined.select(*examples.columns, F.substr("sequence", start + 1, stop - start).alias("window"), (i - start).alias("target_index"), ok.alias("residue_ok"))

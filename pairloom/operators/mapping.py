"""Identifier maps: one-to-one lookups of both endpoints, conflict-checked merges, projections to groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairs import PAIR, require_columns, require_empty
from .skew import endpoint_lookup


def normalize_mapping(table: DataFrame, raw: str, canonical: str) -> DataFrame:
    """Distinct trimmed (raw_id, canonical_id) without blanks."""
    require_columns(table, [raw, canonical])
    clean = table.select(F.trim(F.col(raw).cast("string")).alias("raw_id"), F.trim(F.col(canonical).cast("string")).alias("canonical_id"))
    return clean.filter("raw_id <> '' and canonical_id <> ''").distinct()


def build_mapping(table: DataFrame, raw: str, canonical: str) -> DataFrame:
    """(raw_id, canonical_id, n_targets): the id is null where a raw id has several targets."""
    grouped = normalize_mapping(table, raw, canonical).groupBy("raw_id").agg(F.min("canonical_id").alias("c"), F.count(F.lit(1)).alias("n_targets"))
    return grouped.select("raw_id", F.when(F.col("n_targets") == 1, F.col("c")).alias("canonical_id"), "n_targets")


def map_pairs(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """``pairs`` with mapped endpoints and ``map_status``: ambiguous before unmapped before mapped."""
    joined = endpoint_lookup(pairs, mapping.withColumnsRenamed({"canonical_id": "__id", "n_targets": "__n"}), "raw_id", ["__id", "__n"])
    ambiguous = (F.coalesce("__n_a", F.lit(0)) > 1) | (F.coalesce("__n_b", F.lit(0)) > 1)
    status = F.when(ambiguous, "ambiguous").when(F.col("__n_a").isNull() | F.col("__n_b").isNull(), "unmapped").otherwise("mapped")
    rest = [c for c in pairs.columns if c not in PAIR]
    return joined.select(F.col("__id_a").alias("protein_a"), F.col("__id_b").alias("protein_b"), *rest, status.alias("map_status"))


def mapping_counts(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy("map_status").agg(F.count(F.lit(1)).alias("n_pairs"))


def merge_maps(base: DataFrame, additional: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(union of both maps, conflicts): the additional map wins where only one of them has a value."""
    joined = base.select(key, F.col(value).alias("__base")).join(additional.select(key, F.col(value).alias("__more")), key, "full")
    merged = joined.select(key, F.coalesce("__more", "__base").alias(value))
    return merged, joined.filter("__base <> __more").select(key, F.col("__base").alias("first"), F.col("__more").alias("second"))


def resolve_taxa(from_headers: DataFrame, default_taxon: str | None, sidecar: DataFrame | None) -> DataFrame:
    """Taxa from sequence headers, then one taxon for all proteins that have none, then a sidecar; conflicts refuse."""
    out = from_headers
    if default_taxon is not None:
        out = out.withColumn("taxon_id", F.coalesce("taxon_id", F.lit(default_taxon)))
    if sidecar is not None:
        out, conflicts = merge_maps(out.filter("taxon_id is not null"), sidecar.filter("taxon_id is not null"), "protein_id", "taxon_id")
        require_empty(conflicts, "conflicting taxa")
    return out


def project_endpoints(pairs: DataFrame, table: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """``pairs`` with ``<value>_a`` and ``<value>_b`` looked up for both endpoints, null where there is none."""
    return endpoint_lookup(pairs, table, key, values)


def uncovered(pairs: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Endpoints without an entry in ``table``."""
    ends = pairs.select(F.explode(F.array(*PAIR)).alias(key)).distinct()
    return ends.join(table.select(key), key, "left_anti")

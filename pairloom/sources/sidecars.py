"""Tables beside a pair file: taxa, sequence clusters, manifests."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import file_sha256
from ..functions.text import normalize_taxon
from ..operators.pairs import ConstraintError, require_empty
from .tables import read_table


def read_taxa(spark: SparkSession, path: str) -> DataFrame:
    """(protein_id, taxon_id) with one row per protein; blank taxa are left out, blank and repeated ids refused."""
    t = read_table(spark, path, columns=["protein_id", "taxon_id"]).select(F.trim("protein_id").alias("protein_id"), normalize_taxon(F.col("taxon_id"), strict=True).alias("taxon_id"))
    require_empty(t.filter("coalesce(protein_id, '') = ''"), "blank protein id")
    require_empty(t.groupBy("protein_id").count().filter("count > 1"), "repeated protein id")
    return t.filter("taxon_id is not null")


def read_clusters(spark: SparkSession, path: str, required: DataFrame | None = None, reject_unknown: bool = False) -> DataFrame:
    """(protein_id, cluster_id), trimmed and sorted; other columns are ignored. ``required`` (protein_id) must be covered."""
    t = read_table(spark, path, columns=["protein_id", "cluster_id"]).select(F.trim("protein_id").alias("protein_id"), F.trim("cluster_id").alias("cluster_id"))
    require_empty(t.filter("coalesce(protein_id, '') = '' or coalesce(cluster_id, '') = ''"), "blank id")
    require_empty(t.groupBy("protein_id").count().filter("count > 1"), "repeated protein id")
    if required is not None:
        require_empty(required.select("protein_id").join(t, "protein_id", "left_anti"), "proteins without a cluster")
        if reject_unknown:
            require_empty(t.join(required.select("protein_id"), "protein_id", "left_anti"), "unknown proteins")
        t = t.join(required.select("protein_id"), "protein_id", "left_semi")
    return t.orderBy("protein_id")


def clusters_from_members(rows: DataFrame, eligible: DataFrame | None = None) -> DataFrame:
    """(protein_id, cluster_id) from (representative, member) rows; the id follows from the members alone.

    Member digests are combined by sums, so that no cluster is gathered; the id is the digest of number, sums and least
    member.
    """
    require_empty(rows.groupBy("member").count().filter("count > 1"), "repeated member")
    if eligible is not None:
        require_empty(rows.select(F.col("member").alias("protein_id")).join(eligible, "protein_id", "left_anti"), "unknown members")
        require_empty(eligible.join(rows.select(F.col("member").alias("protein_id")), "protein_id", "left_anti"), "proteins without a cluster")
    part = lambda i: F.bit_xor(F.conv(F.substring(F.sha2("member", 256), 1 + 15 * i, 15), 16, 10).cast("bigint"))
    ids = rows.groupBy("representative").agg(F.count(F.lit(1)).alias("n"), F.min("member").alias("m"), *(part(i).alias(f"x{i}") for i in range(4)))
    digest = F.sha2(F.to_json(F.struct("n", "m", "x0", "x1", "x2", "x3")), 256)
    named = ids.select("representative", F.concat(F.lit("sequence_cluster_"), digest).alias("cluster_id"))
    return rows.join(named, "representative").select(F.col("member").alias("protein_id"), "cluster_id")


def read_cluster_members(spark: SparkSession, path: str, eligible: DataFrame | None = None) -> DataFrame:
    """Output of a sequence clusterer: representative TAB member, without a header."""
    t = spark.read.text(path).filter("value <> ''").select(F.split("value", "\t").alias("x"))
    require_empty(t.filter("size(x) <> 2"), "lines that don't have two fields")
    return clusters_from_members(t.select(F.get("x", F.lit(0)).alias("representative"), F.get("x", F.lit(1)).alias("member")), eligible)


def discover(pairs_path: str, name: str) -> str | None:
    """The sidecar ``name`` beside a file that is called pairs.csv."""
    path = Path(pairs_path)
    beside = path.with_name(name)
    return str(beside) if path.name == "pairs.csv" and beside.is_file() else None


def read_manifest(pairs_path: str, manifest_path: str | None = None) -> dict | None:
    """The dataset manifest; it must name the digest of the pair file, or, if it is old, its path."""
    found = manifest_path or discover(pairs_path, "dataset_metadata.json")
    if found is None:
        return None
    manifest = json.loads(Path(found).read_text())
    digest = manifest.get("output_pairs_file_sha256")
    if digest is None:
        if Path(manifest.get("output_pairs", "")).name != Path(pairs_path).name:
            raise ConstraintError(f"{found} describes another pair file")
    elif digest != file_sha256(pairs_path):
        raise ConstraintError(f"{found} describes other pairs")
    return manifest

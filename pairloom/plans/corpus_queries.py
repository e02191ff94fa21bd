"""Queries on the pair corpus: dangling references (p1) and skewed keys (p4), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.accession import accession
from ..operators.orphans import orphan_keys, temporal_orphans
from ..operators.skew import per_key_counts, sketch_heavy_hitters
from ..session import load, materialize


def endpoint_references(pairs: DataFrame) -> DataFrame:
    """(protein, at, source_row_index, ref_field) for each endpoint that names a protein."""
    both = F.array(
        F.struct(F.lit("protein_a").alias("f"), accession(F.col("protein_a")).alias("p")),
        F.struct(F.lit("protein_b").alias("f"), accession(F.col("protein_b")).alias("p")),
    )
    refs = pairs.select("source_row_index", F.col("ingested_at").alias("at"), F.explode(both).alias("x"))
    return refs.select(F.col("x.p").alias("protein"), "at", "source_row_index", F.col("x.f").alias("ref_field")).filter("protein is not null")


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, fasta, splits = (load(spark, sf_dir, t) for t in ("pairs", "fasta_sequences", "split_assignments"))
    n_pairs = pairs.count()
    usable = fasta.filter(F.col("sequence") != "").select(accession(F.col("protein_id")).alias("protein"), "loaded_at", "withdrawn_at")
    endpoints = temporal_orphans(
        endpoint_references(pairs), usable, "protein", "at", "loaded_at", "withdrawn_at", fasta.count(), 2 * n_pairs
    )
    rows = orphan_keys(splits.select("source_row_index").distinct(), pairs.select("source_row_index"), "source_row_index", n_pairs)
    return endpoints.select(F.lit("pairs").alias("ref_table"), "source_row_index", "ref_field", "at").unionByName(
        rows.select(
            F.lit("split_assignments").alias("ref_table"), "source_row_index", F.lit("source_row_index").alias("ref_field"),
            F.lit(None).cast("timestamp_ntz").alias("at"),
        )
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("ref_table", "source_row_index", "ref_field")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, field and month of ingest (null for assignments, which carry no time)."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    return _orphans(spark, sf_dir).groupBy("ref_table", "ref_field", month).agg(F.count(F.lit(1)).alias("n_orphans"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(protein_id, partner, label), one row per protein that a row of pairs names; a self pair counts once."""
    pairs = load(spark, sf_dir, "pairs").select(accession(F.col("protein_a")).alias("a"), accession(F.col("protein_b")).alias("b"), "label")
    sides = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("k"), F.col("b").alias("p")))).otherwise(
        F.array(F.struct(F.col("a").alias("k"), F.col("b").alias("p")), F.struct(F.col("b").alias("k"), F.col("a").alias("p")))
    )
    ends = materialize(pairs, "pair-ends")
    return ends.select(F.explode(sides).alias("x"), "label").select(F.col("x.k").alias("protein_id"), F.col("x.p").alias("partner"), "label").filter("protein_id is not null")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per protein: rows that name it, positive ones among them, distinct partners (itself in a self pair)."""
    total = load(spark, sf_dir, "pairs").count()
    named = _named(spark, sf_dir)
    heavy = sketch_heavy_hitters(named, "protein_id", 2 * total)
    return per_key_counts(named, "protein_id", "partner", F.col("label") == 1, heavy)


def p4_found(spark: SparkSession, sf_dir: str, per_cent: int = 3) -> DataFrame:
    """Proteins named by at least ``per_cent`` % of all rows of pairs."""
    total = load(spark, sf_dir, "pairs").count()
    return p4_counts(spark, sf_dir).filter((F.col("n_rows") > 0) & (F.col("n_rows") * 100 >= per_cent * total)).select("protein_id")


def queries() -> dict:
    return {"p1_found": p1_found, "p1_report": p1_report, "p4_counts": p4_counts, "p4_found": p4_found}


def acc_sql(column: str) -> str:
    clean = rf"upper(regexp_replace({column}, '[^\p{{L}}\p{{Nd}}]+', '', 'g'))"
    return f"nullif(regexp_extract({clean}, '[A-Z]{{2}}[0-9]{{5}}[A-Z]'), '')"


_P1 = f"""
with usable as (
  select {acc_sql("protein_id")} as p, loaded_at, withdrawn_at from fasta_sequences where sequence <> ''),
refs as (
  select source_row_index, 'protein_a' as ref_field, {acc_sql("protein_a")} as p, ingested_at from pairs
  union all select source_row_index, 'protein_b', {acc_sql("protein_b")}, ingested_at from pairs),
orphans as (
  select 'pairs' as ref_table, source_row_index, ref_field, ingested_at from refs r where p is not null and not exists (
    select 1 from usable u where u.p = r.p and u.loaded_at <= r.ingested_at
      and (u.withdrawn_at is null or u.withdrawn_at > r.ingested_at))
  union all
  select distinct 'split_assignments', source_row_index, 'source_row_index', cast(null as timestamp) from split_assignments
  where source_row_index is not null and source_row_index not in (select source_row_index from pairs where source_row_index is not null))
"""
_P4 = f"""
with e as (select {acc_sql("protein_a")} as a, {acc_sql("protein_b")} as b, label from pairs),
named as (select a as protein_id, b as partner, label from e where a is not null
  union all select b, a, label from e where b is not null and a is distinct from b)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1 + "select ref_table, source_row_index, ref_field from orphans",
        "p1_report": _P1 + "select ref_table, ref_field, strftime(ingested_at, '%Y-%m') as month, count(*) as n_orphans from orphans group by all",
        "p4_counts": _P4 + "select protein_id, count(*) as n_rows, count(*) filter (label = 1) as n_positive, count(distinct partner) as n_partners from named group by 1",
        "p4_found": _P4 + "select protein_id from named group by 1 having count(*) * 100 >= 3 * (select count(*) from pairs)",
    }

"""Interaction tables and plain edge lists as positive pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import pairs as pr
from .tables import read_table

# Column names of the public interaction format, in order of preference.
INTERACTORS = ("SWISS-PROT Accessions Interactor", "Systematic Name Interactor", "Official Symbol Interactor", "BioGRID ID Interactor", "Entrez Gene Interactor")
ORGANISMS = ("Organism ID Interactor", "Organism Interactor", "Organism")
SYSTEM_TYPES = ("Experimental System Type", "System Type")


def infer_column(columns: Sequence[str], explicit: str | None, candidates: Sequence[str], role: str) -> str:
    """The named column, or the only candidate there is."""
    if explicit is not None:
        if explicit not in columns:
            raise pr.ConstraintError(f"no column {explicit!r} for {role}")
        return explicit
    found = [c for c in candidates if c in columns]
    if len(found) != 1:
        raise pr.ConstraintError(f"{role}: " + (f"several columns fit, {found}; name one" if found else f"none of {list(candidates)} is there"))
    return found[0]


def edge_pairs(table: DataFrame, a: str, b: str, label: int) -> DataFrame:
    pr.require_columns(table, [a, b])
    return table.select(F.col(a).alias("protein_a"), F.col(b).alias("protein_b"), F.lit(label).alias("label"))


def read_edges(spark: SparkSession, path: str, a: str = "protein_a", b: str = "protein_b", label: int = 1) -> DataFrame:
    return edge_pairs(read_table(spark, path, columns=[a, b]), a, b, label)


def read_interactions(
    spark: SparkSession,
    path: str,
    member: str | None = None,
    a: str | None = None,
    b: str | None = None,
    organism: str | None = None,
    organism_columns: tuple[str, str] | None = None,
    system_types: Sequence[str] | None = None,
    system_type_column: str | None = None,
    ambiguous: str = "error",
) -> tuple[DataFrame, Observation]:
    """Positive pairs that pass the filters, and counters (rows read, other organism, other system, kept) that fill in
    while the pairs are first computed, without another scan."""
    table = read_table(spark, path, member)
    col_a = infer_column(table.columns, a, [f"{c} A" for c in INTERACTORS], "interactor A")
    col_b = infer_column(table.columns, b, [f"{c} B" for c in INTERACTORS], "interactor B")
    here, fits = F.lit(True), F.lit(True)
    if organism is not None:
        oa, ob = organism_columns or (infer_column(table.columns, None, [f"{c} A" for c in ORGANISMS], "organism A"), infer_column(table.columns, None, [f"{c} B" for c in ORGANISMS], "organism B"))
        here = F.coalesce((F.trim(F.col(f"`{oa}`")) == organism) & (F.trim(F.col(f"`{ob}`")) == organism), F.lit(False))
    if system_types is not None:
        column = infer_column(table.columns, system_type_column, SYSTEM_TYPES, "system type")
        fits = F.coalesce(F.col(f"`{column}`").isin(list(system_types)), F.lit(False))
    seen = Observation("interactions")
    table = table.observe(
        seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(~here).alias("n_other_organism"), F.count_if(here & ~fits).alias("n_other_system"), F.count_if(here & fits).alias("n_kept")
    )
    kept = pr.drop_ambiguous(table.filter(here & fits).select(F.col(f"`{col_a}`").alias("a"), F.col(f"`{col_b}`").alias("b")), ["a", "b"], ambiguous)
    return edge_pairs(kept, "a", "b", 1), seen


def check_mapping_options(id_map: str | None, map_from: str | None, map_to: str | None) -> None:
    """An identifier map and its two columns go together."""
    given = [x is not None for x in (id_map, map_from, map_to)]
    if any(given) and not all(given):
        raise pr.ConstraintError("an id map needs its file and both of its columns")

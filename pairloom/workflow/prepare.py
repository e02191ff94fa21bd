"""Prepare a dataset: read, map, add negatives, canonicalise, keep pairs with sequences, number, write."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mapping, sampling
from ..operators import pairs as pr
from ..session import materialize
from ..sinks.writers import file_record, write_dataset
from ..sources.fasta import read_fasta
from ..sources.interactions import check_mapping_options, read_edges, read_interactions
from ..sources.sidecars import read_taxa
from ..sources.tables import read_table


@dataclass(frozen=True)
class PrepareOptions:
    fasta: str
    out_dir: str
    loader: str = "generic_edges"
    dataset_name: str = "dataset"
    positive_pairs: str | None = None
    negative_pairs: str | None = None
    interactions: str | None = None
    archive_member: str | None = None
    protein_a_col: str | None = None
    protein_b_col: str | None = None
    organism_id: str | None = None
    allowed_system_types: tuple[str, ...] | None = None
    system_type_col: str | None = None
    ambiguous_id_policy: str = "error"
    id_map: str | None = None
    map_from_col: str | None = None
    map_to_col: str | None = None
    fasta_id_format: str = "first_token"
    taxon_id: str | None = None
    protein_metadata: str | None = None
    sample_negatives: bool = False
    negative_sampling_policy: str = "taxon_pair_matched"
    negative_ratio: float = 1.0
    seed: int = 0
    overwrite: bool = False

    def __post_init__(self) -> None:
        check_mapping_options(self.id_map, self.map_from_col, self.map_to_col)
        if self.sample_negatives and self.negative_pairs:
            raise pr.ConstraintError("negatives are sampled or given, not both")
        if self.loader not in ("generic_edges", "interactions"):
            raise pr.ConstraintError(f"unknown loader {self.loader!r}")


def _positives(spark: SparkSession, o: PrepareOptions) -> DataFrame:
    if o.loader == "interactions":
        rows, _ = read_interactions(
            spark, o.interactions, o.archive_member, o.protein_a_col, o.protein_b_col, o.organism_id, None, o.allowed_system_types, o.system_type_col, o.ambiguous_id_policy
        )
    else:
        rows = read_edges(spark, o.positive_pairs, o.protein_a_col or "protein_a", o.protein_b_col or "protein_b", 1)
    if o.id_map is not None:
        table = mapping.build_mapping(read_table(spark, o.id_map), o.map_from_col, o.map_to_col)
        rows = mapping.map_pairs(rows, table).filter("map_status = 'mapped'").drop("map_status")
    return rows


def prepare(spark: SparkSession, o: PrepareOptions) -> dict:
    """Writes the dataset; returns its manifest."""
    records = materialize(read_fasta(spark, o.fasta, o.fasta_id_format), "fasta")
    sidecar = read_taxa(spark, o.protein_metadata) if o.protein_metadata else None
    taxa = mapping.resolve_taxa(records.select("protein_id", "taxon_id"), o.taxon_id, sidecar).filter("taxon_id is not null")
    sequences = records.select("protein_id", "sequence")
    positives = materialize(pr.normalize_pairs(_positives(spark, o)), "positives")
    pr.require_empty(pr.invalid_pairs(positives), "incomplete pairs")
    spec = None
    if o.sample_negatives:
        spec = sampling.NegativeSpec(o.negative_sampling_policy, o.negative_ratio, o.seed)
        known = pr.with_sequences(pr.canonicalize(positives), sequences)
        negatives = sampling.sample_negatives(known, spec, taxa)
    elif o.negative_pairs:
        negatives = pr.normalize_pairs(read_edges(spark, o.negative_pairs, o.protein_a_col or "protein_a", o.protein_b_col or "protein_b", 0))
    else:
        raise pr.ConstraintError("negatives must be sampled or given")
    everything = materialize(positives.unionByName(negatives), "all-pairs")
    canonical = pr.canonicalize(everything)
    pr.require_empty(pr.contradictions(canonical), "pairs with both labels")
    kept = materialize(pr.assign_pair_ids(pr.with_sequences(canonical, sequences)), "kept")
    counts = kept.agg(F.count_if(F.expr("label = 1")), F.count_if(F.expr("label = 0"))).first()
    manifest = {
        "dataset_name": o.dataset_name, "loader": o.loader, "options": {k: v for k, v in asdict(o).items() if k not in ("out_dir", "overwrite")},
        "inputs": {k: file_record(getattr(o, k)) for k in ("fasta", "positive_pairs", "negative_pairs", "interactions", "id_map", "protein_metadata")},
        "counters": pr.canonical_counters(everything).first().asDict(), "n_positive": counts[0], "n_negative": counts[1],
        "negatives": sampling.negative_record(spec, counts[0], counts[1]),
    }
    return write_dataset(kept, sequences, taxa, o.out_dir, manifest, o.overwrite)

"""Writers: prepared datasets, split artifacts, appends that check themselves, files that never change."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digests import file_sha256
from ..operators.pairs import ConstraintError, require_empty


def write_json(value: object, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, sort_keys=True, indent=2) + "\n")


def append_jsonl(value: dict, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a") as f:
        f.write(json.dumps(value, sort_keys=True) + "\n")


def write_single_csv(df: DataFrame, path: str | Path, order: Sequence[str] = ()) -> None:
    """One CSV file with a header, for tables that people and other tools read; large tables belong into Parquet."""
    import shutil
    import tempfile

    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    folder = tempfile.mkdtemp(dir=path.parent)
    rows = df.orderBy(*order) if order else df
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(f"{folder}/csv")
    parts = sorted(Path(folder, "csv").glob("part-*.csv"))
    if parts:
        os.replace(parts[0], path)
    else:
        path.write_text(",".join(df.columns) + "\n")
    shutil.rmtree(folder)


def write_fasta(sequences: DataFrame, ids: DataFrame, folder: str) -> None:
    """Records of ``ids`` in order as text files below ``folder``; an id without a sequence is refused."""
    require_empty(ids.select("protein_id").join(sequences, "protein_id", "left_anti"), "ids without a sequence")
    wanted = sequences.join(ids.select("protein_id").distinct(), "protein_id", "left_semi")
    wanted.orderBy("protein_id").select(F.concat(F.lit(">"), "protein_id", F.lit("\n"), "sequence").alias("value")).write.mode("overwrite").text(folder)


def protein_taxa(ids: DataFrame, taxa: DataFrame) -> DataFrame:
    """(protein_id, taxon_id) of all ``ids``, null where no taxon is known."""
    return ids.select("protein_id").distinct().join(taxa.select("protein_id", "taxon_id"), "protein_id", "left")


def prepare_folder(path: str, overwrite: bool = False) -> Path:
    folder = Path(path)
    if folder.exists() and any(folder.iterdir()) and not overwrite:
        raise ConstraintError(f"{path} exists")
    folder.mkdir(parents=True, exist_ok=True)
    return folder


def file_record(path: str | None) -> dict | None:
    """Path, digest and size of an input."""
    if path is None or not Path(path).exists():
        return None
    files = [p for p in Path(path).rglob("*") if p.is_file()] if Path(path).is_dir() else [Path(path)]
    return {"path": str(path), "sha256": file_sha256(path), "bytes": sum(p.stat().st_size for p in files)}


def write_dataset(pairs: DataFrame, sequences: DataFrame, taxa: DataFrame, out_dir: str, manifest: dict, overwrite: bool = False) -> dict:
    """pairs.csv, proteins.fasta (a folder of ordered parts), protein_metadata.csv and the manifest that binds them;
    both labels must be there."""
    labels = {r[0] for r in pairs.select("label").distinct().collect()}
    if labels != {0, 1}:
        raise ConstraintError(f"both labels are needed, not {sorted(labels)}")
    folder = prepare_folder(out_dir, overwrite)
    ids = pairs.select(F.explode(F.array("protein_a", "protein_b")).alias("protein_id")).distinct()
    write_single_csv(pairs, folder / "pairs.csv", ["label", "protein_a", "protein_b"])
    write_fasta(sequences, ids, str(folder / "proteins.fasta"))
    write_single_csv(protein_taxa(ids, taxa), folder / "protein_metadata.csv", ["protein_id"])
    manifest = manifest | {"output_pairs": "pairs.csv", "output_pairs_file_sha256": file_sha256(folder / "pairs.csv")}
    write_json(manifest, folder / "dataset_metadata.json")
    return manifest


def write_split(rows: DataFrame, out_dir: str, metadata: dict, clusters: DataFrame | None = None) -> None:
    """split_assignments, dropped_pairs (with reasons), clusters and the metadata of a split."""
    folder = Path(out_dir)
    kept = rows.filter("split <> 'dropped'")
    columns = [c for c in ("source_row_index", "split", "pair_id") if c in rows.columns]
    write_single_csv(kept.select(*columns), folder / "split_assignments.csv", ["source_row_index"])
    if "drop_reason" in rows.columns:
        dropped = [c for c in ("source_row_index", "drop_reason", "pair_id") if c in rows.columns]
        write_single_csv(rows.filter("split = 'dropped'").select(*dropped), folder / "dropped_pairs.csv", ["source_row_index"])
    if clusters is not None:
        write_single_csv(clusters, folder / "sequence_clusters.csv", ["protein_id"])
    write_json(metadata, folder / "split_metadata.json")


def append_table(rows: DataFrame, path: str) -> None:
    """Append to a Parquet table whose columns must be the same, in the same order."""
    spark = rows.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        there = spark.read.parquet(path).columns
        if there != rows.columns:
            raise ConstraintError(f"{path} has the columns {there}, not {rows.columns}")
    rows.write.mode("append").parquet(path)


def append_once(rows: DataFrame, path: str, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-12) -> None:
    """Append rows whose keys are new; rows whose keys are there must agree with them within the tolerance."""
    spark = rows.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        rows.write.parquet(path)
        return
    there = spark.read.parquet(path)
    old = there.select(*(F.col(k).alias(f"__{k}") for k in keys), *(F.col(v).alias(f"__{v}") for v in values))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    differs = F.lit(False)
    for v in values:
        near = F.abs(F.col(v) - F.col(f"__{v}")) <= tolerance + tolerance * F.abs(F.col(f"__{v}"))
        differs = differs | ~(F.coalesce(near, F.lit(False)) | (F.col(v).isNull() & F.col(f"__{v}").isNull()))
    require_empty(rows.join(old, same).filter(differs).select(*keys), f"rows differ from those in {path}")
    rows.join(old, same, "left_anti").write.mode("append").parquet(path)


def create_or_equal(value: dict, path: str | Path) -> dict:
    """Write a JSON file once; later it must hold the same."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    text = json.dumps(value, sort_keys=True, indent=2) + "\n"
    try:
        with open(target, "x") as f:
            f.write(text)
    except FileExistsError:
        if json.loads(target.read_text()) != json.loads(text):
            raise ConstraintError(f"{path} is fixed and holds something else") from None
    return value


def output_plan(run_dir: str) -> dict[str, Path]:
    """Where a run puts what."""
    base = Path(run_dir)
    plan = {f"{s}_{k}": base / f"{s}_{k}.csv" for s in ("train", "val", "test") for k in ("metrics", "metrics_summary", "degree_metrics", "degree_metrics_summary")}
    return plan | {
        "split": base / "split", "predictions": base / "test_predictions", "performance": base / "performance.jsonl", "invocations": base / "invocations.jsonl",
        "cohort": base / "selected_examples.csv", "degree_profile": base / "training_positive_degree.csv", "claim": base / "run_claim.json", "fingerprint": base / "run_fingerprint.json",
    }

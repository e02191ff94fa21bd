"""Result tables of many runs: discovery, tagged unions, older schemas."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pairs import ConstraintError, require_columns
from .tables import read_table

# Names of a run's files, and the columns that each schema version of a result table must have.
CLAIM, FINGERPRINT, METADATA = "run_claim.json", "run_fingerprint.json", "split/split_metadata.json"
SCHEMA_VERSION = 3
REQUIRED = {
    1: ("classifier", "model_name"),
    2: ("model_name", "estimator_id", "configuration_id", "matrix_source"),
    3: (
        "model_name", "estimator_id", "configuration_id", "matrix_source", "estimator_params", "feature_spec_sha256", "feature_identity",
        "fitted_extractor_sha256", "features", "matrix_schema_id", "pair_composition_schema_id", "reporting_group",
    ),
}
NEW_IDENTITY = (
    "feature_spec_sha256", "fitted_extractor_sha256", "matrix_schema_id", "pair_composition_schema_id", "matrix_contract_sha256",
    "row_identity_sha256", "matrix_sha256", "matrix_persisted",
)


def run_directories(root: str) -> list[str]:
    """Finished runs below ``root``; a claimed one without a fingerprint, or the reverse, is refused."""
    base, out = Path(root), set()
    for p in base.rglob(CLAIM):
        if not (p.parent / FINGERPRINT).is_file():
            raise ConstraintError(f"unfinished run {p.parent}")
        if not (p.parent / METADATA).is_file():
            raise ConstraintError(f"run without split metadata {p.parent}")
        out.add(str(p.parent))
    for p in base.rglob(FINGERPRINT):
        if not (p.parent / CLAIM).is_file():
            raise ConstraintError(f"fingerprint without a claim in {p.parent}")
    out |= {str(p.parent.parent) for p in base.rglob(METADATA)}
    return sorted(out)


def normalize_results(rows: DataFrame, identities: dict[str, dict] | None = None, allow_unversioned: bool = False) -> DataFrame:
    """Result rows of schema 1, 2 or 3 with the columns of today; mixed or unknown versions are refused.

    ``identities`` maps a model name of schema 1 to its estimator_id, estimator_params, matrix_source, reporting_group.
    """
    if "evaluation_schema_version" not in rows.columns:
        if not (allow_unversioned and "classifier" in rows.columns):
            raise ConstraintError("no evaluation_schema_version")
        rows = rows.withColumn("evaluation_schema_version", F.lit(1))
    versions = [r[0] for r in rows.select(F.col("evaluation_schema_version").cast("int")).distinct().limit(10).collect()]
    if not versions:
        return rows
    if len(versions) > 1:
        raise ConstraintError(f"mixed schema versions {sorted(versions)}")
    version = versions[0]
    if version not in REQUIRED:
        raise ConstraintError(f"unknown schema version {version}")
    require_columns(rows, REQUIRED[version])
    if version > 1:
        if "classifier" in rows.columns:
            raise ConstraintError("a classifier column belongs to schema 1 only")
        return rows
    fields = ("estimator_id", "estimator_params", "matrix_source", "reporting_group")
    known = identities or {}
    table = rows.sparkSession.createDataFrame([(n, *(str(i[f]) for f in fields)) for n, i in known.items()], "__name string, " + ", ".join(f"{f} string" for f in fields))
    out = rows.drop(*fields).withColumn("configuration_id", F.col("model_name")).withColumn("model_name", F.col("classifier"))
    unknown = [r[0] for r in out.select("model_name").distinct().limit(1000).collect() if r[0] not in known]
    if unknown:
        raise ConstraintError(f"no identity for the models {sorted(unknown)}")
    out = out.join(F.broadcast(table), F.col("model_name") == F.col("__name"), "left").drop("__name", "classifier")
    out = out.withColumn("feature_identity", F.col("features") if "features" in out.columns else F.lit(None).cast("string"))
    for c in NEW_IDENTITY:
        out = out.withColumn(c, F.lit(None).cast("string"))
    return out


def legacy_matrix(name: str) -> tuple[str, str]:
    """(source, split) of a matrix name of schema 1."""
    if name.startswith("degree_"):
        return "training_degree", name.removeprefix("degree_")
    return "configured", name


def _union(parts: Sequence[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def read_degree_metrics(spark: SparkSession, run_dirs: Sequence[str], splits: Sequence[str] = ("val", "test"), gates: Sequence[str] = ()) -> DataFrame | None:
    """Degree metrics of many runs, tagged with ``run_dir``; absent and empty files are passed over, a file that holds
    another split than its name says, or lacks a gate, is refused."""
    parts = []
    for run in run_dirs:
        for split in splits:
            path = Path(run) / f"{split}_degree_metrics.csv"
            if not path.is_file() or path.stat().st_size == 0:
                continue
            rows = read_table(spark, str(path))
            require_columns(rows, ["split", *gates])
            other = [r[0] for r in rows.filter(~F.col("split").eqNullSafe(F.lit(split))).select("split").limit(1).collect()]
            if other:
                raise ConstraintError(f"{path} holds the split {other[0]}")
            parts.append(rows.withColumn("run_dir", F.lit(str(run))))
    return _union(parts)


def read_run_summaries(spark: SparkSession, runs: Sequence[tuple[str, dict]], splits: Sequence[str] = ("train", "val", "test")) -> DataFrame | None:
    """Metric summaries of many runs with the context of each run in front, where the table lacks it."""
    parts = []
    for run, context in runs:
        for split in splits:
            path = Path(run) / f"{split}_metrics_summary.csv"
            if not path.is_file() or path.stat().st_size == 0:
                continue
            rows = read_table(spark, str(path))
            first = {k: v for k, v in (context | {"run_dir": run, "summary_split": split}).items() if k not in rows.columns}
            parts.append(rows.select(*(F.lit(v if v is None or isinstance(v, (str, int, float, bool)) else json.dumps(v)).cast("string").alias(k) for k, v in first.items()), *rows.columns))
    return _union(parts)


def manifest_row(run: str) -> dict:
    """What the manifest says about one run: its protocol, seeds, diagnostics (prefixed) and options."""
    meta = json.loads((Path(run) / METADATA).read_text())
    row = {"run_dir": run} | {k: v for k, v in meta.items() if not isinstance(v, (dict, list))}
    row |= {f"diagnostics_{k}": v for k, v in (meta.get("diagnostics") or {}).items() if not isinstance(v, dict)}
    log = Path(run) / "invocations.jsonl"
    calls = [json.loads(x) for x in log.read_text().splitlines() if x.strip()] if log.is_file() else []
    options: dict[str, list] = {}
    for call in calls:
        for k, v in (call.get("args") or {}).items():
            options.setdefault(k, []).extend(v if isinstance(v, list) else [v])
    row |= {f"option_{k}": json.dumps(list(dict.fromkeys(map(str, v)))) for k, v in options.items()}
    row["n_invocations"] = len(calls)
    return row

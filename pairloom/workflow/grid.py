"""Grids of experiments: profiles, TOML files, options; cells share one session; results are one union."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields
from itertools import product
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models.estimators import spec
from ..operators import summaries
from ..operators.features import feature_name
from ..operators.pairs import ConstraintError, require_empty
from ..session import materialize
from ..sinks.writers import create_or_equal, write_json, write_single_csv
from ..sources.runs import manifest_row, read_degree_metrics, read_run_summaries, run_directories
from .train import TrainOptions, train

# The two built-in profiles.
PROFILES = {
    "laptop": {"max_pairs": 10_000, "n_split_trials": 25, "feature_sets": (("tfidf",), ("count",)), "classifiers": ("degree_logistic", "always_positive", "always_negative", "sgd_logistic")},
    "exhaustive": {
        "max_pairs": None, "n_split_trials": 100, "feature_sets": (("tfidf",), ("bm25",), ("count",), ("binary",), ("tfidf", "bm25", "count", "binary")),
        "classifiers": ("degree_logistic", "always_positive", "always_negative", "logistic", "linear_svm", "sgd_logistic"),
    },
}


@dataclass(frozen=True)
class GridConfig:
    pairs: str
    fasta: str
    out_dir: str
    run_name: str
    profile: str = "exhaustive"
    protein_metadata: str | None = None
    sequence_clusters: str | None = None
    max_pairs: int | None = None
    full_cohort: bool = False
    sampling_seed: int = 0
    train_size: float = 0.8
    val_size: float = 0.1
    split_strategies: tuple[str, ...] = ("random", "c1", "c2", "c3")
    split_seeds: tuple[int, ...] = (0, 1, 2)
    model_seeds: tuple[int, ...] = (100, 101)
    n_split_trials: int = 25
    feature_sets: tuple[tuple[str, ...], ...] = ()
    classifiers: tuple[str, ...] = ()
    k: int = 3
    max_iter: int = 1000
    degree_bin_quantiles: tuple[float, float] = (0.5, 0.9)
    aggregate_results: bool = True

    def __post_init__(self) -> None:
        def unique(name: str) -> tuple[bool, str]:
            values = getattr(self, name)
            return (not values or len(set(values)) != len(values), f"{name} must be there and differ")

        models = [m for m in self.classifiers if spec(m).matrix == "configured"]
        for wrong, message in [
            (not re.fullmatch(r"[A-Za-z0-9._-]+", self.run_name), "a run name has letters, digits, '.', '_' and '-' only"),
            (self.profile not in PROFILES, f"unknown profile {self.profile!r}"),
            (self.max_pairs is not None and self.max_pairs < 1, "max_pairs must be positive"),
            (min(self.n_split_trials, self.k, self.max_iter) < 1, "trials, k and iterations must be positive"),
            *(unique(n) for n in ("split_strategies", "split_seeds", "model_seeds", "classifiers")),
            (self.sequence_clusters is not None and not set(self.split_strategies) <= {"c2", "c3"}, "clusters go with C2 and C3 only; use a grid of their own"),
            (bool(models) and not self.feature_sets, "models on features need a feature set"),
            (len(set(self.feature_sets)) != len(self.feature_sets) or any(not f for f in self.feature_sets), "feature sets must not be empty and differ"),
        ]:
            if wrong:
                raise ConstraintError(message)
        self.cell("random" if self.sequence_clusters is None else "c2", 0, "check", self.feature_sets[0] if self.feature_sets else ("tfidf",), self.classifiers)

    @property
    def folder(self) -> Path:
        return Path(self.out_dir) / self.run_name

    def cell(self, strategy: str, seed: int, name: str, feature_set: tuple[str, ...], models: tuple[str, ...]) -> TrainOptions:
        return TrainOptions(
            self.pairs, self.fasta, str(self.folder / "runs" / strategy / f"split_seed_{seed}" / name), self.protein_metadata, self.sequence_clusters, self.max_pairs, None,
            self.sampling_seed, self.train_size, self.val_size, strategy, None, seed, self.n_split_trials, feature_set, self.k, classifier=models, max_iter=self.max_iter,
            degree_bin_quantiles=self.degree_bin_quantiles, model_seeds=self.model_seeds,
        )


def _exact(value: object, kind: type) -> object:
    """A number of a file as the type of its option; one that would lose something is refused."""
    if kind is int:
        if isinstance(value, bool) or not isinstance(value, (int, float)) or value != int(value):
            raise ConstraintError(f"{value!r} is no whole number")
        return int(value)
    if kind is float:
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ConstraintError(f"{value!r} is no number")
        return float(value)
    return value


def load_toml(path: str) -> dict:
    with open(path, "rb") as f:
        data = tomllib.load(f)
    unknown = set(data) - {"grid"}
    if unknown:
        raise ConstraintError(f"unknown sections {sorted(unknown)}")
    return data.get("grid", {})


def resolve(options: Mapping[str, object], config: str | None = None) -> GridConfig:
    """Options given win over the file, the file over the profile."""
    file = load_toml(config) if config else {}
    names = {f.name: f for f in fields(GridConfig)}
    unknown = set(file) - set(names)
    if unknown:
        raise ConstraintError(f"unknown options {sorted(unknown)}")
    merged = file | {k: v for k, v in options.items() if v is not None}
    profile = str(merged.get("profile", "exhaustive"))
    merged = PROFILES.get(profile, {}) | merged
    if merged.get("full_cohort"):  # all pairs, unless the caller asks for a number of them
        if options.get("max_pairs") is None:
            merged["max_pairs"] = None
        else:
            merged["full_cohort"] = False
    whole = ("max_pairs", "sampling_seed", "n_split_trials", "k", "max_iter")
    for name, value in merged.items():
        if name in whole and value is not None:
            merged[name] = _exact(value, int)
        elif name in ("train_size", "val_size"):
            merged[name] = _exact(value, float)
        elif isinstance(value, list):
            merged[name] = tuple(tuple(v) if isinstance(v, list) else v for v in value)
    return GridConfig(**merged)


def cells(config: GridConfig) -> list[TrainOptions]:
    """Strategies by split seeds by (models without features, then each feature set)."""
    controls = tuple(m for m in config.classifiers if spec(m).matrix != "configured")
    models = tuple(m for m in config.classifiers if spec(m).matrix == "configured")
    out = []
    for strategy, seed in product(config.split_strategies, config.split_seeds):
        if controls:
            out.append(config.cell(strategy, seed, "controls", ("tfidf",), controls))
        out += [config.cell(strategy, seed, feature_name(f), f, models) for f in config.feature_sets if models]
    return out


def run_grid(spark: SparkSession, config: GridConfig) -> Path:
    if (config.folder / "grid.json").exists():
        raise ConstraintError(f"{config.folder} holds a grid")
    write_json(asdict(config), config.folder / "grid.json")
    for cell in cells(config):
        train(spark, cell)
    if config.aggregate_results:
        aggregate(spark, str(config.folder))
    return config.folder


def aggregate(spark: SparkSession, folder: str, execution_prefix: str | None = None) -> dict[str, DataFrame]:
    """Manifest, metric summary, degree summary, train-validation table, control selection and lift of all runs below
    ``folder``, also as files."""
    runs = run_directories(folder)
    if not runs:
        raise ConstraintError(f"no runs below {folder}")
    manifest = [manifest_row(r) for r in runs]
    columns = sorted({k for row in manifest for k in row})
    table = spark.createDataFrame([tuple(None if row.get(c) is None else str(row[c]) for c in columns) for row in manifest], ", ".join(f"`{c}` string" for c in columns))
    out = {"manifest": table}
    context = [(r, {k: row.get(k) for k in ("split_strategy", "split_seed", "protocol_id")}) for r, row in zip(runs, manifest, strict=True)]
    summary = read_run_summaries(spark, context)
    if summary is not None:
        out["summary"] = summary
        flat = summary.withColumn("grouping", F.lit("identity")).withColumn("negative_context", F.lit(None).cast("string"))
        flat = flat.withColumn("execution_id", F.col("run_dir")).withColumn("f1_mean", F.col("f1_mean").try_cast("double"))
        out["train_val_f1"] = summaries.train_val_f1(flat, execution_prefix)
    degree = read_degree_metrics(spark, runs)
    if degree is not None:
        values = ["auprc", "auroc", "prevalence"]
        numeric = degree.select(*[c for c in degree.columns if c not in values], *(F.col(v).try_cast("double").alias(v) for v in values))
        seeds = {r: row.get("split_seed") for r, row in zip(runs, manifest, strict=True)}
        tagged = numeric.drop("split_seed").join(F.broadcast(spark.createDataFrame(list(seeds.items()), "run_dir string, split_seed string")), "run_dir")
        out["degree_summary"] = summaries.summarize_over_seeds(summaries.deduplicate_attachment(tagged), ["split", "model_name", "axis", "stratum"], values)
        if all(g in degree.columns for g in summaries.GATES):
            out |= _lift(numeric.withColumn("split_seed", F.col("split_seed").cast("int")), folder)
    for name, df in out.items():
        write_single_csv(df, Path(folder) / f"{name}.csv")
    return out


def _lift(rows: DataFrame, folder: str) -> dict[str, DataFrame]:
    """The control selected per context, fixed by a file, and the lift of each model over it.

    A model whose reference lies behind other gates is an error; one whose runs have no control or attachment score at
    all has no lift.
    """
    rows = materialize(rows, "gated")
    selection = materialize(summaries.select_control(rows), "selection")
    lock_control(selection, f"{folder}/selected_controls.json")
    refused = summaries.lift_refusals(rows, selection)
    require_empty(refused.filter("refusal like '%other gates'"), "refused lift")
    lift = materialize(summaries.degree_lift(rows, selection, strict=False), "lift")
    return {"control_selection": selection, "degree_lift": lift, "lift_table": summaries.lift_table(lift)}


def lock_control(selection: DataFrame, path: str) -> dict:
    """Write the selected control of each context once; a later, different selection is refused."""
    return create_or_equal({r[0]: r[1] for r in selection.select("control_selection_context_sha256", "selected_control").collect()}, path)



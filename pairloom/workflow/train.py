"""One experiment: cohort, split, audits, degrees, features, models, metrics, sealed run directory."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import file_sha256, json_sha256, table_sha256
from ..models.estimators import dense_vector, sparse_vectors, spec
from ..models.runner import fit_and_evaluate
from ..operators import audit, degree, features, metrics, sampling, splits, summaries
from ..operators import pairs as pr
from ..session import materialize
from ..sinks.writers import append_jsonl, output_plan, write_single_csv, write_split
from ..sources.fasta import read_fasta
from ..sources.sidecars import discover, read_clusters, read_manifest, read_taxa
from ..sources.tables import read_table
from .identity import claim, fingerprint, run_identity
from .performance import Tracker


@dataclass(frozen=True)
class TrainOptions:
    pairs: str
    fasta: str
    run_dir: str
    protein_metadata: str | None = None
    sequence_clusters: str | None = None
    max_pairs: int | None = None
    sample_fraction: float | None = None
    sampling_seed: int = 0
    train_size: float = 0.8
    val_size: float = 0.1
    split_strategy: str = "random"
    split_col: str | None = None
    split_seed: int = 0
    n_split_trials: int = 100
    features: tuple[str, ...] = ("tfidf",)
    k: int = 3
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    classifier: tuple[str, ...] = ("logistic",)
    threshold_selection: str = "validation_f1"
    degree_bin_quantiles: tuple[float, float] = (0.5, 0.9)
    max_iter: int = 1000
    model_seeds: tuple[int, ...] = (0,)
    eval_test_set: bool = False

    def __post_init__(self) -> None:
        q = self.degree_bin_quantiles
        problems = [
            (self.max_pairs is not None and self.sample_fraction is not None, "give a number of pairs or a fraction, not both"),
            (self.split_col is None and not 0 < self.train_size < 1, "train_size must lie between 0 and 1"),
            (self.split_col is None and self.train_size + self.val_size >= 1, "train_size and val_size leave nothing to test"),
            (self.split_col is not None and self.split_strategy not in ("random", "provided_column"), "a split column excludes a strategy"),
            (not (len(q) == 2 and 0 < q[0] < q[1] < 1), "two rising quantiles between 0 and 1 are needed"),
            (self.sequence_clusters is not None and self.split_strategy not in ("c2", "c3"), "clusters go with C2 and C3 only"),
            (len(set(self.model_seeds)) != len(self.model_seeds) or not self.model_seeds, "model seeds must be there and differ"),
            (any(f not in ("count", "binary", "tfidf", "bm25") for f in self.features), "unknown features"),
            (len(set(self.classifier)) != len(self.classifier) or not self.classifier, "models must be there and differ"),
        ]
        for wrong, message in problems:
            if wrong:
                raise pr.ConstraintError(message)
        for name in self.classifier:
            spec(name)


def load_pairs(spark: SparkSession, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The pair table with ``source_row_index`` in the order of ``pair_id`` numbers (the order it was written in)."""
    rows = read_table(spark, path)
    order = [F.regexp_extract("pair_id", r"(\d+)$", 1).try_cast("bigint"), "pair_id"] if "pair_id" in rows.columns else rows.columns
    normal = pr.normalize_pairs(rows, keep=[c for c in ("pair_id", *keep) if c in rows.columns])
    pr.require_empty(pr.invalid_pairs(normal), "incomplete pairs")
    return pr.with_source_row_index(normal, order)


def make_split(spark: SparkSession, rows: DataFrame, o: TrainOptions) -> DataFrame:
    test = 1 - o.train_size - o.val_size
    if o.split_col is not None:
        return splits.provided(rows, o.split_col)
    if o.split_strategy == "random":
        return splits.random_pairs(rows, "source_row_index", o.train_size, o.val_size, o.split_seed)
    if o.split_strategy == "c1":
        return splits.c1(rows, o.val_size, test, o.split_seed)
    groups = pr.proteins_in(rows).withColumn("group_id", F.col("protein_id"))
    if o.sequence_clusters:
        groups = read_clusters(spark, o.sequence_clusters, pr.proteins_in(rows)).withColumnRenamed("cluster_id", "group_id")
    return splits.entity_split(rows, groups, o.split_strategy, o.val_size, test, o.split_seed, o.n_split_trials)


def feature_rows(rows: DataFrame, sequences: DataFrame, o: TrainOptions) -> DataFrame:
    """(source_row_index, features): the configured k-mer blocks of both endpoints, composed symmetrically.

    Every one of ``rows`` is there; a pair without a k-mer of the training vocabulary has the vector of zeros.
    """
    train = rows.filter("split = 'train'")
    counts = features.term_counts(sequences, "protein_id", "sequence", o.k)
    ids = pr.proteins_in(train).select(F.col("protein_id").alias("row_id"))
    options = {"bm25": {"k1": o.bm25_k1, "b": o.bm25_b}}
    blocks = {f: features.feature_table(counts, ids, f, **options.get(f, {})) for f in dict.fromkeys(o.features)}
    stacked = features.stack_features(blocks).drop("block")
    long = materialize(features.compose_sparse(rows, stacked, "source_row_index").withColumnRenamed("pair_id", "source_row_index"), "composed")
    return sparse_vectors(long, train, "source_row_index", rows=rows)


def gate_digests(o: TrainOptions, kept: DataFrame, meta: dict, splits_of: list[str], negatives: dict | None) -> dict[str, dict]:
    """Per evaluated split the identity columns behind which results may be compared (see ``summaries.GATES``).

    The context in which controls are selected knows neither strategy nor seed, as the selection runs over both.
    """
    training = kept.filter("split = 'train'")
    identity = ["source_row_index", "protein_a", "protein_b", "label"]
    edges = table_sha256(degree.positive_edges(training), ["lo", "hi"])
    grouping = file_sha256(o.sequence_clusters) if o.sequence_clusters else None
    negative = json_sha256(negatives) if negatives else None
    cohort = {k: getattr(o, k) for k in ("max_pairs", "sample_fraction", "sampling_seed")}
    common = {
        "task": "pairs", "split_strategy": meta["split_strategy"], "protocol_id": meta["protocol_id"], "protocol_version": meta["protocol_id"].rsplit(".v", 1)[-1],
        "split_seed": o.split_seed, "dataset_sha256": meta["dataset_sha256"], "training_positive_edges_sha256": edges,
        "training_examples_sha256": table_sha256(training, identity), "split_assignments_sha256": meta["split_assignments_sha256"],
        "negative_construction_sha256": negative, "grouping_sha256": grouping,
        "protocol_instance_sha256": json_sha256({"protocol": meta["protocol_id"], "train": o.train_size, "val": o.val_size, "trials": o.n_split_trials, "cohort": cohort}),
        "degree_provenance_sha256": json_sha256({"edges": edges, "quantiles": list(o.degree_bin_quantiles)}),
        "control_selection_context_sha256": json_sha256({"task": "pairs", "dataset": meta["dataset_sha256"], "negative": negative, "grouping": grouping, "cohort": cohort}),
    }
    return {s: common | {"evaluation_cohort_sha256": table_sha256(kept.filter(F.col("split") == s), identity)} for s in splits_of}


def degree_report(scored: DataFrame, strategy: str, name: str, role: str, number: int | None, seed: int | None) -> DataFrame:
    """Threshold-free metrics of ``scored`` (annotated rows with ``score`` and ``target``) per split and stratum; models
    that are no control are reported as a whole only."""
    long = degree.stratified(scored, strategy, ["split", "target", "score"])
    if role == "predictive_model":
        long = long.filter("axis = 'global'")
    out = metrics.ranking_metrics(long, "split", "axis", "stratum").withColumn("stratification_axis", F.col("axis"))
    return out.select(
        "*", F.lit(name).alias("model_name"), F.lit(role).alias("model_role"), F.lit(number).cast("int").alias("run_number"), F.lit(seed).cast("int").alias("model_seed")
    )


def check_attachment(scored: DataFrame, strategy: str) -> None:
    """Where no endpoint is known from training, attachment says nothing: its scores must be constant."""
    if strategy == degree.C3:
        pr.require_empty(metrics.degree_invariants(scored.select("split", "target", "score"), "split").filter("not holds"), "attachment scores vary in C3")


def train(spark: SparkSession, o: TrainOptions) -> dict:
    """Runs the experiment into a fresh ``run_dir``; returns the sealed fingerprint."""
    plan, track = output_plan(o.run_dir), Tracker()
    settings = {k: v for k, v in asdict(o).items() if k != "run_dir"}
    claim(o.run_dir, settings)
    append_jsonl({"command": "train", "args": {k: list(v) if isinstance(v, tuple) else v for k, v in settings.items()}}, plan["invocations"])
    with track.stage("load"):
        sequences = materialize(read_fasta(spark, o.fasta).select("protein_id", "sequence"), "sequences")
        rows = load_pairs(spark, o.pairs, (o.split_col,) if o.split_col else ())
        reasons = materialize(pr.with_drop_reason(rows, sequences), "eligible")
        eligible = reasons.filter("drop_reason is null").drop("drop_reason")
        checks = pr.check_input(eligible).first()
        if not checks["n_positive"] or not checks["n_negative"]:
            raise pr.ConstraintError("both labels are needed among the pairs with sequences")
    with track.stage("cohort"):
        if o.max_pairs is not None or o.sample_fraction is not None:
            least = 3 if o.val_size > 0 else 2
            cohort = sampling.CohortSpec(o.max_pairs, o.sample_fraction, o.sampling_seed, least)
            strata = ["label"] if o.split_col is None else ["label", o.split_col]
            chosen = sampling.select_cohort(eligible, "source_row_index", cohort, strata)
            write_single_csv(chosen.select("source_row_index", "sampling_rank", "pair_id", "label"), plan["cohort"], ["sampling_rank"])
            eligible = chosen.drop("sampling_rank")
    with track.stage("split"):
        placed = materialize(make_split(spark, eligible, o), "placed")
        kept = placed.filter("split <> 'dropped'")
        has_val = o.val_size > 0
        pr.require_empty(pr.split_problems(kept, ("train", "val", "test") if has_val else ("train", "test")), "splits without both labels")
        evaluated = [s for s in ("train", "val") if s == "train" or has_val] + (["test"] if o.eval_test_set or not has_val else [])
        digests = {"split_assignments_sha256": table_sha256(kept, ["source_row_index", "split"]), "dataset_sha256": file_sha256(o.pairs)}
        taxa_path = o.protein_metadata or discover(o.pairs, "protein_metadata.csv")
        meta = {
            "split_strategy": o.split_strategy, "protocol_id": splits.STRATEGIES[o.split_strategy if o.split_col is None else "provided_column"].protocol_id, "split_seed": o.split_seed, **digests,
            "sizes": [r.asDict() for r in audit.split_sizes(kept).orderBy("split").collect()],
            "diagnostics": {f"{r['kind']}_{r['split_l']}_{r['split_r']}": r["n_shared"] for r in audit.leakage_audit(kept).collect()},
            "dropped_without_sequences": {r[0]: r[1] for r in reasons.filter("drop_reason is not null").groupBy("drop_reason").count().collect()},
        }
        if taxa_path:
            found = audit.taxon_composition(kept, read_taxa(spark, taxa_path), "split").groupBy("split", "kind").agg(F.sum("n_pairs").alias("n")).collect()
            meta["species"] = {f"{r[0]}_{r[1]}": r[2] for r in found}
        write_split(placed, str(plan["split"]), meta)
    with track.stage("degrees"):
        training = kept.filter("split = 'train'")
        profile = materialize(degree.degree_profile(training, o.degree_bin_quantiles), "profile")
        write_single_csv(profile, plan["degree_profile"], ["protein_id"])
        held = [s for s in evaluated if s != "train"]
        annotated = materialize(degree.annotate(kept.filter(F.col("split").isin(held)), profile), "annotated")
        pr.require_empty(degree.novelty_violations(annotated, o.split_strategy).select("protein_a", "protein_b"), f"{o.split_strategy} broken")
        attached = annotated.withColumnsRenamed({"label": "target", "pa_score": "score"})
        check_attachment(attached, o.split_strategy)
        reports = degree_report(attached, o.split_strategy, summaries.ATTACHMENT, "attachment", 0, None)
        manifest = read_manifest(o.pairs) or {}
        gates = gate_digests(o, kept, meta, held, manifest.get("negatives"))
    matrices: dict[str, DataFrame] = {"none": kept}
    wanted = {spec(m).matrix for m in o.classifier}
    with track.stage("features"):
        if "training_degree" in wanted:
            edges = degree.positive_edges(training)
            own = degree.degree_features(training, profile, edges)
            rest = degree.degree_features(kept.filter("split <> 'train'"), profile)
            matrices["training_degree"] = materialize(dense_vector(own.unionByName(rest), ["f_min", "f_max", "f_product"]), "degree-matrix")
        if "configured" in wanted:
            vectors = feature_rows(kept, sequences, o)
            matrices["configured"] = materialize(kept.join(vectors, "source_row_index"), "matrix")
    results, predictions = None, None
    with track.stage("models"):
        for name in o.classifier:
            for number, seed in enumerate(o.model_seeds[:1] if spec(name).constant is not None else o.model_seeds):
                part, frame = fit_and_evaluate(
                    matrices[spec(name).matrix], name, seed, o.threshold_selection, evaluated, max_iter=o.max_iter
                )
                part = part.withColumn("run_number", F.lit(number)).withColumn("split_strategy", F.lit(o.split_strategy)).withColumn("split_seed", F.lit(o.split_seed))
                part = part.withColumn("features", F.lit(features.feature_name(o.features) if spec(name).matrix == "configured" else spec(name).matrix))
                results = part if results is None else results.unionByName(part)
                if held:
                    scores = frame.select(F.col("example_id").cast("bigint").alias("source_row_index"), "target", "score")
                    role = {"training_degree": "fitted_control", "configured": "predictive_model"}.get(spec(name).matrix, "constant")
                    reports = reports.unionByName(degree_report(annotated.join(scores, "source_row_index"), o.split_strategy, name, role, number, seed))
                if "test" in evaluated:
                    test = frame.filter("split = 'test'").withColumn("model_name", F.lit(name)).withColumn("run_number", F.lit(number))
                    predictions = test if predictions is None else predictions.unionByName(test)
        results = materialize(results, "results")
        if predictions is not None:
            predictions.write.mode("overwrite").parquet(str(plan["predictions"]))
    with track.stage("summaries"):
        reports = materialize(reports, "degree-reports")
        for s in held:
            rows = reports.filter(F.col("split") == s).select("*", *(F.lit(v).cast("string").alias(k) for k, v in gates[s].items()))
            write_single_csv(rows, plan[f"{s}_degree_metrics"], ["model_name", "run_number", "axis", "stratum"])
        keys = ["model_name", "features", "split_strategy", "split_seed", "split"]
        values = ["accuracy", "precision", "recall", "f1", "auprc", "auroc"]
        for s in evaluated:
            part = results.filter(F.col("split") == s)
            write_single_csv(part, plan[f"{s}_metrics"], ["model_name", "run_number"])
            write_single_csv(summaries.summarize(part, keys, values), plan[f"{s}_metrics_summary"], ["model_name"])
    track.write(str(plan["performance"]))
    identity = run_identity("pairs", {"pairs": digests["dataset_sha256"], "fasta": file_sha256(o.fasta)}, {k: meta[k] for k in ("split_strategy", "split_seed", "split_assignments_sha256")}, [{"model": m, "seeds": list(o.model_seeds)} for m in o.classifier], {})
    identity["settings_sha256"] = json_sha256({k: v for k, v in settings.items() if k not in ("pairs", "fasta", "protein_metadata", "sequence_clusters")})
    return fingerprint(o.run_dir, identity)

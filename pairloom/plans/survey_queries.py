"""Queries of sources, sinks, samplers and run tables: what is written below the checkpoint folder and read back, or drawn,
next to SQL on the tables it came from."""

from __future__ import annotations

import json
import lzma
import os
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import row_sha256
from ..functions.text import normalize_taxon
from ..operators import degree, features, mapping, metrics, pairs as pr, residues, sampling, splits, summaries
from ..session import checkpoint_root, load, materialize
from ..sinks import writers
from ..sources import fasta, interactions, runs, sidecars, tables
from . import pair_queries as pq
from .pair_queries import _BASE, _RUNS, _r, acc_sql

_SQL: dict[str, str] = {}
_QUERIES: dict = {}


def _query(sql: str | None = None, base: bool = True):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = (_BASE if base else "") + sql
        return f

    return register


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_root(spark)}/pairloom-{os.getpid()}-{uuid.uuid4().hex[:12]}/{name}"


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file to whatever file system the path is on."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).create(jpath, True)
    out.write(bytearray(data))
    out.close()


def _csv(df: DataFrame, name: str, **options) -> str:
    path = _scratch(df.sparkSession, name)
    sep = tables.infer_separator(name)
    df.write.options(header=True, sep=sep, **options).csv(path)
    return path


def _local(path: str) -> str:
    return path.removeprefix("file://")


# --- sources -------------------------------------------------------------------------------------------------------------------


@_query("select a as protein_a, b as protein_b, cast(label as varchar) as label from clean")
def table_gzip_csv(spark, d):
    """The clean pairs as compressed comma-separated text, read back with every column as text."""
    return tables.read_table(spark, _csv(pq.clean_pairs(spark, d), "pairs.csv", compression="gzip"))


@_query("select count(*) as n_rows, count(distinct label) as n_labels, min(a) as first_a from clean")
def table_tsv(spark, d):
    rows = tables.read_table(spark, _csv(pq.clean_pairs(spark, d), "pairs.tsv", compression="bzip2"), columns=["protein_a", "label"])
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("label").alias("n_labels"), F.min("protein_a").alias("first_a"))


@_query("select unnest(['label', 'protein_a', 'protein_b']) as column_name", base=False)
def table_header(spark, d):
    """The header alone."""
    path = _csv(pq.clean_pairs(spark, d), "pairs.tab")
    return spark.createDataFrame([(c,) for c in tables.header(spark, path)], "column_name string")


@_query("""select lpad(cast(n_nationkey as varchar), 3, '0') as code, n_name as name, case when n_regionkey = 0 then null else cast(n_regionkey as varchar) end as region from nation""", base=False)
def table_zip_member(spark, d):
    """A member of a ZIP archive: ids keep their zeros, missing-value texts are null."""
    rows = load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()  # 25 rows
    lines = ["code\tname\tregion", *(f"{r[0]:03d}\t{r[1]}\t{'NA' if r[2] == 0 else r[2]}" for r in rows)]
    import io

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("readme.txt", "two files")
        z.writestr("nation.tsv", "\n".join(lines) + "\n")
    path = _scratch(spark, "nation.zip")
    _put(spark, path, buffer.getvalue())
    return tables.read_table(spark, path, member="nation.tsv")


@_query("select p as protein_id, sequence from seqs", base=True)
def fasta_round_trip(spark, d):
    """Sequences of all proteins written as FASTA and read back."""
    known = pq.sequences(spark, d)
    path = _scratch(spark, "proteins.fasta")
    writers.write_fasta(known, known.select("protein_id"), path)
    return fasta.read_fasta(spark, path).select("protein_id", "sequence")


@_query(r"""select 'N' || n_nationkey as protein_id, regexp_replace(n_name, '[^A-Z]', '', 'g') as sequence, cast(n_regionkey + 1 as varchar) as taxon_id from nation""", base=False)
def fasta_xz(spark, d):
    """Records of an xz file, sequences over several lines, the taxon from the header."""
    rows = load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()  # 25 rows
    clean = lambda s: "".join(c for c in s if "A" <= c <= "Z")
    text = "".join(f">N{k} x OS=Some species OX={r + 1}\n{clean(n)[:3]}\n{clean(n)[3:]}\n" for k, n, r in rows)
    path = _scratch(spark, "nations.fasta.xz")
    _put(spark, path, lzma.compress(text.encode()))
    return fasta.read_fasta(spark, path)


@_query("select p as protein_id, t as taxon_id from tx")
def taxa_sidecar(spark, d):
    return sidecars.read_taxa(spark, _csv(pq.taxa(spark, d), "protein_metadata.csv"))


@_query("""select p as protein_id, 'g' || coalesce(t, p) as cluster_id from (select a as p from clean union select b from clean) left join tx using (p)""")
def cluster_sidecar(spark, d):
    """A cluster table that must cover all proteins of the pairs."""
    rows = pq.clean_pairs(spark, d)
    groups = pq.taxon_groups(spark, d, rows).select("protein_id", F.concat(F.lit("g"), "group_id").alias("cluster_id"), F.lit("x").alias("note"))
    return sidecars.read_clusters(spark, _csv(groups, "sequence_clusters.csv"), pr.proteins_in(rows), reject_unknown=True)


@_query("""select p as protein_id, min(p) over (partition by coalesce(t, p)) as least_member, count(*) over (partition by coalesce(t, p)) as n_members
from (select a as p from clean union select b from clean) left join tx using (p)""")
def cluster_members(spark, d):
    """Clusters from (representative, member) lines; equal members give equal ids whatever the representative."""
    groups = materialize(pq.taxon_groups(spark, d, pq.clean_pairs(spark, d)), "groups")
    top = groups.groupBy("group_id").agg(F.max("protein_id").alias("representative"))
    path = _scratch(spark, "cluster.tsv")
    groups.join(top, "group_id").select(F.concat_ws("\t", "representative", "protein_id").alias("value")).write.text(path)
    found = materialize(sidecars.read_cluster_members(spark, path, groups.select("protein_id")), "clusters")
    least = found.groupBy("cluster_id").agg(F.min("protein_id").alias("least_member"), F.count(F.lit(1)).alias("n_members"))
    return found.join(least, "cluster_id").select("protein_id", "least_member", "n_members")


def _interaction_table(spark, d) -> str:
    rows = pq.raw_pairs(spark, d).filter("protein_a is not null and protein_b is not null")
    known = mapping.project_endpoints(rows, pq.taxa(spark, d), "protein_id", ["taxon_id"])
    second = F.when(F.col("source_row_index") % 50 == 0, F.concat_ws("|", "protein_b", "protein_a")).otherwise(F.col("protein_b"))
    return _csv(known.select(
        F.col("protein_a").alias("SWISS-PROT Accessions Interactor A"), second.alias("SWISS-PROT Accessions Interactor B"),
        F.col("taxon_id_a").alias("Organism ID Interactor A"), F.col("taxon_id_b").alias("Organism ID Interactor B"), F.col("system_type").alias("Experimental System Type"),
    ), "interactions.txt", quoteAll=False)


_INTERACTIONS = """, ia as (select v.a, v.b, v.source_row_index % 50 = 0 as several, v.system_type as st, ta.t = tb.t and ta.t = (select t from tx group by t order by count(*) desc, t limit 1) as here
  from raw v left join tx ta on ta.p = v.a left join tx tb on tb.p = v.b where v.a is not null and v.b is not null)
"""


_SYSTEMS = ["two_hybrid", "affinity_capture"]


def _one_organism(spark, d) -> str:
    return pq.taxa(spark, d).groupBy("taxon_id").count().orderBy(F.desc("count"), "taxon_id").first()[0]


@_query(_INTERACTIONS + "select a as protein_a, b as protein_b, 1 as label, count(*) as n from ia where here and st in ('two_hybrid', 'affinity_capture') and not several group by a, b")
def interaction_pairs(spark, d):
    """Positive pairs of one organism and system from an interaction table, ambiguous interactors left out."""
    pairs, _ = interactions.read_interactions(spark, _interaction_table(spark, d), organism=_one_organism(spark, d), system_types=_SYSTEMS, ambiguous="drop")
    return pairs.groupBy("protein_a", "protein_b", "label").agg(F.count(F.lit(1)).alias("n"))


@_query(_INTERACTIONS + """select count(*) as n_rows, count(*) filter (here is distinct from true) as n_other_organism,
  count(*) filter (here and coalesce(st, '') not in ('two_hybrid', 'affinity_capture')) as n_other_system, count(*) filter (here and st in ('two_hybrid', 'affinity_capture')) as n_kept from ia""")
def interaction_counters(spark, d):
    """What the filters dropped, counted during the one scan."""
    pairs, seen = interactions.read_interactions(spark, _interaction_table(spark, d), organism=_one_organism(spark, d), system_types=_SYSTEMS, ambiguous="drop")
    pairs.write.format("noop").mode("overwrite").save()
    names = ("n_rows", "n_other_organism", "n_other_system", "n_kept")
    return spark.createDataFrame([tuple(seen.get[n] for n in names)], ", ".join(f"{n} bigint" for n in names))


@_query("select a as protein_a, b as protein_b, 0 as label from clean where label = 0")
def negative_edges(spark, d):
    """A plain edge list under other column names, read as negatives."""
    rows = pq.clean_pairs(spark, d).filter("label = 0").select(F.col("protein_a").alias("left"), F.col("protein_b").alias("right"))
    return interactions.read_edges(spark, _csv(rows, "edges.tsv"), "left", "right", 0)


def _run_dirs(spark, d) -> list[tuple[str, dict]]:
    """A result folder per split strategy with metric tables of the validation split."""
    cells, out = materialize(pq._runs(spark, d), "cells"), []
    base = _local(_scratch(spark, "runs"))
    for strategy in ("random", "c1", "c2"):
        run = f"{base}/{strategy}"
        part = cells.filter((F.col("split_strategy") == strategy) & (F.col("split") == "val"))
        named = part.select("split", "model_name", "split_seed", "run_number", F.format_string("%.6f", F.round("auprc", 6)).alias("auprc"))
        writers.write_single_csv(named, f"{run}/val_degree_metrics.csv")
        writers.write_single_csv(named.groupBy("model_name").agg(F.count(F.lit(1)).alias("n_runs")), f"{run}/val_metrics_summary.csv")
        writers.write_json({"split_strategy": strategy, "split_seed": 4, "diagnostics": {"proteins": 7}}, f"{run}/split/split_metadata.json")
        writers.append_jsonl({"args": {"features": ["tfidf", "count"], "k": 3}}, f"{run}/invocations.jsonl")
        writers.append_jsonl({"args": {"features": ["count"], "k": 3}}, f"{run}/invocations.jsonl")
        out.append((run, {"split_strategy": strategy}))
    return out


@_query(_RUNS + "select split_strategy, model_name, split_seed::varchar as split_seed, run_number::varchar as run_number, round(auprc, 6) as auprc from cells where split = 'val'", base=False)
def degree_metric_files(spark, d):
    """Degree metrics of several runs, tagged with their run."""
    dirs = [r for r, _ in _run_dirs(spark, d)]
    rows = runs.read_degree_metrics(spark, dirs)
    return rows.select(F.substring_index("run_dir", "/", -1).alias("split_strategy"), "model_name", "split_seed", "run_number", F.col("auprc").cast("double").alias("auprc"))


@_query(_RUNS + "select split_strategy, 'val' as summary_split, model_name, count(*)::varchar as n_runs from cells where split = 'val' group by 1, 3", base=False)
def run_summary_files(spark, d):
    rows = runs.read_run_summaries(spark, _run_dirs(spark, d))
    return rows.select("split_strategy", "summary_split", "model_name", "n_runs")


@_query("""select unnest(['c1', 'c2', 'random']) as split_strategy, 4 as split_seed, 7 as proteins, 2 as n_invocations, '["tfidf", "count"]' as features""", base=False)
def run_manifests(spark, d):
    """Protocol, diagnostics and options of runs; options of several invocations are merged."""
    found = {os.path.basename(r) for r in runs.run_directories(os.path.dirname(_run_dirs(spark, d)[0][0]))}
    rows = [runs.manifest_row(r) for r, _ in _run_dirs(spark, d) if os.path.basename(r) in found]
    values = [(r["split_strategy"], r["split_seed"], r["diagnostics_proteins"], r["n_invocations"], r["option_features"]) for r in rows]
    return spark.createDataFrame(values, "split_strategy string, split_seed int, proteins int, n_invocations int, features string")


@_query(_RUNS + """select model_name, 'est_' || model_name as estimator_id, model_name || '_' || split_strategy as configuration_id, count(*) as n from cells group by all""", base=False)
def legacy_results(spark, d):
    """Result rows of the first schema brought to today's columns by the identities of their models."""
    rows = materialize(pq._runs(spark, d), "cells")
    old = rows.select(F.col("model_name").alias("classifier"), F.concat_ws("_", "model_name", "split_strategy").alias("model_name"), "auprc")
    names = [r[0] for r in rows.select("model_name").distinct().collect()]
    known = {n: {"estimator_id": f"est_{n}", "estimator_params": "{}", "matrix_source": "configured", "reporting_group": n} for n in names}
    out = runs.normalize_results(old, known, allow_unversioned=True)
    return out.groupBy("model_name", "estimator_id", "configuration_id").agg(F.count(F.lit(1)).alias("n"))


# --- sinks ---------------------------------------------------------------------------------------------------------------------


@_query("""select (select count(*) from clean) as n_pairs, (select count(*) from (select a as p from clean union select b from clean)) as n_proteins,
  (select count(*) from (select a as p from clean union select b from clean) join tx using (p)) as n_taxa""")
def prepared_dataset(spark, d):
    """A prepared dataset, its files read back through the manifest that binds them."""
    rows = pq.clean_pairs(spark, d)
    ends = pr.proteins_in(rows)
    known = ends.join(pq.sequences(spark, d), "protein_id", "left").fillna("X", ["sequence"])
    folder = _local(_scratch(spark, "data"))
    writers.write_dataset(pr.assign_pair_ids(rows), known, pq.taxa(spark, d), folder, {"dataset_name": "test"})
    sidecars.read_manifest(f"{folder}/pairs.csv")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    pairs = count(tables.read_table(spark, f"file://{folder}/pairs.csv"), "n_pairs")
    proteins = count(fasta.read_fasta(spark, f"file://{folder}/proteins.fasta"), "n_proteins")
    return pairs.join(proteins).join(count(sidecars.read_taxa(spark, f"file://{folder}/protein_metadata.csv"), "n_taxa"))


@_query("select source_row_index::varchar as source_row_index, split from (select row_number() over (order by a, b, label) - 1 as source_row_index, 'train' as split from clean where a < 'M')")
def split_files(spark, d):
    """Kept and dropped rows of a split as files."""
    rows = pr.with_source_row_index(pq.clean_pairs(spark, d).filter("protein_a < 'M'"), ["protein_a", "protein_b", "label"])
    more = rows.select((F.col("source_row_index") + 10**9).alias("source_row_index"), F.lit("dropped").alias("split"), F.lit("example").alias("drop_reason"))
    kept = rows.select("source_row_index", F.lit("train").alias("split"), F.lit(None).cast("string").alias("drop_reason"))
    folder = _local(_scratch(spark, "split"))
    writers.write_split(kept.unionByName(more), folder, {"split_strategy": "example"})
    return tables.read_table(spark, f"file://{folder}/split_assignments.csv").select("source_row_index", "split")


@_query(_RUNS + "select model_name, split_strategy, count(*) as n from cells where split = 'val' group by all", base=False)
def appended_results(spark, d):
    """Rows appended twice are there once; another batch is added."""
    rows = materialize(pq._runs(spark, d).filter("split = 'val'"), "cells")
    path, keys = _scratch(spark, "results"), ["model_name", "split_strategy", "split_seed", "run_number"]
    first = rows.filter("run_number < 2")
    for part in (first, first, rows):
        writers.append_once(part, path, keys, ["auprc"])
    return spark.read.parquet(path).groupBy("model_name", "split_strategy").agg(F.count(F.lit(1)).alias("n"))


@_query("select t as taxon_id, count(*) as n_proteins from (select a as p from clean union select b from clean) left join tx using (p) group by 1")
def metadata_export(spark, d):
    """Proteins of the pairs with their taxon, null where none is known."""
    return writers.protein_taxa(pr.proteins_in(pq.clean_pairs(spark, d)), pq.taxa(spark, d)).groupBy("taxon_id").agg(F.count(F.lit(1)).alias("n_proteins"))


@_query(_RUNS + "select 'pairs' as task, 3 as version, split, count(*) as n from cells where split = 'val' group by 3", base=False)
def metric_row_export(spark, d):
    rows = metrics.metric_rows(pq._runs(spark, d), {"task": "pairs", "version": 3}, ["val"])
    return rows.groupBy("task", "version", "split").agg(F.count(F.lit(1)).alias("n"))


# --- constraints, identities and samples ---------------------------------------------------------------------------------------


@_query("select source_row_index from raw where a is null or b is null or label is null")
def incomplete_pairs(spark, d):
    return pr.invalid_pairs(pr.normalize_pairs(pq.raw_pairs(spark, d), keep=["source_row_index"])).select("source_row_index")


@_query("select row_number() over (order by a, b, label) - 1 as source_row_index, a as protein_a, b as protein_b, label from clean")
def row_identity(spark, d):
    return pr.with_source_row_index(pq.clean_pairs(spark, d), ["protein_a", "protein_b", "label"])


@_query("select substr(md5(a), 1, 2) as short, count(distinct md5(a)) as n_specs from clean group by 1 having count(distinct md5(a)) > 1")
def identity_collisions(spark, d):
    rows = pq.clean_pairs(spark, d).select(F.md5("protein_a").alias("spec"))
    return pr.identity_collisions(rows.withColumn("short", F.substring("spec", 1, 2)), "short", "spec")


@_query("select p as protein_id from (select a as p from clean union select b from clean) where p not in (select p from tx)")
def proteins_without_taxon(spark, d):
    return mapping.uncovered(pq.clean_pairs(spark, d), pq.taxa(spark, d), "protein_id")


@_query("""select a as protein_a, b as protein_b, label, sha256('{"label":' || label || ',"protein_a":"' || a || '","protein_b":"' || b || '"}') as digest from clean""")
def row_digests(spark, d):
    rows = pq.clean_pairs(spark, d)
    return rows.withColumn("digest", row_sha256(rows, ["label", "protein_a", "protein_b"]))


@_query(r"""select p as protein_id, g as other_taxon from (select p, t, first_value(t) over (order by t) as g from tx) where t <> g""")
def conflicting_taxa(spark, d):
    """Proteins whose taxon in one table is not that of another."""
    known = pq.taxa(spark, d)
    least = known.agg(F.min("taxon_id")).first()[0]
    _, conflicts = mapping.merge_maps(known, known.withColumn("taxon_id", F.lit(least)), "protein_id", "taxon_id")
    return conflicts.select("protein_id", F.col("second").alias("other_taxon"))


@_query("""select unnest(['train', 'val', 'test', 'none']) as split, unnest([0, 0, 0, 0]) as n_negative, unnest([0, 0, 0, 0]) as n_positive
  where false union all select 'holdout', 0, 0 union all select 'test', 0, (select count(*) from rows_ where split = 'test' and label = 1)""")
def one_sided_splits(spark, d):
    """Splits that are empty or hold one label only."""
    rows = pq.assigned_pairs(spark, d).filter("split <> 'test' or label = 1")
    return pr.split_problems(rows, ("train", "val", "test", "holdout"))


@_query(_RUNS + """, pa as (select distinct model_name, split_strategy, round(auprc, 1) as a from cells where model_name = 'preferential_attachment')
select model_name, split_strategy, count(*) as n from (select model_name, split_strategy, a from pa
  union all select model_name, split_strategy, auprc from cells where model_name <> 'preferential_attachment') group by all""", base=False)
def attachment_once(spark, d):
    """Attachment rows once each, whatever run delivered them."""
    rows = pq._runs(spark, d)
    mine = F.col("model_name") == summaries.ATTACHMENT
    rows = rows.select("model_name", "split_strategy", F.when(mine, F.round("auprc", 1)).otherwise(F.col("auprc")).alias("auprc"), F.col("run_number").alias("run_dir"))
    return summaries.deduplicate_attachment(rows).groupBy("model_name", "split_strategy").agg(F.count(F.lit(1)).alias("n"))


_SCORED = """, sc as (select rows_.split, label as target, coalesce(da.training_exposure, 0) + coalesce(db.training_exposure, 0) as score
  from rows_ left join deg da on da.p = a left join deg db on db.p = b)
"""


def _scored(spark, d) -> DataFrame:
    rows = materialize(pq.assigned_pairs(spark, d), "assigned")
    profile = degree.degree_profile(rows.filter("split = 'train'"))
    found = degree.with_degrees(rows, profile)
    return found.select("split", F.col("label").alias("target"), (F.col("training_exposure_a") + F.col("training_exposure_b")).cast("double").alias("score"))


@_query(_SCORED + """select split, 50.0 as threshold, round(2.0 * count(*) filter (target = 1 and score >= 50) / (count(*) filter (target = 1) + count(*) filter (score >= 50)), 6) as f1 from sc group by 1""")
def fixed_thresholds(spark, d):
    return metrics.fixed_threshold(_scored(spark, d), 50.0, "split").select("split", "threshold", _r("f1"))


@_query("select split, 0.0 as spread, true as holds, count(*) as n_examples from rows_ group by 1")
def constant_scores(spark, d):
    """A constant score has the prevalence as AUPRC and one half as AUROC."""
    rows = pq.assigned_pairs(spark, d).select("split", F.col("label").alias("target"), F.lit(0.25).alias("score"))
    return metrics.degree_invariants(rows, "split").select("split", "spread", "holds", "n_examples")


@_query(""", po as (select a, b from clean where label = 1), nd as (select p, t from (select a as p from po union select b from po) join tx using (p)),
ps as (select least(x.t, y.t) as l, greatest(x.t, y.t) as h, count(*) as n from po join nd x on x.p = a join nd y on y.p = b group by all),
mb as (select t, count(*) as m from nd join (select a as p from po join nd x on x.p = a join nd y on y.p = b union select b from po join nd x on x.p = a join nd y on y.p = b) using (p) group by 1)
select l || '|' || h as stratum, n as n_observed, case when l = h then ml.m * (ml.m - 1) // 2 else ml.m * mh.m end as n_pairs from ps join mb ml on ml.t = l join mb mh on mh.t = h""")
def pair_space(spark, d):
    """Observed pairs and size of the pair space of every pair of taxa among the positives whose taxa are known."""
    known = pq.taxa(spark, d)
    positives = pq.clean_pairs(spark, d).filter("label = 1")
    both = mapping.project_endpoints(positives, known, "protein_id", ["taxon_id"]).filter("taxon_id_a is not null and taxon_id_b is not null")
    both = materialize(both.select("protein_a", "protein_b", "taxon_id_a", "taxon_id_b"), "typed")
    lo, hi = pr.unordered("taxon_id_a", "taxon_id_b")
    seen = both.groupBy(lo.alias("l"), hi.alias("h")).agg(F.count(F.lit(1)).alias("n_observed"))
    members = pr.proteins_in(both).join(known, "protein_id").groupBy("taxon_id").agg(F.count(F.lit(1)).alias("m"))
    side = lambda x: members.select(F.col("taxon_id").alias(x), F.col("m").alias(f"m{x}"))
    sized = seen.join(side("l"), "l").join(side("h"), "h")
    size = F.when(F.col("l") == F.col("h"), F.expr("ml * (ml - 1) div 2")).otherwise(F.col("ml") * F.col("mh"))
    return sized.select(F.concat_ws("|", "l", "h").alias("stratum"), "n_observed", size.alias("n_pairs"))


@_query("""select n, i, j from (select unnest([2, 5, 1000, 65537]) as n) join lateral (select unnest(range(0, least(n, 40) - 1)) as i) on true
  join lateral (select unnest(range(i + 1, least(n, i + 30))) as j) on true""", base=False)
def pair_numbers(spark, d):
    """Pairs numbered and found again from their numbers."""
    n = spark.createDataFrame([(2,), (5,), (1000,), (65537,)], "n bigint")
    i = n.select("n", F.explode(F.sequence(F.lit(0), F.least("n", F.lit(40)) - 2)).alias("i0"))
    ij = i.select("n", "i0", F.explode(F.sequence(F.col("i0") + 1, F.least("n", F.col("i0") + 30) - 1)).alias("j0"))
    numbered = ij.select("n", sampling.pair_number(F.col("i0"), F.col("j0"), F.col("n")).alias("number"))
    return sampling.with_pair(numbered, "number", "n").select("n", "i", "j")


def _draws_kept(spark, d, policy: str) -> DataFrame:
    positives = materialize(pq.clean_pairs(spark, d).filter("label = 1"), "positives")
    known = pq.taxa(spark, d)
    if policy != "global":
        typed = mapping.project_endpoints(positives, known, "protein_id", ["taxon_id"])
        positives = materialize(typed.filter("taxon_id_a is not null and taxon_id_b is not null").select("protein_a", "protein_b", "label"), "typed")
    drawn = materialize(sampling.sample_negatives(positives, sampling.NegativeSpec(policy, 0.5, 5), known), "negatives")
    observed = sampling.observed_pairs(positives).select(F.col("lo").alias("protein_a"), F.col("hi").alias("protein_b"))
    inside = pr.proteins_in(positives)
    return drawn.agg(F.count(F.lit(1)).alias("n_drawn"), F.count_distinct("protein_a", "protein_b").alias("n_distinct")).join(
        drawn.join(observed, ["protein_a", "protein_b"]).agg(F.count(F.lit(1)).alias("n_observed"))
    ).join(mapping.uncovered(drawn, inside, "protein_id").agg(F.count(F.lit(1)).alias("n_strangers")))


@_query(", n as (select cast(round_even(count(*) * 0.5, 0) as bigint) as k from clean where label = 1) select k as n_drawn, k as n_distinct, 0 as n_observed, 0 as n_strangers from n")
def global_negative_counts(spark, d):
    """Half as many negatives as positives from the whole pair space, none observed."""
    return _draws_kept(spark, d, "global")


@_query(""", n as (select cast(round_even(count(*) * 0.5, 0) as bigint) as k from clean join tx x on x.p = a join tx y on y.p = b where label = 1)
select k as n_drawn, k as n_distinct, 0 as n_observed, 0 as n_strangers from n""")
def matched_negative_counts(spark, d):
    """The same within the pairs of taxa of the positives."""
    return _draws_kept(spark, d, "taxon_pair_matched")


@_query("""select mode, n_groups, list_sum([train, val, test]) as n_placed, train >= val and val >= 1 and test >= 1 as is_ordered
  from (select unnest(['c2', 'c2', 'c3', 'c3']) as mode, unnest([3, 500, 3, 500]) as n_groups, unnest([1, 450, 1, 290]) as train, unnest([1, 25, 1, 105]) as val, unnest([1, 25, 1, 105]) as test)""", base=False)
def partition_sizes(spark, d):
    """Groups per partition: all of them are placed, each partition has one at least."""
    rows = []
    for mode in ("c2", "c3"):
        for n in (3, 500):
            t, v, e = splits.partition_counts(mode, n, 0.1, 0.1)
            rows.append((mode, n, t + v + e, t >= v >= 1 and e >= 1))
    return spark.createDataFrame(rows, "mode string, n_groups int, n_placed int, is_ordered boolean")


def _best(spark, d, mode: str) -> DataFrame:
    rows = materialize(pq.clean_pairs(spark, d), "clean")
    groups = materialize(pr.proteins_in(rows).withColumn("group_id", F.concat(F.lit("g"), F.conv(F.substring(F.md5("protein_id"), 1, 2), 16, 10))), "groups")
    out = materialize(splits.entity_split(rows, groups, mode, 0.1, 0.1, seed=3, n_trials=8), "best")
    # the promise is one about groups: a protein of a familiar group may itself be new
    by_group = mapping.project_endpoints(out, groups, "protein_id", ["group_id"]).drop("protein_a", "protein_b")
    checks = splits.invariants(by_group.withColumnsRenamed({"group_id_a": "protein_a", "group_id_b": "protein_b"}), mode).select(F.col("invariant"), F.col("n_violations").cast("bigint").alias("n"))
    sizes = out.agg(F.count(F.lit(1)).alias("n")).select(F.lit("n_rows").alias("invariant"), "n")
    reasons = out.filter("(split = 'dropped') <> (drop_reason is not null)").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unexplained").alias("invariant"), "n")
    kept = out.filter("split <> 'dropped'").agg(F.count_distinct("split", "label").alias("n")).select(F.lit("splits_by_labels").alias("invariant"), "n")
    return checks.unionByName(sizes).unionByName(reasons).unionByName(kept)


@_query("""select unnest(['no_shared_pairs', 'exactly_1_endpoint_in_train', 'unexplained', 'splits_by_labels']) as invariant, unnest([0, 0, 0, 6]) as n union all select 'n_rows', count(*) from clean""")
def best_c2_checks(spark, d):
    """The best of eight C2 assignments: nothing lost, every drop explained, all labels in all splits."""
    return _best(spark, d, "c2")


@_query("""select unnest(['no_shared_pairs', 'exactly_0_endpoint_in_train', 'unexplained', 'splits_by_labels']) as invariant, unnest([0, 0, 0, 6]) as n union all select 'n_rows', count(*) from clean""")
def best_c3_checks(spark, d):
    return _best(spark, d, "c3")


@_query("""select 'no_shared_pairs' as invariant, count(*) as n_violations from (select least(a, b), greatest(a, b) from rows_ group by 1, 2 having count(distinct split) > 1)
union all select 'held_out_endpoints_in_train', count(*) from (select p from (select a as p, split from rows_ union all select b, split from rows_) group by p having not bool_or(split = 'train'))""")
def given_split_violations(spark, d):
    """The same checks on the assignment of the test data, which breaks them."""
    found = splits.invariants(pq.assigned_pairs(spark, d), "c1")
    shared = pq.assigned_pairs(spark, d).select(*(c.alias(n) for c, n in zip(pr.unordered("protein_a", "protein_b"), ("lo", "hi"), strict=True)), "split")
    n = shared.groupBy("lo", "hi").agg(F.count_distinct("split").alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("n_violations"))
    return found.filter("invariant <> 'no_shared_pairs'").unionByName(n.select(F.lit("no_shared_pairs").alias("invariant"), "n_violations"))


@_query("""select p || ':' || (i - 1) || ':unspecified' as example_id, i - 1 as residue_index, substr(sequence, i, 1) as residue, s.split
from (select p, sequence, unnest(range(1, length(sequence) + 1, 25)) as i from seqs where p < 'E') join (select p, case when substr(md5(p), 1, 1) < 'c' then 'train' else 'test' end as split from seqs) s using (p)""")
def residue_split(spark, d):
    """Residue examples with defaults, placed with their protein."""
    known = pq.sequences(spark, d)
    near = known.filter("protein_id < 'E'")
    places = near.select("protein_id", "sequence", F.explode(F.sequence(F.lit(0), F.length("sequence") - 1, F.lit(25))).alias("residue_index"))
    rows = places.select("protein_id", "residue_index", F.lower(F.substr("sequence", F.col("residue_index") + 1, F.lit(1))).alias("residue"), F.lit(1).alias("label"))
    placed = known.select("protein_id", F.when(F.substring(F.md5("protein_id"), 1, 1) < "c", "train").otherwise("test").alias("split"))
    return residues.split_by_protein(residues.residue_examples(rows), placed).select("example_id", "residue_index", "residue", "split")


@_query(r"""select p as protein_id, i - 1 as residue_index, substr(sequence, greatest(i - 10, 1), least(i + 10, length(sequence)) - greatest(i - 10, 1) + 1) as w, least(i - 1, 10) as target_index
from (select p, sequence, unnest(range(1, length(sequence) + 1)) as i from seqs)""")
def residue_windows_all(spark, d):
    """The window of every residue of every sequence, ten residues to either side."""
    known = pq.sequences(spark, d)
    places = known.select("protein_id", F.posexplode(F.split("sequence", "(?!$)")).alias("residue_index", "residue"))
    rows = places.select("protein_id", "residue_index", F.lit(None).cast("string").alias("residue"), F.lit(1).alias("label"))
    out = residues.windows(residues.residue_examples(rows), known, 10)
    return out.select("protein_id", "residue_index", F.col("window").alias("w"), "target_index")


# --- lift behind real gates ------------------------------------------------------------------------------------------------------

_GATED = _RUNS + """, g as (select *, 'd' || split_seed as dataset, case when split_seed % 2 = 0 then 'n' || split_strategy end as negatives, 'x' || split_strategy as ctx from cells where split = 'val'),
rf as (select model_name, split_strategy, split_seed, avg(auprc) as v from g group by all)
"""


def _gated(spark, d) -> DataFrame:
    """Rows whose gates differ: by seed the dataset, by strategy the context and, in some, the negatives (else null)."""
    rows = pq._lift_rows(spark, d)
    negatives = F.when(F.col("split_seed") % 2 == 0, F.concat(F.lit("n"), "split_strategy"))
    return rows.withColumns({
        "dataset_sha256": F.concat(F.lit("d"), F.col("split_seed").cast("string")), "negative_construction_sha256": negatives,
        "control_selection_context_sha256": F.concat(F.lit("x"), "split_strategy"),
    })


@_query(_GATED + """, ev as (select ctx, split_strategy, split_seed, avg(auprc) filter (model_name = 'degree_logistic') as p, avg(auprc) filter (model_name = 'degree_hgb') as s from g group by all),
sel as (select ctx, case when bool_or(complete and med - 0.02 > 1.02e-12 and wins >= 4) then 'degree_hgb' else 'degree_logistic' end as control from (
  select ctx, split_strategy, count(s - p) = 5 as complete, quantile_cont(s - p, 0.5) as med, count(*) filter (s > p) as wins from ev group by all) group by 1)
select m.model_name, m.split_strategy, m.dataset as dataset_sha256, m.negatives as negative_construction_sha256, control as selected_fitted_control, count(*) as n_rows, round(avg(m.auprc - c.v), 6) as absolute_lift
from g m join sel using (ctx) join rf c on c.model_name = control and c.split_strategy = m.split_strategy and c.split_seed = m.split_seed
where m.model_name like 'mlp%' group by all""", base=False)
def gated_lift(spark, d):
    """Lift where gates tell datasets, contexts and (nullable) negatives apart; each context selects its own control."""
    rows = _gated(spark, d)
    out = summaries.degree_lift(rows, summaries.select_control(rows))
    by = ["model_name", "split_strategy", "dataset_sha256", "negative_construction_sha256", "selected_fitted_control"]
    return out.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("absolute_lift"), 6).alias("absolute_lift"))


@_query(_GATED + """select model_name, split_strategy, 'control behind other gates' as refusal, count(*) as n from g where model_name like 'mlp%' and split_seed = 1 group by all""", base=False)
def refused_lift(spark, d):
    """Model rows whose control lies behind a changed gate are refused."""
    rows = _gated(spark, d)
    changed = rows.withColumn("grouping_sha256", F.when(F.col("model_name").isin("degree_logistic", "degree_hgb") & (F.col("split_seed") == 1), F.lit("other")))
    out = summaries.lift_refusals(changed, summaries.select_control(changed))
    return out.groupBy("model_name", "split_strategy", "refusal").agg(F.count(F.lit(1)).alias("n"))


@_query("""select unnest(['tfidf', 'count+bm25']) as features, unnest([3, 4]) as k, true as is_named""", base=False)
def feature_names(spark, d):
    """Names of feature configurations; repeated kinds count once."""
    rows = []
    for kinds, k in ((["tfidf", "tfidf"], 3), (["count", "bm25"], 4)):
        i = features.feature_identity(kinds, k)
        rows.append((i["features"], k, i["feature_identity"] == f"{i['features']}-k{k}-{i['feature_spec_sha256'][:12]}"))
    return spark.createDataFrame(rows, "features string, k int, is_named boolean")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

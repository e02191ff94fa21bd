"""Queries of the pair engine over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.accession import accession
from ..functions.text import header_id, header_taxon, normalize_sequence, normalize_taxon, prottrans_sequence, safe_component, sequence_sha256
from ..operators import audit, clustering, degree, features, mapping, metrics, pairs as pr, residues, sampling, splits, summaries
from ..session import load, materialize
from .corpus_queries import acc_sql

_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


# --- shared inputs -----------------------------------------------------------------------------------------------------------


def raw_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All rows of pairs with their accessions."""
    p = load(spark, d, "pairs")
    return p.select(
        "source_row_index", "pair_id", "system_type", "source", accession(F.col("protein_a")).alias("protein_a"),
        accession(F.col("protein_b")).alias("protein_b"), pr.normalize_labels(F.col("label")).alias("label"),
    )


def valid_pairs(spark: SparkSession, d: str) -> DataFrame:
    return raw_pairs(spark, d).filter("protein_a is not null and protein_b is not null and label is not null")


def clean_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pr.consistent(pr.canonicalize(raw_pairs(spark, d)))


def assignments(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "split_assignments")
    split = F.nullif(F.lower(F.regexp_replace("split", _SPACE, "")), F.lit(""))
    return rows.select("source_row_index", split.alias("split")).filter("source_row_index is not null and split is not null").distinct()


def assigned_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Valid rows with the split they were put in, self pairs aside."""
    return pr.without_self_pairs(valid_pairs(spark, d)).join(assignments(spark, d), "source_row_index")


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """One live sequence per protein, the least record of those that have one."""
    f = load(spark, d, "fasta_sequences").select("record_id", accession(F.col("protein_id")).alias("protein_id"), normalize_sequence(F.col("sequence")).alias("sequence"), "withdrawn_at")
    live = f.filter("protein_id is not null and sequence <> '' and withdrawn_at is null")
    return live.groupBy("protein_id").agg(F.min_by("sequence", "record_id").alias("sequence"))


def taxa(spark: SparkSession, d: str) -> DataFrame:
    """One taxon per protein, the least of those given."""
    m = load(spark, d, "protein_metadata").select(accession(F.col("protein_id")).alias("protein_id"), normalize_taxon(F.col("taxon_id")).alias("taxon_id"))
    return m.filter("protein_id is not null and taxon_id is not null").groupBy("protein_id").agg(F.min("taxon_id").alias("taxon_id"))


def taxon_groups(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """Groups for entity-level splits: the taxon, or the protein itself where none is known."""
    ends = pr.proteins_in(rows)
    return ends.join(taxa(spark, d), "protein_id", "left").select("protein_id", F.coalesce("taxon_id", "protein_id").alias("group_id"))


_BASE = f"""
with raw as (select source_row_index, pair_id, system_type, source, {acc_sql("protein_a")} as a, {acc_sql("protein_b")} as b,
  case when label in (0, 1) then label end as label from pairs),
valid as (select * from raw where a is not null and b is not null and label is not null),
canon as (select distinct least(a, b) as a, greatest(a, b) as b, label from valid where a <> b),
clean as (select a, b, min(label) as label from canon group by a, b having count(*) = 1),
asg as (select distinct source_row_index, nullif(lower(regexp_replace(split, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '') as split from split_assignments
  where source_row_index is not null),
rows_ as (select v.*, asg.split from valid v join asg using (source_row_index) where a <> b and asg.split is not null),
fa as (select record_id, {acc_sql("protein_id")} as p, upper(regexp_replace(sequence, '\\s+', '', 'g')) as sequence, withdrawn_at from fasta_sequences),
seqs as (select p, arg_min(sequence, record_id) as sequence from fa where p is not null and sequence <> '' and withdrawn_at is null group by p),
tx as (select p, min(t) as t from (select {acc_sql("protein_id")} as p, nullif(regexp_extract(trim(taxon_id), '^0*([1-9][0-9]*)$', 1), '') as t from protein_metadata)
  where p is not null and t is not null group by p),
train as (select * from rows_ where split = 'train'),
edges as (select distinct least(a, b) as lo, greatest(a, b) as hi from train where label = 1),
deg0 as (select p, sum(d) as positive_degree, sum(e) as training_exposure from (
  select lo as p, 1 as d, 0 as e from edges union all select hi, 1, 0 from edges union all select a, 0, 1 from train union all select b, 0, 1 from train) group by p),
cut as (select coalesce(quantile_cont(positive_degree, 0.5) filter (positive_degree > 0), 0) as dl, coalesce(quantile_cont(positive_degree, 0.9) filter (positive_degree > 0), 0) as dh,
  coalesce(quantile_cont(training_exposure, 0.5), 0) as el, coalesce(quantile_cont(training_exposure, 0.9), 0) as eh from deg0),
deg as (select p, positive_degree, training_exposure,
  case when positive_degree = 0 then 'zero' when positive_degree <= dl then 'low' when positive_degree <= dh then 'mid' else 'high' end as db,
  case when training_exposure <= el then 'low' when training_exposure <= eh then 'mid' else 'high' end as eb from deg0, cut)
"""
_SQL: dict[str, str] = {}
_QUERIES: dict = {}


def _query(sql: str | None = None, base: bool = True):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = (_BASE if base else "") + sql
        return f

    return register


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


# --- preparation -------------------------------------------------------------------------------------------------------------


@_query("select a as protein_a, b as protein_b, label from clean")
def canonical_pairs(spark, d):
    return clean_pairs(spark, d)


@_query("""select count(*) as n_rows, count(*) filter (a is null or b is null or label is null) as n_incomplete,
  count(*) filter (a = b and label is not null) as n_self,
  count(*) filter (a <> b and label is not null) - (select count(*) from canon) as n_duplicates, (select count(*) from canon) as n_canonical from raw""")
def canonical_counters(spark, d):
    return pr.canonical_counters(raw_pairs(spark, d))


@_query("select a as protein_a, b as protein_b, count(*) as n_labels from canon group by 1, 2 having count(*) > 1")
def contradictory_pairs(spark, d):
    return pr.contradictions(pr.canonicalize(raw_pairs(spark, d)))


@_query("select 'pair_' || (row_number() over (order by label, a, b) - 1) as pair_id, a as protein_a, b as protein_b, label from clean")
def numbered_pairs(spark, d):
    return pr.assign_pair_ids(clean_pairs(spark, d)).select("pair_id", "protein_a", "protein_b", "label")


@_query("""select count(*) filter (label = 1) as n_positive, count(*) filter (label = 0) as n_negative, count(*) as n_pairs,
  (select count(distinct p) from (select a as p from clean union all select b from clean)) as n_proteins from clean""")
def pair_totals(spark, d):
    return pr.pair_counts(clean_pairs(spark, d))


@_query("""select case when sa.p is null and sb.p is null then 'missing_both_sequences' when sa.p is null then 'missing_protein_a_sequence'
  when sb.p is null then 'missing_protein_b_sequence' end as drop_reason, count(*) as n_pairs
  from clean left join seqs sa on sa.p = a left join seqs sb on sb.p = b group by 1""")
def sequence_drop_reasons(spark, d):
    return pr.with_drop_reason(clean_pairs(spark, d), sequences(spark, d)).groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n_pairs"))


@_query("select a as protein_a, b as protein_b, label from clean where a in (select p from seqs) and b in (select p from seqs)")
def pairs_with_sequences(spark, d):
    return pr.with_sequences(clean_pairs(spark, d), sequences(spark, d))


@_query("""select count(*) as n_rows, count(*) filter (coalesce(trim(pair_id), '') = '') as n_blank_ids, count(pair_id) - count(distinct pair_id) as n_repeated_ids,
  count(*) filter (label = 0) as n_negative, count(*) filter (label = 1) as n_positive, count(*) filter (label is null) as n_bad_labels from raw""")
def input_checks(spark, d):
    return pr.check_input(raw_pairs(spark, d))


@_query("""select source, count(*) as n from pairs where regexp_matches(protein_a, '[|;,]') or regexp_matches(protein_b, '[|;,]') group by 1""", base=False)
def ambiguous_interactors(spark, d):
    return pr.ambiguous_interactors(load(spark, d, "pairs"), ["protein_a", "protein_b"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@_query("select system_type, count(*) as n from raw where system_type in ('two_hybrid', 'pull_down', 'fret') group by 1")
def system_type_filter(spark, d):
    return pr.filter_system_types(raw_pairs(spark, d), "system_type", ["two_hybrid", "pull_down", "fret"]).groupBy("system_type").agg(F.count(F.lit(1)).alias("n"))


@_query("select source_row_index, a as protein_a, b as protein_b, label, t1.t as organism from raw join tx t1 on t1.p = a join tx t2 on t2.p = b where t1.t = t2.t and t1.t = (select min(t) from tx)")
def organism_filter(spark, d):
    t = taxa(spark, d)
    wanted = t.agg(F.min("taxon_id").alias("wanted"))
    rows = mapping.project_endpoints(raw_pairs(spark, d), t, "protein_id", ["taxon_id"]).join(F.broadcast(wanted))
    return rows.filter("taxon_id_a = wanted and taxon_id_b = wanted").select("source_row_index", "protein_a", "protein_b", "label", F.col("wanted").alias("organism"))


@_query(f"""select map_status, count(*) as n_pairs from (
  select case when coalesce(x.n, 0) > 1 or coalesce(y.n, 0) > 1 then 'ambiguous' when x.n is null or y.n is null then 'unmapped' else 'mapped' end as map_status
  from clean left join m x on x.raw = a left join m y on y.raw = b) group by 1""".replace("from (", "from (with m as (select raw, count(distinct c) as n from (select " + acc_sql("protein_id") + " as raw, trim(taxon_id) as c from protein_metadata) where raw <> '' and c <> '' group by 1) ", 1))
def mapped_pairs(spark, d):
    table = load(spark, d, "protein_metadata").select(accession(F.col("protein_id")).alias("raw"), F.col("taxon_id").alias("canonical"))
    return mapping.mapping_counts(mapping.map_pairs(clean_pairs(spark, d), mapping.build_mapping(table, "raw", "canonical")))


@_query(f"""select protein_id, first, second from (select x.p as protein_id, x.t as first, y.t as second from tx x join (
  select p, max(t) as t from (select {acc_sql("protein_id")} as p, nullif(regexp_extract(trim(taxon_id), '^0*([1-9][0-9]*)$', 1), '') as t from protein_metadata) where p is not null and t is not null group by p) y using (p) where x.t <> y.t)""")
def taxon_conflicts(spark, d):
    m = load(spark, d, "protein_metadata").select(accession(F.col("protein_id")).alias("protein_id"), normalize_taxon(F.col("taxon_id")).alias("taxon_id"))
    latest = m.filter("protein_id is not null and taxon_id is not null").groupBy("protein_id").agg(F.max("taxon_id").alias("taxon_id"))
    return mapping.merge_maps(taxa(spark, d), latest, "protein_id", "taxon_id")[1]


@_query("select p as protein_id from (select a as p from clean union select b from clean)")
def pair_proteins(spark, d):
    return pr.proteins_in(clean_pairs(spark, d))


@_query("""select source_row_index, count(*) filter (o = 1) as n_rows, count(*) filter (o = 2) as n_assigned from (
  select source_row_index, 1 as o from valid union all select source_row_index, 2 from asg where split = 'train') group by 1
  having count(*) filter (o = 1) <> 1 or count(*) filter (o = 2) <> 1""")
def assignment_differences(spark, d):
    return pr.assignment_differences(valid_pairs(spark, d), assignments(spark, d))


# --- audits ------------------------------------------------------------------------------------------------------------------


@_query("""select split, count(*) as n_rows, count(*) filter (label = 1) as n_positive, count(*) filter (label = 0) as n_negative,
  round(count(*) / sum(count(*)) over (), 6) as fraction from rows_ group by 1""")
def split_sizes(spark, d):
    return audit.split_sizes(assigned_pairs(spark, d)).withColumn("fraction", F.round("fraction", 6))


@_query("""select o.split, o.n_distinct_ordered_pairs, o.n_duplicate_ordered_pairs, u.n_distinct_unordered_pairs, u.n_duplicate_unordered_pairs, p.n_distinct_proteins from
  (select split, count(distinct (a, b)) as n_distinct_ordered_pairs, count(*) - count(distinct (a, b)) as n_duplicate_ordered_pairs from rows_ group by 1) o
  join (select split, count(distinct (least(a, b), greatest(a, b))) as n_distinct_unordered_pairs, count(*) - count(distinct (least(a, b), greatest(a, b))) as n_duplicate_unordered_pairs from rows_ group by 1) u using (split)
  join (select split, count(distinct p) as n_distinct_proteins from (select split, a as p from rows_ union all select split, b from rows_) group by 1) p using (split)""")
def split_duplicates(spark, d):
    return audit.duplicates(assigned_pairs(spark, d))


_OVERLAP = """, v as ({values}), s as (select distinct split, value from v)
select l.split as split_l, r.split as split_r, count(*) as n_shared, string_agg(l.value, ' ' order by l.value) filter (rn <= 10) as examples
from (select x.*, row_number() over (partition by x.split, y.split order by x.value) as rn, y.split as other from s x join s y on x.value = y.value and x.split < y.split) l
join s r on r.value = l.value and r.split = l.other group by 1, 2"""


@_query(_OVERLAP.format(values="select split, a as value from rows_ union all select split, b from rows_"))
def protein_overlaps(spark, d):
    return audit.overlaps(assigned_pairs(spark, d), "proteins")


@_query(""", v as (select 'proteins' as kind, split, a as value from rows_ union select 'proteins', split, b from rows_
  union select 'ordered_pairs', split, a || '>' || b from rows_ union select 'unordered_pairs', split, least(a, b) || '>' || greatest(a, b) from rows_)
select x.kind, x.split as split_l, y.split as split_r, count(*) as n_shared, x.kind <> 'proteins' as is_leak
from v x join v y on x.kind = y.kind and x.value = y.value and x.split < y.split group by 1, 2, 3""")
def leakage_audit(spark, d):
    return audit.leakage_audit(assigned_pairs(spark, d))


@_query("select label, count(*) as n from raw group by 1")
def label_counts(spark, d):
    return audit.label_counts(raw_pairs(spark, d))


@_query("select t as taxon_id, count(*) as n_proteins from (select a as p from clean union select b from clean) left join tx using (p) group by 1")
def taxon_counts(spark, d):
    return audit.taxon_summary(pr.proteins_in(clean_pairs(spark, d)), taxa(spark, d))


@_query("""select split, case when x.t is null or y.t is null then 'missing' when x.t = y.t then 'same' else 'cross' end as kind,
  case when x.t is not null and y.t is not null then least(x.t, y.t) || '|' || greatest(x.t, y.t) end as taxon_pair, count(*) as n_pairs
  from rows_ left join tx x on x.p = a left join tx y on y.p = b group by 1, 2, 3""")
def taxon_composition(spark, d):
    return audit.taxon_composition(assigned_pairs(spark, d), taxa(spark, d), "split")


@_query("select s.split, 0 as n_negative, 0 as n_positive from (values ('train'), ('val'), ('test')) s(split) where s.split not in (select split from rows_ where label = 0) or s.split not in (select split from rows_ where label = 1)")
def split_problems(spark, d):
    return pr.split_problems(assigned_pairs(spark, d))


@_query("""select round(sum(abs(coalesce(n, 0) / ns - rate)), 6) as label_balance_error from (select split, count(*) as ns from rows_ group by 1)
  cross join (select label, count(*) / (select count(*) from rows_) as rate from rows_ group by 1) left join (select split, label, count(*) as n from rows_ group by 1, 2) using (split, label)""")
def label_balance(spark, d):
    return splits.label_balance_error(assigned_pairs(spark, d)).select(_r("label_balance_error"))


@_query("select split, label, count(*) as n, round(count(*) / sum(count(*)) over (partition by split), 6) as rate from rows_ group by 1, 2")
def class_rates(spark, d):
    return splits.class_summary(assigned_pairs(spark, d)).select("split", "label", "n", _r("rate"))


@_query("""select count(*) as n_clusters, min(n) as min, quantile_cont(n, 0.5) as median, round(avg(n), 6) as mean, max(n) as max, round(max(n) / sum(n), 6) as largest_fraction
  from (select coalesce(t, p) as g, count(*) as n from (select a as p from clean union select b from clean) left join tx using (p) group by 1)""")
def group_sizes(spark, d):
    out = splits.cluster_sizes(taxon_groups(spark, d, clean_pairs(spark, d)))
    return out.select("n_clusters", "min", "median", _r("mean"), "max", _r("largest_fraction"))


# --- degrees -----------------------------------------------------------------------------------------------------------------


def _train(spark, d):
    return assigned_pairs(spark, d).filter("split = 'train'")


@_query("select p as protein_id, positive_degree, training_exposure, db as positive_degree_bin, eb as training_exposure_bin from deg")
def degree_profile(spark, d):
    return degree.degree_profile(_train(spark, d))


@_query("""select db as bin, count(*) as nodes, sum(positive_degree) as degree_sum, round(avg(positive_degree), 6) as degree_mean,
  round(stddev_samp(positive_degree) / sqrt(count(*)), 6) as degree_standard_error from deg group by 1""")
def degree_bins(spark, d):
    profile = degree.degree_profile(_train(spark, d)).groupBy(F.col("positive_degree_bin").alias("bin"))
    c = "positive_degree"
    return profile.agg(
        F.count(F.lit(1)).alias("nodes"), F.sum(c).alias("degree_sum"), F.round(F.avg(c), 6).alias("degree_mean"),
        F.round(F.stddev_samp(c) / F.sqrt(F.count(F.lit(1))), 6).alias("degree_standard_error"),
    )


@_query("""select source_row_index, round(least(ln(1 + da), ln(1 + db)), 6) as f_min, round(greatest(ln(1 + da), ln(1 + db)), 6) as f_max, round(ln(1 + da) * ln(1 + db), 6) as f_product from (
  select source_row_index, coalesce(x.positive_degree, 0) - own as da, coalesce(y.positive_degree, 0) - own as db from (
    select r.*, case when label = 1 and lo is not null then 1 else 0 end as own from train r left join edges on lo = least(a, b) and hi = greatest(a, b)) r
  left join deg x on x.p = a left join deg y on y.p = b)""")
def training_degree_features(spark, d):
    train = materialize(_train(spark, d), "train")
    out = degree.degree_features(train, degree.degree_profile(train), degree.positive_edges(train))
    return out.select("source_row_index", _r("f_min"), _r("f_max"), _r("f_product"))


_ANN = """, held as (select r.*, coalesce(x.db, 'unseen') as xd, coalesce(y.db, 'unseen') as yd, coalesce(x.eb, 'unseen') as xe, coalesce(y.eb, 'unseen') as ye,
    x.p is not null as sa, y.p is not null as sb, ln(1 + coalesce(x.positive_degree, 0) * coalesce(y.positive_degree, 0)) as score
  from rows_ r left join deg x on x.p = a left join deg y on y.p = b where split <> 'train'),
rk as (select *, list_position(['unseen', 'zero', 'low', 'mid', 'high'], xd) <= list_position(['unseen', 'zero', 'low', 'mid', 'high'], yd) as df,
  list_position(['unseen', 'low', 'mid', 'high'], xe) <= list_position(['unseen', 'low', 'mid', 'high'], ye) as ef from held),
ann as (select source_row_index, split, label as target, score,
  case when df then xd else yd end as positive_degree_least, case when df then yd else xd end as positive_degree_greatest,
  case when df then xd || '|' || yd else yd || '|' || xd end as positive_degree_pair,
  case when ef then xe else ye end as training_exposure_least, case when ef then ye else xe end as training_exposure_greatest,
  case when ef then xe || '|' || ye else ye || '|' || xe end as training_exposure_pair,
  case when sa and sb then 'both_seen' when not sa and not sb then 'neither_seen' else 'one_seen' end as endpoint_novelty,
  case when sa = sb then 'not_applicable' when sa then xd else yd end as positive_degree_familiar,
  case when sa = sb then 'not_applicable' when sa then xe else ye end as training_exposure_familiar from rk)
"""


def _annotated(spark, d):
    rows = materialize(assigned_pairs(spark, d), "assigned")
    return degree.annotate(rows.filter("split <> 'train'"), degree.degree_profile(rows.filter("split = 'train'")))


@_query(_ANN + "select * exclude (target, score), round(score, 6) as pa_score from ann")
def endpoint_annotations(spark, d):
    rows = _annotated(spark, d)
    keep = [c for c in rows.columns if c not in ("pair_id", "system_type", "source", "protein_a", "protein_b", "label", "pa_score")]
    return rows.select(*keep, _r("pa_score"))


def _scored(spark, d):
    return _annotated(spark, d).withColumnsRenamed({"label": "target", "pa_score": "score"})


_LONG = _ANN + """, long as (select split, target, round(score, 9) as score, u.axis, u.stratum from ann, lateral (values ('global', 'all'),
  ('positive_degree_least', positive_degree_least), ('positive_degree_greatest', positive_degree_greatest), ('positive_degree_pair', positive_degree_pair),
  ('training_exposure_least', training_exposure_least), ('training_exposure_greatest', training_exposure_greatest), ('training_exposure_pair', training_exposure_pair),
  ('endpoint_novelty', endpoint_novelty)) u(axis, stratum))
"""
_RANK = """, sc as (select {by}, score, count(*) filter (target = 1) as pos, count(*) filter (target = 0) as neg from {rows} group by {by}, score),
cum as (select *, sum(pos) over w as tp, sum(neg) over w as fp from sc window w as (partition by {by} order by score desc rows unbounded preceding)),
ranked as (select {by}, sum(pos) + sum(neg) as n_examples, sum(pos) as n_positive, sum(neg) as n_negative, round(sum(pos) / (sum(pos) + sum(neg)), 6) as prevalence,
  round(case when sum(pos) > 0 then sum(pos * tp / (tp + fp)) / sum(pos) end, 6) as auprc,
  round(case when sum(pos) > 0 and sum(neg) > 0 then 1 - sum(pos * fp - pos * neg / 2.0) / (sum(pos) * sum(neg)) end, 6) as auroc from cum group by {by})
"""


@_query(_LONG + _RANK.format(by="split, axis, stratum", rows="long") + "select * from ranked")
def stratum_metrics(spark, d):
    long = degree.stratified(_scored(spark, d).withColumn("score", F.round("score", 9)), "random", ["split", "target", "score"])
    out = metrics.ranking_metrics(long, "split", "axis", "stratum")
    return out.select("split", "axis", "stratum", "n_examples", "n_positive", "n_negative", _r("prevalence"), _r("auprc"), _r("auroc"))


_THR = """, sv as (select split, target, round(score, 9) as score from ann),
cand as (select split, score, sum(pos) as pos, sum(neg) as neg from (select split, score, (target = 1)::int as pos, (target = 0)::int as neg from sv
  union all select distinct split, 1.5, 0, 0 from sv) group by 1, 2),
cm as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by split) as np from cand window w as (partition by split order by score desc rows unbounded preceding)),
fs as (select split, score, coalesce(2 * tp / nullif(tp + fp + np, 0), 0) as f1 from cm),
best as (select split, score as threshold, round(f1, 6) as f1, count(*) over (partition by split) as n_candidates,
  row_number() over (partition by split order by round(f1, 12) desc, round(abs(score - 1.5), 12), score desc) as rn from fs)
"""


@_query(_ANN + _THR + "select split, round(threshold, 6) as threshold, f1, n_candidates from best where rn = 1")
def selected_thresholds(spark, d):
    rows = _scored(spark, d).withColumn("score", F.round("score", 9))
    return metrics.select_threshold(rows, 1.5, "split").select("split", _r("threshold"), _r("f1"), "n_candidates")


_FIXED = """select {by}, round(avg((prediction = target)::int), 6) as accuracy,
  round(count(*) filter (target = 1 and prediction = 1) / nullif(count(*) filter (prediction = 1), 0), 6) as precision,
  round(coalesce(count(*) filter (target = 1 and prediction = 1) / nullif(count(*) filter (target = 1), 0), 0), 6) as recall,
  round(coalesce(2 * count(*) filter (target = 1 and prediction = 1) / nullif(2 * count(*) filter (target = 1 and prediction = 1) + count(*) filter (target <> prediction), 0), 0), 6) as f1
  from {rows} group by {by}"""


@_query(_ANN + _THR + ", pred as (select sv.*, (score >= (select threshold from best where split = 'val' and rn = 1))::int as prediction from sv where split = 'test') " + _FIXED.format(by="split", rows="pred"))
def policy_metrics(spark, d):
    """Test metrics at the threshold chosen on validation."""
    rows = _scored(spark, d).withColumn("score", F.round("score", 9))
    out = metrics.apply_policy(rows.filter("split = 'val'"), rows.filter("split = 'test'"), 1.5)
    return metrics.threshold_metrics(out, "split").select("split", _r("accuracy"), _r("precision"), _r("recall"), _r("f1"))


@_query(""", pred as (select event_type, user_id % 4 as bucket, (event_type = 'purchase' or props like '%1%')::int as target, value as score, (value >= 30)::int as prediction from events)
""".replace(", pred as", "with pred as", 1) + _RANK.format(by="bucket", rows="pred") + ", fixed as (" + _FIXED.format(by="bucket", rows="pred") + ") select * from ranked join fixed using (bucket)", base=False)
def event_metrics(spark, d):
    e = load(spark, d, "events")
    target = ((F.col("event_type") == "purchase") | F.col("props").like("%1%")).cast("int")
    rows = e.select((F.col("user_id") % 4).alias("bucket"), target.alias("target"), F.col("value").alias("score"), metrics.predict_at(F.col("value"), 30).alias("prediction"))
    out = metrics.all_metrics(rows, "bucket")
    return out.select("bucket", "n_examples", "n_positive", "n_negative", *map(_r, ("prevalence", "auprc", "auroc", "accuracy", "precision", "recall", "f1")))


@_query("""select split, count(*) as n_proteins, min(n) as min, max(n) as max, round(avg(n), 6) as mean, round(stddev_pop(n), 6) as std, quantile_cont(n, 0.25) as q25, quantile_cont(n, 0.5) as median, quantile_cont(n, 0.75) as q75
  from (select split, p, count(*) as n from (select split, a as p from rows_ union all select split, b from rows_) group by 1, 2) group by 1""")
def split_degree_summary(spark, d):
    out = degree.degree_summary(assigned_pairs(spark, d), "split")
    return out.select("split", "n_proteins", "min", "max", _r("mean"), _r("std"), "q25", "median", "q75")


@_query(""", g as (select split, p, count(*) as n from (select split, a as p from rows_ union all select split, b from rows_) group by 1, 2),
q as (select split, quantile_cont(n, [0, .05, .1, .15, .2, .25, .3, .35, .4, .45, .5, .55, .6, .65, .7, .75, .8, .85, .9, .95, 1]) as q, avg(n) as m from g group by 1)
select round(list_sum(list_transform(list_zip(l.q, r.q), lambda x: abs(x[1] / l.m - x[2] / r.m))) / 21, 6) as distance from q l, q r where l.split = 'train' and r.split = 'test'""")
def degree_distance(spark, d):
    return degree.degree_distance(assigned_pairs(spark, d), "train", "test").select(_r("distance"))


@_query("""with l as (select l_orderkey as o, l_linenumber as n, l_partkey as p, l_returnflag as f from lineitem),
e as (select distinct least(x.p, y.p)::varchar as a, greatest(x.p, y.p)::varchar as b from l x join l y on x.o = y.o and x.n < y.n where x.p <> y.p),
g as (select p, count(*) as degree from (select a as p from e union all select b from e) group by 1),
c as (select quantile_cont(degree, 0.5) as lo, quantile_cont(degree, 0.9) as hi from g)
select case when degree <= lo then 'low' when degree <= hi then 'mid' else 'high' end as bin, count(*) as nodes, sum(degree) as degree_sum, round(avg(degree), 6) as degree_mean from g, c group by 1""", base=False)
def order_graph_degrees(spark, d):
    """The same profile on a larger graph: parts that meet in an order."""
    line = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    met = line.alias("x").join(line.alias("y"), F.expr("x.l_orderkey = y.l_orderkey and x.l_linenumber < y.l_linenumber and x.l_partkey <> y.l_partkey"))
    rows = met.select(F.col("x.l_partkey").cast("string").alias("protein_a"), F.col("y.l_partkey").cast("string").alias("protein_b"), F.lit(1).alias("label"))
    # numbers order differently from their text, which doesn't matter for an unordered pair
    profile = degree.degree_profile(rows).groupBy(F.col("positive_degree_bin").alias("bin"))
    c = "positive_degree"
    return profile.agg(F.count(F.lit(1)).alias("nodes"), F.sum(c).alias("degree_sum"), F.round(F.avg(c), 6).alias("degree_mean"))


# --- features ----------------------------------------------------------------------------------------------------------------


def _terms(spark, d, k: int = 3):
    """K-mer counts of the sequences, and the ids of the proteins in training rows."""
    s = materialize(sequences(spark, d), "sequences")
    train = pr.proteins_in(_train(spark, d)).join(s, "protein_id", "left_semi").select(F.col("protein_id").alias("row_id"))
    return features.term_counts(s, "protein_id", "sequence", k), train


_KMER = """, km as (select p as row_id, term, count(*) as tf from (select p, unnest(list_transform(range(1, length(sequence) - 1), lambda i: substr(sequence, i, 3))) as term from seqs where length(sequence) >= 3) group by 1, 2),
tid as (select p from seqs where p in (select a from train union select b from train)),
voc as (select term, count(*) as df from km where row_id in (select p from tid) group by 1)
"""
_PER_ROW = "select row_id, count(*) as n_terms, round(sum(value), 4) as total, round(max(value), 6) as greatest from ({}) group by 1"


def _per_row(table):
    return table.groupBy("row_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 6).alias("greatest"))


@_query(_KMER + "select term, df from voc")
def kmer_vocabulary(spark, d):
    counts, train = _terms(spark, d)
    return features.vocabulary(counts.join(train, "row_id", "left_semi"))


@_query(_KMER + _PER_ROW.format("select row_id, term, tf as value from km join voc using (term)"))
def count_features(spark, d):
    counts, train = _terms(spark, d)
    return _per_row(features.feature_table(counts, train, "count"))


@_query(_KMER + _PER_ROW.format("select row_id, term, 1.0 as value from km join voc using (term)"))
def binary_features(spark, d):
    counts, train = _terms(spark, d)
    return _per_row(features.feature_table(counts, train, "binary"))


_TFIDF = """select row_id, term, w / sqrt(sum(w * w) over (partition by row_id)) as value from (
  select row_id, term, tf * (ln((1 + (select count(*) from tid)) / (1 + df)) + 1) as w from km join voc using (term))"""


@_query(_KMER + _PER_ROW.format(_TFIDF))
def tfidf_features(spark, d):
    counts, train = _terms(spark, d)
    return _per_row(features.feature_table(counts, train, "tfidf"))


@_query(_KMER + """, kn as (select * from km join voc using (term)), dl as (select row_id, sum(tf) as dl from kn group by 1),
st as (select count(*) as n, greatest(avg(coalesce(dl, 0)), 1e-12) as av from tid left join dl on row_id = p)
""" + _PER_ROW.format("select row_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av)) as value from kn join dl using (row_id), st"))
def bm25_features(spark, d):
    counts, train = _terms(spark, d)
    return _per_row(features.feature_table(counts, train, "bm25"))


@_query(_KMER + f""", ft as ({_TFIDF}), pp as (select a || '|' || b as pair_id, a, b from clean where a in (select p from seqs) and b in (select p from seqs)),
en as (select pair_id, term, coalesce(sum(value) filter (s = 0), 0) as x, coalesce(sum(value) filter (s = 1), 0) as y from (
  select pair_id, a as row_id, 0 as s from pp union all select pair_id, b, 1 from pp) join ft using (row_id) group by 1, 2)
select pair_id, part, count(*) as n_terms, round(sum(value), 4) as total from (select pair_id, u.part, u.value from en, lateral (values ('sum', x + y), ('difference', abs(x - y)), ('product', x * y)) u(part, value)) where value <> 0 group by 1, 2""")
def composed_pairs(spark, d):
    """Sum, difference and product of the endpoints' tf-idf rows, summarised per pair and part."""
    counts, train = _terms(spark, d)
    rows = pr.with_sequences(clean_pairs(spark, d), sequences(spark, d)).withColumn("pair_id", F.concat_ws("|", "protein_a", "protein_b"))
    out = features.compose_sparse(rows, features.feature_table(counts, train, "tfidf"))
    return out.groupBy("pair_id", "part").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("value"), 4).alias("total"))


@_query("""with e as (select vec_id, embedding::double[] as x, lead(embedding::double[]) over (order by vec_id) as y from embeddings)
select vec_id, 192 as n_values, round(list_sum(list_transform(list_zip(x, y), lambda p: p[1] + p[2] + abs(p[1] - p[2]) + p[1] * p[2])), 4) as total from e where y is not null""", base=False)
def composed_embeddings(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    # the neighbour by id: one ordered window over the small id column, then a join
    nxt = e.select("vec_id", F.lead("vec_id").over(W.orderBy("vec_id")).alias("next"))
    both = e.join(nxt.filter("next is not null"), "vec_id").join(e.select(F.col("vec_id").alias("next"), F.col("x").alias("y")), "next")
    v = features.compose_dense(F.col("x"), F.col("y"))
    return both.select("vec_id", F.size(v).alias("n_values"), F.round(F.aggregate(v, F.lit(0.0), lambda s, z: s + z), 4).alias("total"))


@_query(_KMER + """select (select count(*) from seqs) as n_rows, count(distinct term) as n_columns, count(*) as n_stored,
  round(count(*) / ((select count(*) from seqs) * count(distinct term)), 6) as density, count(*) * 12 as n_bytes from km join voc using (term)""")
def matrix_statistics(spark, d):
    counts, train = _terms(spark, d)
    return features.matrix_statistics(features.feature_table(counts, train, "count"), sequences(spark, d).count()).withColumn("density", F.round("density", 6))


# --- samples and splits ------------------------------------------------------------------------------------------------------


@_query(""", s as (select *, row_number() over (partition by label order by md5('5|' || source_row_index), source_row_index) - 1 as j, count(*) over (partition by label) as size from valid),
o as (select *, case when j < 3 then 0 else 1 end as g, case when j < 3 then j else -size / (2 * j + 1) end as pr from s),
k as (select *, row_number() over (order by g, pr, label) - 1 as sampling_rank from o)
select source_row_index, label, sampling_rank from k where sampling_rank < 500""")
def cohort(spark, d):
    """500 rows, at least three of each label, nested and about proportional."""
    rows = valid_pairs(spark, d).select("source_row_index", "label")
    return sampling.select_cohort(rows, "source_row_index", sampling.CohortSpec(max_examples=500, seed=5, minimum_per_stratum=3), ["label"])


@_query()
def global_negatives(spark, d):
    positives = clean_pairs(spark, d).filter("label = 1")
    return sampling.sample_negatives(positives, sampling.NegativeSpec("global", 1.0, 3))


@_query()
def taxon_matched_negatives(spark, d):
    t = taxa(spark, d)
    positives = clean_pairs(spark, d).filter("label = 1")
    known = t.select("protein_id")
    positives = positives.join(known.withColumnRenamed("protein_id", "protein_a"), "protein_a", "left_semi").join(known.withColumnRenamed("protein_id", "protein_b"), "protein_b", "left_semi")
    return sampling.sample_negatives(positives.select("protein_a", "protein_b", "label"), sampling.NegativeSpec("taxon_pair_matched", 0.5, 3), t)


@_query(""", s as (select *, row_number() over (partition by label order by md5('7|' || source_row_index), source_row_index) - 1 as j, count(*) over (partition by label) as n from valid)
select source_row_index, label, case when j < floor(0.8 * n + 1e-9) then 'train' when j < floor(0.9 * n + 1e-9) then 'val' else 'test' end as split from s""")
def random_split(spark, d):
    return splits.random_pairs(valid_pairs(spark, d).select("source_row_index", "label"), "source_row_index", 0.8, 0.1, 7)


@_query(""", un as (select a as lo, b as hi, count(*) as size, ('0x' || substr(md5('11|' || a || '|' || b), 1, 13))::bigint::double as u from clean group by 1, 2),
en as (select lo as p, u, lo, hi from un union all select hi, u, lo, hi from un),
an as (select distinct lo, hi from (select lo, hi, row_number() over (partition by p order by u desc, lo desc, hi desc) as r from en) where r = 1),
fr as (select *, sum(size) over (order by u) as upto, (select sum(size) from un) as total from un where (lo, hi) not in (select (lo, hi) from an))
select c.a as protein_a, c.b as protein_b, c.label, coalesce(case when upto - size / 2.0 <= 0.1 * total then 'test' when upto - size / 2.0 <= (0.1 + 0.1) * total then 'val' end, 'train') as split
from clean c left join fr on fr.lo = c.a and fr.hi = c.b""")
def c1_split(spark, d):
    return splits.c1(clean_pairs(spark, d), 0.1, 0.1, 11)


def _parts_sql(seed: int, mode: str) -> str:
    place = {
        "c2": "when least(x, y) = 0 and greatest(x, y) = 1 then 'val' when least(x, y) = 0 and greatest(x, y) = 2 then 'test'",
        "c3": "when x = 1 and y = 1 then 'val' when x = 2 and y = 2 then 'test'",
    }[mode]
    weights = {"c2": "[1.0, 0.1 / 1.6, 0.1 / 1.6]", "c3": "[sqrt(0.8), sqrt(0.1), sqrt(0.1)]"}[mode]
    return f""", gr as (select p, coalesce(t, p) as g from (select a as p from clean union select b from clean) left join tx using (p)),
gn as (select count(distinct g) as n, {weights} as w from gr), cn as (select n, greatest(1, floor(n * w[2] / list_sum(w))) as v, greatest(1, floor(n * w[3] / list_sum(w))) as t, n * w[1] / list_sum(w) as raw1, n * w[2] / list_sum(w) as raw2 from gn),
ck as (select n, floor(raw1) as c1, v as c2, t as c3, raw1, raw2 from cn),
cf as (select n, c1, c2, c3, n - c1 - c2 - c3 as missing, raw1 - c1 as g1, raw2 - c2 as g2 from ck),
cc as (select case when missing = 0 then c1 when missing = 1 then c1 + (g1 >= g2)::int when missing = 2 then c1 + (g1 >= g2)::int end as n1,
  case when missing = 0 then c2 when missing = 1 then c2 + (g1 < g2)::int else c2 + 1 end as n2 from cf),
rk as (select g, row_number() over (order by ('0x' || substr(md5('{seed}|' || g), 1, 13))::bigint) as r from (select distinct g from gr)),
pt as (select p, gr.g, case when r <= n1 then 0 when r <= n1 + n2 then 1 else 2 end as part from gr join rk on rk.g = gr.g, cc),
pl as (select a, b, label, pa.part as x, pb.part as y from clean join pt pa on pa.p = a join pt pb on pb.p = b)
select a as protein_a, b as protein_b, label, case when x = 0 and y = 0 then 'train' {place} else 'dropped' end as split from pl"""


def _single(spark, d, mode: str, seed: int) -> DataFrame:
    """The assignment of one seed as it is, valid or not."""
    rows = materialize(clean_pairs(spark, d), "clean")
    groups = materialize(taxon_groups(spark, d, rows), "groups")
    n = groups.select("group_id").distinct().count()
    parts = splits.partitions(groups, splits.partition_counts(mode, n, 0.1, 0.1), [seed])
    return splits.place_groups(rows, groups, parts, mode).select("protein_a", "protein_b", "label", "split")


@_query(_parts_sql(21, "c2"))
def c2_assignment(spark, d):
    return _single(spark, d, "c2", 21)


@_query(_parts_sql(22, "c3"))
def c3_assignment(spark, d):
    return _single(spark, d, "c3", 22)


@_query()
def best_c3_split(spark, d):
    """The best of 20 valid assignments of taxa."""
    rows = materialize(clean_pairs(spark, d), "clean")
    return splits.entity_split(rows, taxon_groups(spark, d, rows), "c3", 0.1, 0.1, seed=0, n_trials=20)


@_query("select 'no_shared_pairs' as invariant, 0 as n_violations union all select 'held_out_endpoints_in_train', 0", base=False)
def c1_invariants(spark, d):
    return splits.invariants(splits.c1(clean_pairs(spark, d), 0.1, 0.1, 11), "c1")


@_query("select 'no_shared_pairs' as invariant, 0 as n_violations union all select 'exactly_0_endpoint_in_train', 0", base=False)
def c3_invariants(spark, d):
    return splits.invariants(_single(spark, d, "c3", 22), "c3")


@_query("select source_row_index, split from asg where split is not null")
def provided_split(spark, d):
    """The assignment as a split column: named without regard to case and blanks, other values refused."""
    rows = load(spark, d, "split_assignments").filter("source_row_index is not null and split is not null")
    clean = rows.select("source_row_index", F.regexp_replace("split", _SPACE, "").alias("given")).distinct()
    return splits.provided(clean, "given").select("source_row_index", "split").distinct()


@_query("""select source_row_index from (select source_row_index, -ln(1 - ('0x' || substr(md5('4|' || source_row_index), 1, 13))::bigint / 4503599627370496.0) / (1 + label) as k from valid)
  order by k, source_row_index limit 400""")
def weighted_rows(spark, d):
    """400 rows, positive ones twice as likely at each draw."""
    rows = valid_pairs(spark, d).select("source_row_index", "label")
    return sampling.weighted_sample(rows, 1 + F.col("label"), 400, 4, "source_row_index").select("source_row_index")


@_query("select (select count(*) from clean where label = 1) as n_negatives, 0 as n_observed, 0 as n_self, 0 as n_repeated")
def negative_invariants(spark, d):
    """As many negatives as positives, none of them observed, a self pair or repeated."""
    positives = clean_pairs(spark, d).filter("label = 1")
    drawn = sampling.sample_negatives(positives, sampling.NegativeSpec("global", 1.0, 3))
    seen = positives.select("protein_a", "protein_b", F.lit(1).alias("seen"))
    per = drawn.groupBy("protein_a", "protein_b").agg(F.count(F.lit(1)).alias("n")).join(seen, ["protein_a", "protein_b"], "left")
    return per.agg(
        F.sum("n").alias("n_negatives"), F.count("seen").alias("n_observed"), F.count_if(F.expr("protein_a = protein_b")).alias("n_self"), F.sum(F.col("n") - 1).alias("n_repeated")
    )


@_query()
def sequence_clusters(spark, d):
    """Approximate clusters of the sequences by their k-mers."""
    return clustering.cluster_sequences(sequences(spark, d))


# --- run tables --------------------------------------------------------------------------------------------------------------

_MODELS = {"click": "degree_logistic", "view": "degree_hgb", "purchase": "preferential_attachment"}
_RUNS = """with runs as (select case event_type when 'click' then 'degree_logistic' when 'view' then 'degree_hgb' when 'purchase' then 'preferential_attachment' else 'mlp_' || event_type end as model_name,
    (user_id % 5)::int as split_seed, case (user_id // 5) % 3 when 0 then 'random' when 1 then 'c1' else 'c2' end as split_strategy, case event_id % 2 when 0 then 'train' else 'val' end as split,
    (event_id // 2) % 3 as run_number, value / 101 as auprc from events),
cells as (select model_name, split_seed, split_strategy, split, run_number, avg(auprc) as auprc from runs group by all)
"""


def _runs(spark, d) -> DataFrame:
    """A table of metric rows: one per model, seed, strategy, split and run."""
    e = load(spark, d, "events")
    model = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in _MODELS.items()), F.concat(F.lit("mlp_"), "event_type"))
    strategy = F.get(F.array(*(F.lit(s) for s in ("random", "c1", "c2"))), (F.floor(F.col("user_id") / 5) % 3).cast("int"))
    rows = e.select(
        model.alias("model_name"), (F.col("user_id") % 5).cast("int").alias("split_seed"), strategy.alias("split_strategy"),
        F.when(F.col("event_id") % 2 == 0, "train").otherwise("val").alias("split"), (F.floor(F.col("event_id") / 2) % 3).alias("run_number"), (F.col("value") / 101).alias("auprc"),
    )
    return rows.groupBy("model_name", "split_seed", "split_strategy", "split", "run_number").agg(F.avg("auprc").alias("auprc"))


def _gated(spark, d) -> DataFrame:
    """Validation rows with the columns that gates and contexts need; all hashes agree."""
    rows = _runs(spark, d).filter("split = 'val'").withColumn("stratification_axis", F.lit("global"))
    rows = rows.withColumn("model_role", F.when(F.col("model_name").startswith("mlp_"), "predictive_model").otherwise("control"))
    for c in summaries.GATES:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string") if c == "grouping_sha256" else F.lit("x"))
    return rows


def _lift_rows(spark, d) -> DataFrame:
    """:func:`_gated` with one attachment row per gate, as attachment runs must not differ behind a gate."""
    rows = _gated(spark, d)
    pa = rows.filter(F.col("model_name") == summaries.ATTACHMENT)
    keys = [c for c in rows.columns if c not in ("auprc", "run_number")]
    once = pa.groupBy(*keys).agg(F.avg("auprc").alias("auprc")).withColumn("run_number", F.lit(None).cast("bigint"))
    return rows.filter(F.col("model_name") != summaries.ATTACHMENT).unionByName(once).withColumn("execution_id", F.col("run_number"))


@_query(_RUNS + """select model_name, split_strategy, split, count(*) as n_runs, round(avg(auprc), 6) as auprc_mean,
  round(stddev_samp(auprc) / sqrt(count(auprc)), 6) as auprc_standard_error from cells group by 1, 2, 3""", base=False)
def run_summary(spark, d):
    out = summaries.summarize(_runs(spark, d), ["model_name", "split_strategy", "split"], ["auprc"])
    return out.select("model_name", "split_strategy", "split", "n_runs", _r("auprc_mean"), _r("auprc_standard_error"))


@_query(_RUNS + """, ps as (select model_name, split_strategy, split, split_seed, count(*) as n, avg(auprc) as auprc from cells group by 1, 2, 3, 4)
select model_name, split_strategy, split, count(distinct split_seed) as n_split_seeds, sum(n) as n_model_runs, round(avg(auprc), 6) as auprc_mean,
  round(stddev_samp(auprc) / sqrt(count(auprc)), 6) as auprc_standard_error from ps group by 1, 2, 3""", base=False)
def seed_summary(spark, d):
    out = summaries.summarize_over_seeds(_runs(spark, d), ["model_name", "split_strategy", "split"], ["auprc"])
    return out.select("model_name", "split_strategy", "split", "n_split_seeds", "n_model_runs", _r("auprc_mean"), _r("auprc_standard_error"))


_SEL = _RUNS + """, ev as (select split_strategy, split_seed, avg(auprc) filter (model_name = 'degree_logistic') as p, avg(auprc) filter (model_name = 'degree_hgb') as s from cells where split = 'val' group by 1, 2),
sel as (select case when bool_or(complete and med - 0.02 > 1.02e-12 and wins >= 4) then 'degree_hgb' else 'degree_logistic' end as selected_control from (
  select split_strategy, count(s - p) = 5 as complete, quantile_cont(s - p, 0.5) as med, count(*) filter (s > p) as wins from ev group by 1))
"""


@_query(_SEL + "select 'x' as control_selection_context_sha256, selected_control from sel", base=False)
def control_selection(spark, d):
    return summaries.select_control(_gated(spark, d))


@_query(_SEL + """, rf as (select model_name, split_strategy, split_seed, avg(auprc) as v from cells where split = 'val' group by 1, 2, 3)
select m.model_name, m.split_strategy, m.split_seed, m.run_number, selected_control as selected_fitted_control, round(m.auprc, 6) as model_auprc, round(c.v, 6) as degree_control_auprc, round(p.v, 6) as pa_auprc,
  round(m.auprc - c.v, 6) as absolute_lift, round(m.auprc / nullif(c.v, 0), 6) as metric_ratio, round(m.auprc - p.v, 6) as absolute_lift_vs_pa, round(c.v - p.v, 6) as fitting_gain
from cells m, sel join rf c on c.model_name = selected_control and c.split_strategy = m.split_strategy and c.split_seed = m.split_seed
join rf p on p.model_name = 'preferential_attachment' and p.split_strategy = m.split_strategy and p.split_seed = m.split_seed
where m.split = 'val' and m.model_name like 'mlp%'""", base=False)
def degree_lift(spark, d):
    rows = _lift_rows(spark, d)
    out = summaries.degree_lift(rows, summaries.select_control(rows))
    return out.select(
        "model_name", "split_strategy", "split_seed", F.col("execution_id").alias("run_number"), "selected_fitted_control",
        *map(_r, ("model_auprc", "degree_control_auprc", "pa_auprc", "absolute_lift", "metric_ratio", "absolute_lift_vs_pa", "fitting_gain")),
    )


@_query(_SEL + """, rf as (select model_name, split_strategy, split_seed, avg(auprc) as v from cells where split = 'val' group by 1, 2, 3),
l as (select m.model_name, m.split_strategy, m.auprc - c.v as lift from cells m, sel join rf c on c.model_name = selected_control and c.split_strategy = m.split_strategy and c.split_seed = m.split_seed
  where m.split = 'val' and m.model_name like 'mlp%')
select model_name, split_strategy, count(*) as n_rows, round(avg(lift), 6) as absolute_lift from l group by 1, 2""", base=False)
def lift_table(spark, d):
    rows = _lift_rows(spark, d)
    out = summaries.lift_table(summaries.degree_lift(rows, summaries.select_control(rows)))
    return out.select("model_name", "split_strategy", "n_rows", _r("absolute_lift"))


@_query("select event_type, cast(json_extract_string(props, '$.k') as bigint) % 10 as k, count(*) as n from events group by 1, 2", base=False)
def json_fields(spark, d):
    """A field of a JSON column, grouped."""
    k = F.get_json_object("props", "$.k").try_cast("bigint") % 10
    return load(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@_query(_RUNS + """, t as (select model_name, split_strategy, round(avg(auprc), 6) as m from cells where split = 'train' and split_seed < 3 group by 1, 2),
v as (select model_name, split_strategy, round(avg(auprc), 6) as m from cells where split = 'val' and run_number > 0 group by 1, 2)
select coalesce(t.model_name, v.model_name) as model_name, coalesce(t.split_strategy, v.split_strategy) as split_strategy, t.m as m_train, v.m as m_test
from t full join v on t.model_name = v.model_name and t.split_strategy = v.split_strategy""", base=False)
def aligned_summaries(spark, d):
    rows = _runs(spark, d)
    mean = lambda x: x.groupBy("model_name", "split_strategy").agg(F.round(F.avg("auprc"), 6).alias("m"))
    return summaries.align_splits(mean(rows.filter("split = 'train' and split_seed < 3")), mean(rows.filter("split = 'val' and run_number > 0")), ["model_name", "split_strategy"], ["m"])


@_query(_RUNS + """select split_strategy, 'identity' as grouping, model_name, 'legacy' as negative_context, round(avg(auprc) filter (split = 'train'), 6) as train, round(avg(auprc) filter (split = 'val'), 6) as val
from cells group by 1, 3 having count(*) filter (split = 'train') > 0 and count(*) filter (split = 'val') > 0""", base=False)
def train_val_table(spark, d):
    rows = _runs(spark, d).withColumn("grouping", F.lit("identity")).withColumn("negative_context", F.lit(None).cast("string"))
    out = summaries.train_val_f1(rows.withColumnsRenamed({"split": "summary_split", "auprc": "f1_mean"}))
    return out.select("split_strategy", "grouping", "model_name", "negative_context", _r("train"), _r("val"))


@_query(_RUNS + """select split_strategy, model_name, round(val, 6) as val, row_number() over (partition by split_strategy order by val desc, model_name) as position from (
select split_strategy, model_name, avg(auprc) filter (split = 'val') as val from cells group by 1, 2 having count(*) filter (split = 'train') > 0 and count(*) filter (split = 'val') > 0)""", base=False)
def model_order(spark, d):
    rows = _runs(spark, d).withColumn("grouping", F.lit("identity")).withColumn("negative_context", F.lit(None).cast("string"))
    out = summaries.panel_order(summaries.train_val_f1(rows.withColumnsRenamed({"split": "summary_split", "auprc": "f1_mean"})))
    return out.select("split_strategy", "model_name", _r("val"), "position")


# --- scalar functions ----------------------------------------------------------------------------------------------------------


@_query(r"""select record_id, upper(regexp_replace(sequence, '\s+', '', 'g')) as normal, sha256(upper(regexp_replace(sequence, '\s+', '', 'g'))) as digest,
  length(sequence) as n from fasta_sequences""", base=False)
def sequence_digests(spark, d):
    f = load(spark, d, "fasta_sequences")
    return f.select("record_id", normalize_sequence(F.col("sequence")).alias("normal"), sequence_sha256(F.col("sequence")).alias("digest"), F.length("sequence").alias("n"))


@_query(r"""select record_id, trim(regexp_replace(translate(upper(regexp_replace(sequence, '\s+', '', 'g')), 'UZOB', 'XXXX'), '(.)', '\1 ', 'g')) as spaced from fasta_sequences""", base=False)
def spaced_sequences(spark, d):
    return load(spark, d, "fasta_sequences").select("record_id", prottrans_sequence(F.col("sequence")).alias("spaced"))


@_query(r"""select protein_id, nullif(regexp_extract(trim(taxon_id), '^0*([1-9][0-9]*)$', 1), '') as taxon_id, count(*) as n from protein_metadata group by 1, 2""", base=False)
def normalized_taxa(spark, d):
    return load(spark, d, "protein_metadata").groupBy("protein_id", normalize_taxon(F.col("taxon_id")).alias("taxon_id")).agg(F.count(F.lit(1)).alias("n"))


@_query(r"""select component, count(*) as n from (select case when coalesce(c, '') = '' then 'unnamed' else c end as component from (
  select trim(regexp_replace(protein_a, '[^A-Za-z0-9_.-]+', '_', 'g'), '._') as c from pairs)) group by 1""", base=False)
def safe_components(spark, d):
    return load(spark, d, "pairs").groupBy(safe_component(F.col("protein_a")).alias("component")).agg(F.count(F.lit(1)).alias("n"))


@_query("""select p as protein_id, 'OX=' || t as token, t as taxon_id from tx""")
def header_fields(spark, d):
    header = F.concat_ws(" ", F.concat(F.lit("sp|"), "protein_id", F.lit("|NAME")), F.lit("text"), F.concat(F.lit("OX="), F.lit("0"), "taxon_id"))
    t = taxa(spark, d).withColumn("header", header)
    return t.select(header_id(F.col("header"), "uniprot_accession").alias("protein_id"), F.concat(F.lit("OX="), header_taxon(F.col("header"))).alias("token"), header_taxon(F.col("header")).alias("taxon_id"))


@_query(""", ex as (select p as protein_id, sequence, unnest(range(0, length(sequence), 40))::int as i from seqs)
select protein_id || ':' || i || ':unspecified' as example_id, protein_id, i as residue_index, substr(sequence, i + 1, 1) as residue, 'unspecified' as ptm_type, i % 2 as label,
  substr(sequence, greatest(i - 5, 0) + 1, least(i + 6, length(sequence)) - greatest(i - 5, 0)) as "window", i - greatest(i - 5, 0) as target_index, true as residue_ok from ex""")
def residue_windows(spark, d):
    s = sequences(spark, d)
    i = F.explode(F.sequence(F.lit(0), F.length("sequence") - 1, F.lit(40)))
    rows = s.select("protein_id", "sequence", i.alias("residue_index"))
    rows = rows.select("protein_id", "residue_index", F.substr("sequence", F.col("residue_index") + 1, F.lit(1)).alias("residue"), (F.col("residue_index") % 2).alias("label"))
    return residues.windows(residues.residue_examples(rows), s, 5)


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

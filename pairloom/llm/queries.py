"""Queries of the training-data operators, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.accession import accession, accession_of, alphanumeric, decode_accession, encode_accession
from ..plans.corpus_queries import acc_sql
from ..session import load, materialize
from . import calibrate, dedup, mixture, spam, tokenize
from .grouped_split import GroupedSplit
from .overlap import CrossSplitOverlap, word_shingles
from .stable_sample import stable_sample

_EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def split_name(value: Column) -> Column:
    """Split without regard to case and surrounding whitespace; blank is null."""
    return F.nullif(F.lower(F.regexp_replace(value, _EDGE_SPACE, "")), F.lit(""))


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(``row_id``, ``split``), whole rows repeated only once, without null ids and splits."""
    rows = load(spark, sf_dir, "split_assignments").select(F.col("source_row_index").alias("row_id"), split_name(F.col("split")).alias("split"))
    return rows.filter("row_id is not null and split is not null").distinct()


# --- p2: the same or nearly the same record on both sides of the cut -------------------------------------------------


def _overlap(spark: SparkSession, sf_dir: str) -> CrossSplitOverlap:
    pairs = load(spark, sf_dir, "pairs")
    named = pairs.select(
        F.col("source_row_index").alias("row_id"), "source",
        encode_accession(accession(F.col("protein_a"))).alias("a"), encode_accession(accession(F.col("protein_b"))).alias("b"),
    ).filter("a is not null and b is not null")
    rows = named.join(assignments(spark, sf_dir), "row_id")
    rows = rows.select("row_id", "source", "split", (F.col("split") == "train").alias("is_train"), F.array("a", "b").alias("shingles"))
    return CrossSplitOverlap(rows, pairs.count(), threshold=0.8, most_shingles=2)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _overlap(spark, sf_dir).row_pairs()
    return pairs.select(F.least("train_id", "eval_id").alias("low_row_index"), F.greatest("train_id", "eval_id").alias("high_row_index"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlap(spark, sf_dir).report("split", "source")


def p2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in evaluation splits (a fifth, by md5 of the id) that a training document repeats or nearly repeats
    (Jaccard similarity of five-word shingles of 0.8 or more), with the number of such training documents."""
    documents = load(spark, sf_dir, "documents").filter("doc_id is not null")
    digit = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 2)
    split = F.when(digit < "cd", "train").when(digit < "e6", "val").otherwise("test")
    rows = documents.select(F.col("doc_id").alias("row_id"), split.alias("split"), (split == "train").alias("is_train"), word_shingles(F.col("text")).alias("shingles"))
    overlap = CrossSplitOverlap(rows, documents.count())
    return overlap.report("row_id", "split").select(F.col("row_id").alias("doc_id"), "split", F.col("n_pairs").alias("n_links"))


# --- p3: a sample that follows target shares ---------------------------------------------------------------------------

_CATEGORY = ["system_type", "label"]


def _calibrated(spark: SparkSession, sf_dir: str, spec_name: str = "proportional"):
    pairs = load(spark, sf_dir, "pairs")
    spec = load(spark, sf_dir, "sampling_specs").filter(F.col("spec_name") == spec_name).first()
    targets = load(spark, sf_dir, "sampling_targets").limit(calibrate.MAX_CATEGORIES + 1).collect()
    categories = [calibrate.Category((t["system_type"], t["label"]), t["target_per_mille"]) for t in targets]
    calibrate.count_categories(pairs.select(*_CATEGORY), _CATEGORY, categories)
    population = pairs.count()
    nominal = calibrate.nominal_size(spec["max_examples"], spec["fraction"], population)
    size = min(nominal, population)
    calibrate.set_targets(categories, size, spec["minimum_per_stratum"], nominal)
    calibrate.tilt(categories, size, population)
    return pairs, spec, categories


def _drawn(spark: SparkSession, sf_dir: str):
    pairs, spec, categories = _calibrated(spark, sf_dir)
    units = calibrate.category_index(pairs.select(F.col("source_row_index").alias("unit_id"), *_CATEGORY), _CATEGORY, categories)
    return calibrate.draw(units.filter("category is not null").select("unit_id", "category"), categories, spec["seed"]), spec, categories


_CATEGORY_TYPES = [("system_type", "string"), ("label", "int")]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of which the drawn sample holds fewer rows than wanted because there are no more."""
    return p3_report(spark, sf_dir).filter(F.col("drawn") < F.col("wanted")).filter(calibrate.falls_short()).select(*_CATEGORY)


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn, spec, categories = _drawn(spark, sf_dir)
    names = spark.createDataFrame([(i, *c.key) for i, c in enumerate(categories)], "category int, system_type string, label int")
    return drawn.join(F.broadcast(names), "category").select(
        F.lit(spec["spec_name"]).alias("spec_name"), F.col("unit_id").alias("source_row_index"), *_CATEGORY
    )


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn, _, categories = _drawn(spark, sf_dir)
    counts = {r[0]: r[1] for r in drawn.groupBy("category").count().collect()}
    return calibrate.report(spark, categories, _CATEGORY_TYPES, counts)


def p3_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of the same size in which system types and labels follow their shares apart from each other, as counts
    per value of each margin."""
    pairs = load(spark, sf_dir, "pairs")
    spec = load(spark, sf_dir, "sampling_specs").filter("spec_name = 'proportional'").first()
    wanted = load(spark, sf_dir, "sampling_targets").limit(calibrate.MAX_CATEGORIES + 1).collect()
    shares: list[dict] = [{}, {}]
    for t in wanted:
        for m, v in enumerate((t["system_type"], t["label"])):
            shares[m][v] = shares[m].get(v, 0) + t["target_per_mille"]
    pairs_of = [calibrate.Category((a, b), 0) for a in shares[0] for b in shares[1]]
    calibrate.count_categories(pairs.select(*_CATEGORY), _CATEGORY, pairs_of)
    population = sum(c.available for c in pairs_of)
    nominal = calibrate.nominal_size(spec["max_examples"], spec["fraction"], pairs.count())
    size = min(nominal, population)
    targets, margins = [], []
    for m, by in enumerate(shares):
        values = [calibrate.Category((v,), w, sum(c.available for c in pairs_of if c.key[m] == v)) for v, w in by.items()]
        calibrate.set_targets(values, size, 0, nominal)
        margins.append(values)
        targets.append({c.key[0]: c.target for c in values})
    chances = calibrate.tilt_margins({c.key: c.available for c in pairs_of}, targets, size, population)
    for c in pairs_of:
        c.probability = chances[c.key] if chances[c.key] < 1 - 1e-9 else 1.0
    units = calibrate.category_index(pairs.select(F.col("source_row_index").alias("unit_id"), *_CATEGORY), _CATEGORY, pairs_of)
    drawn = calibrate.draw(units.filter("category is not null").select("unit_id", "category"), pairs_of, spec["seed"])
    counts = {r[0]: r[1] for r in drawn.groupBy("category").count().collect()}
    rows = []
    for m, (name, values) in enumerate(zip(_CATEGORY, margins, strict=True)):
        for c in values:
            n = sum(counts.get(i, 0) for i, x in enumerate(pairs_of) if x.key[m] == c.key[0])
            rows.append((name, str(c.key[0]), c.per_mille, c.available, round(c.target, 6), n))
    return spark.createDataFrame(rows, "margin string, value string, target_per_mille int, available bigint, target double, drawn bigint")


# --- p5: splits that keep related records together ---------------------------------------------------------------------


def _grouped(spark: SparkSession, sf_dir: str) -> GroupedSplit:
    pairs = load(spark, sf_dir, "pairs")
    shared = load(spark, sf_dir, "shared_proteins").select(encode_accession(accession(F.col("protein_id"))).alias("shared")).distinct()
    n_shared = shared.count()
    rows = pairs.select(
        F.col("source_row_index").alias("row_id"), "label",
        encode_accession(accession(F.col("protein_a"))).alias("a"), encode_accession(accession(F.col("protein_b"))).alias("b"),
    )
    rows = materialize(rows, "row-entities")
    for side in ("a", "b"):
        table = shared.withColumnRenamed("shared", f"shared_{side}")
        if n_shared <= 1_000_000:
            table = F.broadcast(table)
        rows = rows.join(table, F.col(side) == F.col(f"shared_{side}"), "left")
        rows = rows.withColumn(side, F.when(F.col(f"shared_{side}").isNull(), F.col(side))).drop(f"shared_{side}")
    return GroupedSplit(rows, pairs.count())


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    torn = _grouped(spark, sf_dir).torn(assignments(spark, sf_dir))
    return torn.select(decode_accession(F.col("root")).alias("first_protein_id"))


def _shares(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    return {r["split"]: r["target_share"] for r in load(spark, sf_dir, "split_targets").orderBy(F.desc("target_share"), "split").collect()}


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _grouped(spark, sf_dir).assign(_shares(spark, sf_dir))
    return rows.select(F.col("row_id").alias("source_row_index"), decode_accession(F.col("root")).alias("first_protein_id"), "split")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and share reached per split, next to the target."""
    shares = _shares(spark, sf_dir)
    target = spark.createDataFrame(list(shares.items()), "split string, target_share double")
    counts = _grouped(spark, sf_dir).assign(shares).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    total = load(spark, sf_dir, "pairs").count()
    joined = F.broadcast(target).join(counts, "split", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return joined.withColumn("share", F.round(F.col("n_rows") / F.lit(max(total, 1)), 6))


# --- p6: duplicates hidden by formatting --------------------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str, named_only: bool) -> DataFrame:
    """Canonical endpoints in order, label and row id; a row that names no two proteins is a record of its own."""
    pairs = load(spark, sf_dir, "pairs").select(
        "source_row_index", "label", alphanumeric(F.col("protein_a")).alias("a"), alphanumeric(F.col("protein_b")).alias("b")
    )
    named = F.coalesce(accession_of(F.col("a")).isNotNull() & accession_of(F.col("b")).isNotNull(), F.lit(False))
    ends = [F.when(named, F.least("a", "b")).otherwise(F.col("a")).alias("protein_a"), F.when(named, F.greatest("a", "b")).otherwise(F.col("b")).alias("protein_b")]
    if named_only:
        return pairs.filter(named).select(*ends, "label", "source_row_index")
    return pairs.select(*ends, "label", F.when(~named, F.col("source_row_index")).alias("own_row"), "source_row_index")


_RECORD = ["protein_a", "protein_b", "label"]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = load(spark, sf_dir, "pairs").count()
    return dedup.copies(_records(spark, sf_dir, True), _RECORD, "source_row_index", total)


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = load(spark, sf_dir, "pairs").count()
    return dedup.collapse(_records(spark, sf_dir, False), [*_RECORD, "own_row"], "source_row_index", total).drop("own_row")


# --- p7: a sample that is stable as the data grows ----------------------------------------------------------------------


def p7_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = load(spark, sf_dir, "pairs")
    specs = load(spark, sf_dir, "sampling_specs").filter(F.col("spec_name").isin("growing", "growing_b")).orderBy("spec_name").collect()
    chosen = [(s["spec_name"], s["fraction"], s["seed"]) for s in specs]
    rows = pairs.select("source_row_index", "pair_id", "ingested_at")
    return stable_sample(rows, "pair_id", "source_row_index", "ingested_at", chosen, pairs.count()).select("spec_name", "source_row_index", "pair_id")


# --- p8: encoding of the whole corpus -----------------------------------------------------------------------------------


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_documents(load(spark, sf_dir, "documents"), "doc_id", "text")


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: documents, tokens, and documents whose decoded ids are the text again."""
    documents = load(spark, sf_dir, "documents").withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    encoded = tokenize.encode_documents(documents, "doc_id", "text", carry=["lang", "digest"])
    decoded = tokenize.decode_documents(encoded, "doc_id", carry=["lang", "digest"])
    same = F.md5("text") == F.col("digest")
    return decoded.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("n_tokens"), F.count_if(same).alias("n_same")
    )


# --- p9: mixing sources to target weights -------------------------------------------------------------------------------


def _mixture(spark: SparkSession, sf_dir: str) -> mixture.Mixture:
    documents = load(spark, sf_dir, "documents").withColumn("lang", F.coalesce("lang", F.lit("und")))
    targets = load(spark, sf_dir, "mix_targets").collect()
    shares = {t["source"]: (t["target_share"], t["max_repeats"]) for t in targets}
    digest = documents.filter(F.col("source").isin(list(shares)) & (F.col("text") != "")).withColumn("digest", F.md5("text"))
    counted = tokenize.encode_documents(digest, "doc_id", "text", counts=True, carry=["digest", "source", "lang"])
    return mixture.Mixture(counted, shares, levels=("source", "lang"), seed=9, total_rows=documents.count())


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).selection()


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).report()


# --- p10: keyword-stuffed and link-list pages ---------------------------------------------------------------------------


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_pages(load(spark, sf_dir, "documents"), "doc_id", "text")


def p10_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pairs of neighbouring words, their mean PMI, loose and repeated shares."""
    scores = spam.coherence(load(spark, sf_dir, "documents"), "doc_id", "text")
    rounded = [F.round(c, 6).alias(c) for c in ("mean_pmi", "loose", "repeated")]
    return scores.select(F.col("doc").alias("doc_id"), "n_pairs", *rounded)


# --- checks that SQL can say: what a draw must hold whichever rows it takes ------------------------------------------------


def p3_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample: its rows, distinct ones, rows outside pairs, and categories below their floor that had more rows."""
    drawn = materialize(p3_sample(spark, sf_dir), "sample")
    pairs = load(spark, sf_dir, "pairs")
    strangers = drawn.join(pairs.select("source_row_index"), "source_row_index", "left_anti").agg(F.count(F.lit(1)).alias("n_strangers"))
    floor = load(spark, sf_dir, "sampling_specs").filter("spec_name = 'proportional'").first()["minimum_per_stratum"]
    low = p3_report(spark, sf_dir).filter(F.col("drawn") < F.least(F.lit(floor), "available")).agg(F.count(F.lit(1)).alias("n_below_floor"))
    return drawn.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("source_row_index").alias("n_distinct")).join(strangers).join(low)


def p3_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report without its fractional targets, but whether the drawn rows are within one of them."""
    near = (F.abs(F.col("drawn") - F.col("target")) < 1).alias("is_near")
    return p3_report(spark, sf_dir).select(*_CATEGORY, "target_per_mille", "wanted", "available", "gap", near)


def p3_margin_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per value of either margin: rows there, share wanted, and whether the drawn rows are near it (or all there are)."""
    near = (F.abs(F.col("drawn") - F.col("target")) <= 25).alias("is_near")
    return p3_margins(spark, sf_dir).select("margin", "value", "target_per_mille", "available", near)


def p5_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows placed, groups, groups in more than one split, and splits more than half a per cent of all rows off their share."""
    placed = materialize(p5_splits(spark, sf_dir), "placed")
    per = placed.filter("first_protein_id is not null").groupBy("first_protein_id").agg(F.count_distinct("split").alias("n"))
    groups = per.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("n") > 1).alias("n_torn"))
    shares = _shares(spark, sf_dir)
    total = placed.count()
    sizes = {r[0]: r[1] for r in placed.groupBy("split").count().collect()}
    off = sum(abs(sizes.get(s, 0) - w * total) > 0.005 * total for s, w in shares.items())
    return placed.agg(F.count(F.lit(1)).alias("n_rows")).join(groups).withColumn("n_off", F.lit(off))


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per spec: units of which the sample holds some rows but not all, and whether its share of units is near the fraction."""
    units = load(spark, sf_dir, "pairs").filter("pair_id is not null").groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"))
    n_units = units.count()
    taken = p7_sample(spark, sf_dir).groupBy("spec_name", "pair_id").agg(F.count(F.lit(1)).alias("m")).join(units, "pair_id")
    per = taken.groupBy("spec_name").agg(F.count_if(F.col("m") != F.col("n")).alias("n_partial"), F.count(F.lit(1)).alias("k"))
    specs = load(spark, sf_dir, "sampling_specs").select("spec_name", "fraction")
    return per.join(F.broadcast(specs), "spec_name").select("spec_name", "n_partial", (F.abs(F.col("k") / F.lit(max(n_units, 1)) - F.col("fraction")) < 0.02).alias("is_near"))


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_roundtrip(spark, sf_dir).select("lang", "n_documents", "n_same")


def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target: texts used too often, used texts of the source there, and whether a source below its share used up
    what it may repeat."""
    mix = materialize(p9_mix(spark, sf_dir), "mix")
    documents = load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("own"))
    rows = mix.join(documents, "doc_id").groupBy("source").agg(F.max("copies").alias("most"), F.count_if(~F.col("own").eqNullSafe(F.col("source"))).alias("n_foreign"))
    report = p9_report(spark, sf_dir)
    short = (F.col("missing_tokens") > 0.01 * F.greatest(F.col("used_tokens"), F.lit(1000))) & (F.col("used_tokens") < F.col("available_tokens") * F.col("max_repeats") * 0.98)
    joined = report.join(rows, "source", "left")
    over = (F.coalesce("most", F.lit(0)) > F.col("max_repeats")).cast("int")
    return joined.select("source", "target_share", "max_repeats", over.alias("n_over"), F.coalesce("n_foreign", F.lit(0)).alias("n_foreign"), short.alias("fell_short_needlessly"))


_ALNUM = r"upper(regexp_replace({}, '[^\p{{L}}\p{{Nd}}]+', '', 'g'))"
_P2 = rf"""
with named as (select source_row_index as id, source, {acc_sql("protein_a")} as a, {acc_sql("protein_b")} as b from pairs),
assigned as (select distinct source_row_index as id, nullif(lower(regexp_replace(split, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '') as split from split_assignments),
r as (select id, source, split, least(a, b) as lo, greatest(a, b) as hi from named join assigned using (id)
  where a is not null and b is not null and split is not null),
o as (select t.id as train_id, e.id as eval_id, e.split, e.source from r t join r e on t.lo = e.lo and t.hi = e.hi
  where t.split = 'train' and e.split <> 'train')
"""
_P2_TEXTS = r"""
with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{Nd}]+') as w, substr(md5(cast(doc_id as varchar)), 1, 2) as h
    from documents where doc_id is not null),
s as (select doc_id, case when h < 'cd' then 'train' when h < 'e6' then 'val' else 'test' end as split,
    case when len(w) > 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))
    else [array_to_string(w, ' ')] end as s from d where len(w) > 0),
x as (select doc_id, split, len(s) as n, unnest(s) as g from s),
c as (select a.doc_id, a.split, b.doc_id as train_id, a.n as na, b.n as nb, count(*) as common from x a join x b on a.g = b.g
    where a.split <> 'train' and b.split = 'train' group by all)
select doc_id, split, count(*) as n_links from c where common >= 0.8 * (na + nb - common) group by all
"""
_P5 = rf"""
with recursive shared as (select {acc_sql("protein_id")} as s from shared_proteins),
e as (select source_row_index as id, {acc_sql("protein_a")} as a0, {acc_sql("protein_b")} as b0 from pairs),
r as (select id, case when a0 not in (select s from shared) then a0 end as a, case when b0 not in (select s from shared) then b0 end as b from e),
edges as (select distinct a as u, b as v from r where a <> b union select distinct b, a from r where a <> b),
cc(node, root) using key (node) as (
  select distinct u, u from edges
  union
  select e.v, min(c.root) from cc c join edges e on c.node = e.u join recurring.cc k on k.node = e.v where c.root < k.root group by e.v),
assigned as (select distinct source_row_index as id, nullif(lower(regexp_replace(split, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '') as split from split_assignments)
select coalesce(root, coalesce(a, b)) as first_protein_id
from r join assigned using (id) left join cc on cc.node = coalesce(a, b)
where coalesce(a, b) is not null group by 1 having count(distinct split) >= 2
"""
_P3 = """
with spec as (select * from sampling_specs where spec_name = 'proportional'),
p as (select system_type, label, count(*) as n from pairs group by all),
c as (select t.*, coalesce(n, 0) as available, greatest(floor(max_examples * target_per_mille / 1000.0), minimum_per_stratum)::bigint as wanted
  from sampling_targets t cross join spec left join p on p.system_type = t.system_type and p.label = t.label)
"""
_GROUPS = _P5[: _P5.index("select coalesce(root")]
_COHERENCE = r"""
with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '(?:https?|hxxps?)://\S+|#?\p{L}[\p{L}\p{M}\p{Nd}''_-]*|\p{Nd}[\p{Nd}.,]*') as w from documents),
k as (select doc_id, list_transform(w, lambda x: case when contains(x, '://') then '://' when x[1] between '0' and '9' then '0'
    when length(x) = 8 and length(translate(x, '0123456789', '')) = 3 then '0a' else x end) as w from w where len(w) >= 2),
p as (select doc_id, a, b, count(*) as n from (select doc_id, unnest(w[1 : len(w) - 1]) as a, unnest(w[2 : len(w)]) as b from k) group by all),
c as (select a, b, sum(n) as n_pair from p group by all), t as (select sum(n) as total from p),
l as (select a, sum(n) as n_a from p group by 1), r as (select b, sum(n) as n_b from p group by 1),
s as (select a, b, ln(n_pair * total::double / (n_a::double * n_b)) as pmi from c join l using (a) join r using (b), t)
select doc_id, sum(n)::bigint as n_pairs, round(sum(n * pmi) / sum(n), 6) as mean_pmi, round(sum(case when pmi < 2 then n else 0 end) / sum(n), 6) as loose,
  round(sum(case when n >= 3 and pmi > 0 then n else 0 end) / sum(n), 6) as repeated from p join s using (a, b) group by 1
"""
_P6 = f"""
with c as (select source_row_index, label, {_ALNUM.format("protein_a")} as a, {_ALNUM.format("protein_b")} as b,
    {acc_sql("protein_a")} is not null and {acc_sql("protein_b")} is not null as named from pairs),
k as (select source_row_index, label, case when named then least(a, b) else a end as protein_a,
    case when named then greatest(a, b) else b end as protein_b,
    case when not named then source_row_index end as own_row, named from c)
"""


def queries() -> dict:
    return {
        "p2_found": p2_found, "p2_report": p2_report, "p2_texts": p2_texts, "p3_found": p3_found, "p3_sample": p3_sample, "p3_report": p3_report, "p3_margins": p3_margins,
        "p5_found": p5_found, "p5_splits": p5_splits, "p5_report": p5_report, "p6_found": p6_found, "p6_records": p6_records,
        "p7_sample": p7_sample, "p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip, "p9_mix": p9_mix, "p9_report": p9_report,
        "p10_found": p10_found, "p10_coherence": p10_coherence, "p3_check": p3_check, "p3_gaps": p3_gaps, "p3_margin_check": p3_margin_check,
        "p5_check": p5_check, "p7_check": p7_check, "p8_check": p8_check, "p9_check": p9_check,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2 + "select least(train_id, eval_id) as low_row_index, greatest(train_id, eval_id) as high_row_index from o",
        "p2_report": _P2 + "select split, source, count(distinct eval_id) as n_rows, count(*) as n_pairs from o group by 1, 2",
        "p2_texts": _P2_TEXTS,
        "p3_check": _P3 + """select least(max_examples, (select count(*) from pairs)) as n_rows, least(max_examples, (select count(*) from pairs)) as n_distinct,
            0 as n_strangers, 0 as n_below_floor from spec""",
        "p3_gaps": _P3 + "select system_type, label, target_per_mille, wanted, available, greatest(wanted - available, 0) as gap, true as is_near from c",
        "p3_margin_check": _P3 + """, x as (select * from (select distinct system_type from sampling_targets) cross join (select distinct label from sampling_targets)),
            y as (select x.*, coalesce(n, 0) as n from x left join p on p.system_type = x.system_type and p.label = x.label)
            select 'system_type' as margin, system_type as value, (select sum(target_per_mille) from sampling_targets t where t.system_type = y.system_type) as target_per_mille, sum(n) as available, true as is_near from y group by system_type
            union all select 'label', label::varchar, (select sum(target_per_mille) from sampling_targets t where t.label = y.label), sum(n), true from y group by label""",
        "p5_check": _GROUPS + """select (select count(*) from pairs) as n_rows, count(distinct coalesce(root, coalesce(a, b))) as n_groups, 0 as n_torn, 0 as n_off
            from r left join cc on cc.node = coalesce(a, b) where coalesce(a, b) is not null""",
        "p7_check": "select spec_name, 0 as n_partial, true as is_near from sampling_specs where spec_name in ('growing', 'growing_b')",
        "p8_check": "select lang, count(*) as n_documents, count(*) as n_same from documents group by 1",
        "p9_check": "select source, target_share, max_repeats, 0 as n_over, 0 as n_foreign, false as fell_short_needlessly from mix_targets",
        "p10_coherence": _COHERENCE,
        "p3_found": """
            select t.system_type, t.label from sampling_targets t
            left join (select system_type, label, count(*) as n from pairs group by 1, 2) p on p.system_type = t.system_type and p.label = t.label
            where coalesce(n, 0) < (select greatest(floor(max_examples * t.target_per_mille / 1000.0), minimum_per_stratum)
                from sampling_specs where spec_name = 'proportional')""",
        "p5_found": _P5,
        "p6_found": _P6 + """select first_row_index, source_row_index as copy_row_index from (
            select source_row_index, min(source_row_index) over (partition by protein_a, protein_b, label) as first_row_index from k where named)
            where source_row_index <> first_row_index""",
        "p6_records": _P6 + "select protein_a, protein_b, label, min(source_row_index) as first_row_index, count(*) as n_copies from k group by protein_a, protein_b, label, own_row",
    }

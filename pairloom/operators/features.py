"""K-mer features in long form (row_id, term, value) and their symmetric composition for pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import json_sha256
from ..session import materialize
from .skew import endpoint_lookup


def _even(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")


def kmers(text: Column, k: int = 3) -> Column:
    """Overlapping, case-sensitive character k-mers; runs of whitespace count as one space; null and shorter texts give
    the empty array."""
    s = _even(text)
    return F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - (k - 1)), lambda i: F.substr(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def term_counts(rows: DataFrame, row_id: str, text: str, k: int = 3) -> DataFrame:
    """(row_id, term, tf).

    The texts are spread by row before they are cut, which moves far fewer bytes than their k-mers; the count per row and
    term is local then. The number of partitions is given, as texts look small to the adaptive planner.
    """
    spread = _by_row(rows.select(F.col(row_id).alias("row_id"), _even(F.col(text)).alias("s"))).filter(F.length("s") >= k)
    # one row per place: substrings in generated code, where an array of them would be interpreted
    places = spread.select("row_id", "s", F.explode(F.sequence(F.lit(1), F.length("s") - (k - 1))).alias("i"))
    return places.select("row_id", F.substr("s", F.col("i"), F.lit(k)).alias("term")).groupBy("row_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def _by_row(rows: DataFrame) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row_id")


def term_lists(counts: DataFrame) -> DataFrame:
    """One row per ``row_id`` with ``terms``, an array of (term, tf): a term table in a tenth of its rows.

    Counts of :func:`term_counts` lie together by row already, so this shuffles nothing.
    """
    return counts.groupBy("row_id").agg(F.collect_list(F.struct("term", "tf")).alias("terms"))


def vocabulary(train: DataFrame) -> DataFrame:
    """(term, df) of the training rows of a term table."""
    return train.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


#: Vocabularies of at most this many terms are broadcast; larger ones meet the terms in a shuffle.
BROADCAST_TERMS = 200_000


def _known(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Terms of the vocabulary with its columns; a small vocabulary is broadcast and keeps the rows where they lie."""
    return counts.join(F.broadcast(vocab) if vocab.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else vocab, "term")


def count_features(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    return _known(counts, vocab.select("term")).select("row_id", "term", F.col("tf").cast("double").alias("value"))


def binary_features(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    return _known(counts, vocab.select("term")).select("row_id", "term", F.lit(1.0).alias("value"))


def _lists(known: DataFrame, *columns: str) -> DataFrame:
    return known.groupBy("row_id").agg(F.collect_list(F.struct("term", *columns)).alias("t"))


def _sum(items: Column, of) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + of(x))


def tfidf_features(counts: DataFrame, vocab: DataFrame, n_train: int) -> DataFrame:
    """tf * (ln((1 + n) / (1 + df)) + 1), rows scaled to unit length; terms outside the vocabulary vanish.

    The terms of a row are gathered as one array, whose norm is taken inside the row.
    """
    n = F.lit(n_train)
    weighted = _known(counts, vocab).withColumn("w", F.col("tf") * (F.log((1 + n) / (1 + F.col("df"))) + 1))
    rows = _lists(weighted, "w").withColumn("norm", F.sqrt(_sum(F.col("t"), lambda x: x["w"] * x["w"])))
    return rows.select("row_id", "norm", F.explode("t").alias("x")).select("row_id", "x.term", (F.col("x.w") / F.col("norm")).alias("value"))


def bm25_features(counts: DataFrame, vocab: DataFrame, train_ids: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """idf * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)), idf = ln(1 + (n - df + .5) / (df + .5)).

    Lengths count terms of the vocabulary only; n and avgdl are those of the training rows (``row_id``), rows without
    any k-mer included.
    """
    rows = _lists(_known(counts, vocab), "tf", "df").withColumn("dl", F.aggregate("t", F.lit(0).cast("bigint"), lambda s, x: s + x["tf"]))
    rows = materialize(rows, "vocabulary-terms")
    total = rows.join(train_ids.distinct(), "row_id", "left_semi").agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
    n = train_ids.count()
    avgdl = max(total / n if n else 0.0, 1e-12)
    tf, df = F.col("x.tf"), F.col("x.df")
    idf = F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5))
    value = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
    return rows.select("row_id", "dl", F.explode("t").alias("x")).select("row_id", "x.term", value.alias("value"))


def feature_table(counts: DataFrame, train_ids: DataFrame, kind: str, **options: float) -> DataFrame:
    """Fit on the training rows alone, transform all rows."""
    lists, train_ids = materialize(term_lists(counts), "terms"), materialize(train_ids, "train-ids")
    flat = lambda t: t.select("row_id", F.explode("terms").alias("x")).select("row_id", "x.term", "x.tf")
    vocab = materialize(vocabulary(flat(lists.join(train_ids, "row_id", "left_semi"))), "vocabulary")
    counts = flat(_by_row(lists))  # one row per text moves, and its terms stay together from here on
    if kind == "count":
        return count_features(flat(lists), vocab)
    if kind == "binary":
        return binary_features(flat(lists), vocab)
    if kind == "tfidf":
        return tfidf_features(counts, vocab, train_ids.count())
    if kind == "bm25":
        return bm25_features(counts, vocab, train_ids, **options)
    raise ValueError(f"unknown features {kind!r}")


def stack_features(blocks: dict[str, DataFrame]) -> DataFrame:
    """Several feature tables side by side, in the given order: terms get the name of their block."""
    out = None
    for i, (name, block) in enumerate(blocks.items()):
        part = block.select("row_id", F.lit(i).alias("block"), F.concat(F.lit(f"{name}:"), "term").alias("term"), "value")
        out = part if out is None else out.unionByName(part)
    return out


#: Feature rows are wide; up to this many of them are broadcast.
BROADCAST_FEATURE_ROWS = 5000


def compose_sparse(pairs: DataFrame, features: DataFrame, pair_id: str = "pair_id", a: str = "protein_a", b: str = "protein_b") -> DataFrame:
    """(pair_id, part, term, value) of [x + y, abs(x - y), x * y] for the endpoints' feature rows, without zeros.

    The features of an endpoint are one map, looked up for both sides and merged inside the pair's row, so nothing is
    shuffled by pair and term. A self pair sees its row twice; an endpoint without features counts as zeros.
    """
    rows = materialize(features.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "value"))).alias("m")), "feature-rows")
    ends = pairs.select(F.col(pair_id).alias("pair_id"), F.col(a).alias("a"), F.col(b).alias("b"))
    met = endpoint_lookup(ends, rows, "row_id", ["m"], ("a", "b"), ("_x", "_y"), broadcast_rows=BROADCAST_FEATURE_ROWS)
    none = F.create_map().cast(rows.schema["m"].dataType)
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    merged = F.map_zip_with(F.coalesce("m_x", none), F.coalesce("m_y", none), lambda t, x, y: F.struct(zero(x).alias("x"), zero(y).alias("y")))
    both = met.select("pair_id", F.explode(merged).alias("term", "v")).select("pair_id", "term", "v.x", "v.y")
    x, y = F.col("x"), F.col("y")
    parts = F.array(*(F.struct(F.lit(n).alias("part"), v.alias("value")) for n, v in (("sum", x + y), ("difference", F.abs(x - y)), ("product", x * y))))
    return both.select("pair_id", "term", F.explode(parts).alias("p")).select("pair_id", "p.part", "term", "p.value").filter("value <> 0")


def compose_dense(x: Column, y: Column) -> Column:
    """[x + y, abs(x - y), x * y] of two arrays of equal length; symmetric in its arguments."""
    return F.concat(F.zip_with(x, y, lambda p, q: p + q), F.zip_with(x, y, lambda p, q: F.abs(p - q)), F.zip_with(x, y, lambda p, q: p * q))


def gather(pairs: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Dense rows of both endpoints (``x``, ``y``), missing ones null."""
    found = endpoint_lookup(pairs, table, key, [value], broadcast_rows=BROADCAST_FEATURE_ROWS)
    return found.withColumnsRenamed({f"{value}_a": "x", f"{value}_b": "y"})


def matrix_statistics(features: DataFrame, n_rows: int | Column) -> DataFrame:
    """Rows, columns, stored values, density and bytes (8 for a value, 4 for an index) of a long-form matrix."""
    stats = features.agg(F.count_distinct("term").alias("n_columns"), F.count(F.lit(1)).alias("n_stored"))
    n = n_rows if isinstance(n_rows, Column) else F.lit(n_rows)
    density = F.coalesce(F.try_divide(F.col("n_stored").cast("double"), (n * F.col("n_columns")).cast("double")), F.lit(0.0))
    return stats.select(n.cast("bigint").alias("n_rows"), "n_columns", "n_stored", density.alias("density"), (F.col("n_stored") * 12).alias("n_bytes"))


def feature_identity(kinds: Sequence[str], k: int = 3, k1: float = 1.5, b: float = 0.75) -> dict[str, str]:
    """Name, digest of the specification and the short id name-k{k}-{digest} of configured features."""
    names = list(dict.fromkeys(kinds))
    spec = {"features": names, "k": k} | ({"bm25_k1": k1, "bm25_b": b} if "bm25" in names else {})
    digest = json_sha256(spec)
    return {"features": feature_name(names), "feature_spec_sha256": digest, "feature_identity": f"{feature_name(names)}-k{k}-{digest[:12]}"}


def feature_name(kinds: Sequence[str]) -> str:
    return "+".join(dict.fromkeys(kinds))

"""References to records that do not exist: Bloom filter first, exact check of what passes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import discard, materialize, materialize_in_turn

#: A filter up to this size (2**27 bits are 16 MB) is broadcast; a larger one is cut by the hash of the key into slices of
#: that size, which are broadcast one after the other. Either way a key has 16 bits, so what passes stays rare.
BROADCAST_BITS = 2**27
BITS_PER_KEY = 16
_CHUNK = 1024


def _word(key: Column, n_words: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(n_words - 1))


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(1))
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    return one(0).bitwiseOR(one(1)).bitwiseOR(one(2)).bitwiseOR(one(3))


class BloomFilter:
    """Register-blocked Bloom filter kept as a table of word arrays, probed by a join with it.

    A key sets four bits of one 64-bit word; words are or-ed with map-side combine, so building costs one small shuffle.
    The size follows the number of parents without a bound; with four bits a key in at least 16, less than 0.4 % of the
    keys without a parent pass (about 0.24 % if the keys fill the words evenly).
    """

    def __init__(self, parents: DataFrame, key: str, n_parents: int, broadcast_bits: int = BROADCAST_BITS):
        wanted = max(BITS_PER_KEY * n_parents, 64 * _CHUNK)
        self.n_words = 1 << ((wanted // 64) - 1).bit_length()
        self.small = self.n_words * 64 <= broadcast_bits
        self._slice_bits = max(0, (broadcast_bits // (64 * _CHUNK)).bit_length() - 1)  # a slice has 2 ** _slice_bits chunks
        self.n_slices = 1 if self.small else max(1, self.n_words // _CHUNK >> self._slice_bits)
        spark = parents.sparkSession
        words = (
            parents.filter(F.col(key).isNotNull())
            .select(_word(F.col(key), self.n_words).alias("word"), _mask(F.col(key)).alias("mask"))
            .unionByName(spark.range(self.n_words).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("mask")))
            .groupBy("word")
            .agg(F.bit_or("mask").alias("mask"))
        )
        self.table = (
            words.groupBy(F.shiftright("word", 10).alias("__chunk"))
            .agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("w"))
            .select("__chunk", F.transform("w", lambda x: x["mask"]).alias("__words"))
        )
        if not self.small:
            self.table = materialize(self._sliced(self.table), "filter", by="__slice")

    def _sliced(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("__slice", F.shiftright("__chunk", self._slice_bits).cast("int"))

    def probe(self, rows: DataFrame, key: str, flag: str) -> DataFrame:
        """``rows`` with ``flag``: false proves that the key has no parent. A null key is false.

        The rows of a large filter are written by slice and meet one broadcast slice at a time. They are never shuffled,
        so no word is repeated for a row, and it doesn't matter how many rows a key has.
        """
        chunk = F.coalesce(F.shiftright(_word(F.col(key), self.n_words), 10), F.lit(0))
        mask = _mask(F.col(key))
        held = F.get("__words", _word(F.col(key), self.n_words).bitwiseAND(F.lit(_CHUNK - 1)).cast("int"))
        hit = F.col(key).isNotNull() & (held.bitwiseAND(mask) == mask)
        meet = lambda part, table: part.join(F.broadcast(table), "__chunk").select(*rows.columns, hit.alias(flag))
        refs = rows.withColumn("__chunk", chunk)
        if self.small:
            return meet(refs, self.table)
        refs = materialize(self._sliced(refs), "filter-refs", by="__slice")
        of = lambda table, i: table.filter(F.col("__slice") == i).drop("__slice")
        out = materialize_in_turn((meet(of(refs, i), of(self.table, i)) for i in range(self.n_slices)), "filtered-refs")
        discard(refs)
        return out

    def discard(self) -> None:
        """Delete what a large filter keeps on disk, once nothing probes it any more."""
        discard(self.table)


def orphan_keys(refs: DataFrame, parents: DataFrame, key: str, n_parents: int) -> DataFrame:
    """Rows of ``refs`` whose non-null ``key`` is no ``key`` of ``parents`` (a null refers to nothing).

    References the filter rejects are orphans for certain; only the others go to the exact anti-join.
    """
    bloom = BloomFilter(parents, key, n_parents)
    probed = bloom.probe(refs.filter(F.col(key).isNotNull()), key, "__maybe")
    bloom.discard()
    sure = probed.filter(~F.col("__maybe")).drop("__maybe")
    maybe = probed.filter("__maybe").drop("__maybe")
    return sure.unionByName(maybe.join(parents.select(key).distinct(), key, "left_anti").select(*sure.columns))


def temporal_orphans(
    refs: DataFrame,
    parents: DataFrame,
    key: str,
    at: str,
    start: str,
    end: str,
    n_parents: int,
    n_refs: int,
    split_above: int = 200_000,
) -> DataFrame:
    """Rows of ``refs`` for which no parent of the same ``key`` lives at the time ``at``.

    A parent lives from ``start`` on and, unless ``end`` is null, until before ``end``. A reference without a time has
    no living parent; a reference without a key is none. Parents without ``start``, or that end before they start,
    never live.

    Exact check: the number of living parents is a running sum of +1 at each start and -1 at each end. It is taken per
    key and month of the reference, the sum of all earlier months being carried in, so neither a key with very many
    references nor one with very many parents meets in one group. A (key, month) of more references than
    ``max(split_above, n_refs / 2000)`` is taken second by second instead, and a second with as many references is split
    by hash; only the deltas of that one second, at most one for each microsecond, are repeated for each part.
    """
    live = parents.filter(
        F.col(key).isNotNull() & F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start)))
    )
    bloom = BloomFilter(live, key, n_parents)
    probed = bloom.probe(refs.filter(F.col(key).isNotNull()), key, "__maybe")
    if bloom.small:  # else they are written already
        probed = materialize(probed, "orphan-refs")
    bloom.discard()
    may_live = F.col("__maybe") & F.col(at).isNotNull()
    sure = probed.filter(~may_live).drop("__maybe")
    maybe = probed.filter(may_live).drop("__maybe")

    instant = lambda c: F.col(c).cast("timestamp_ntz")
    trunc = lambda unit: F.date_trunc(unit, "__t").cast("timestamp_ntz")
    deltas = (
        live.select(key, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("x"))
        .select(key, instant("x.t").alias("__t"), F.col("x.d").cast("bigint").alias("__d"))
        .filter(F.col("__t").isNotNull())
        .groupBy(key, "__t")
        .agg(F.sum("__d").alias("__d"))
        .withColumn("__span", trunc("month"))
    )
    maybe = maybe.withColumn("__t", instant(at)).withColumn("__span", trunc("month"))
    limit = max(split_above, n_refs // 2000)
    if n_refs > limit:
        # at most n_refs / limit (<= 2000) entries, as are the parts below
        busy = maybe.groupBy(key, "__span").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).select(key, "__span", F.lit(True).alias("__busy"))
        busy = F.broadcast(materialize(busy, "busy-months"))
        finer = F.when(F.col("__busy"), trunc("second")).otherwise(F.col("__span"))
        maybe = maybe.join(busy, [key, "__span"], "left").withColumn("__span", finer).drop("__busy")
        deltas = deltas.join(busy, [key, "__span"], "left").withColumn("__span", finer).drop("__busy")
    spans = (
        maybe.select(key, "__span", F.lit(1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("__d"))
        .unionByName(deltas.select(key, "__span", F.lit(0).cast("bigint").alias("n"), "__d"))
        .groupBy(key, "__span")
        .agg(F.sum("n").alias("n"), F.sum("__d").alias("__d"))
        .withColumn("carry", F.sum("__d").over(W.partitionBy(key).orderBy("__span").rowsBetween(W.unboundedPreceding, -1)))
        .filter("n > 0")
    )
    carried = spans.select(key, "__span", F.col("__span").alias("__t"), F.coalesce("carry", F.lit(0)).alias("__d"))
    extra = [c for c in sure.columns if c != key]
    blank = [F.lit(None).cast(dict(sure.dtypes)[c]).alias(c) for c in extra]
    steps = carried.select(key, "__span", "__t", F.lit(0).alias("__kind"), "__d", *blank).unionByName(
        deltas.select(key, "__span", "__t", F.lit(1).alias("__kind"), "__d", *blank)
    )
    asked = maybe.select(key, "__span", "__t", F.lit(2).alias("__kind"), F.lit(0).cast("bigint").alias("__d"), *extra)
    part = [key, "__span"]
    if n_refs > limit:
        parts = F.broadcast(spans.filter(F.col("n") > limit).select(key, "__span", F.ceil(F.col("n") / limit).cast("int").alias("__parts")))
        asked = asked.join(parts, part, "left").withColumn(
            "__part", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*extra), F.col("__parts")).cast("int"))
        )
        steps = steps.join(parts, part, "left").withColumn(
            "__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
        )
        part = [*part, "__part"]
    running = W.partitionBy(*part).orderBy("__t", "__kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    checked = steps.unionByName(asked).withColumn("__alive", F.sum("__d").over(running))
    return sure.unionByName(checked.filter("__kind = 2 and __alive <= 0").select(*sure.columns))

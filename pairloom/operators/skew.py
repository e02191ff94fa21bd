"""Hot keys: exact and sketched detection, lookups that stay balanced, per-key counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import discard, materialize

#: A key is hot above this share of all rows, or above the fair share of a shuffle partition where there are more
#: partitions than that, but no finer than FINEST_SHARE; so a list of hot keys has at most 1 / FINEST_SHARE entries ...
HOT_SHARE = 1 / 2000
FINEST_SHARE = 1 / 20_000
#: ... and never below this many rows, so tiny tables have none.
HOT_FLOOR = 1000


def hot_limit(rows: DataFrame, total: int, share: float = HOT_SHARE, floor: int = HOT_FLOOR) -> float:
    """Rows above which a key is hot in a table of at most ``total`` rows."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, min(share, max(1 / partitions, FINEST_SHARE)) * total)


def hot_keys(rows: DataFrame, key: Column | str, total: int, share: float = HOT_SHARE, floor: int = HOT_FLOOR) -> list:
    """Keys held by more than :func:`hot_limit` rows, found exactly from map-side partial counts.

    ``total`` is an upper bound for the rows of ``rows``; the length of the list is bounded by construction.
    """
    limit = hot_limit(rows, total, share, floor)
    if total <= limit:
        return []
    key = F.col(key) if isinstance(key, str) else key
    counts = rows.groupBy(key.alias("hot_key")).agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in counts.filter((F.col("n") > limit) & F.col("hot_key").isNotNull()).select("hot_key").collect()]


def is_hot(key: Column, hot: list) -> Column:
    """Membership in a bounded list of hot keys (a hash set in generated code)."""
    return F.coalesce(key.isin(hot), F.lit(False)) if hot else F.lit(False)


def lookup(rows: DataFrame, table: DataFrame, key: str, values: Sequence[str], hot: list) -> DataFrame:
    """Left join of ``rows`` with ``table`` (one row per ``key``) on ``key`` that no hot key can unbalance.

    Rows with a hot key get their values from a broadcast of the bounded hot part of ``table`` and are then spread over
    all reducers; the others meet ``table`` in an ordinary shuffle join. Both in one pass over ``rows``.
    """
    table = table.select(key, *values)
    if not hot:
        return rows.join(table, key, "left")
    mine = {v: f"__hot_{v}" for v in values}
    hot_part = table.filter(is_hot(F.col(key), hot)).select(key, *(F.col(v).alias(mine[v]) for v in values))
    salted = rows.join(F.broadcast(hot_part), key, "left").withColumn(
        "__salt", F.when(is_hot(F.col(key), hot), 1 + F.spark_partition_id()).otherwise(0)
    )
    joined = salted.join(table.withColumn("__salt", F.lit(0)), [key, "__salt"], "left")
    return joined.select(*rows.columns, *(F.coalesce(v, mine[v]).alias(v) for v in values))


#: Tables of at most this many rows are broadcast whole by :func:`endpoint_lookup`.
BROADCAST_ROWS = 200_000


def endpoint_lookup(
    rows: DataFrame, table: DataFrame, key: str, values: Sequence[str], sides: Sequence[str] = ("protein_a", "protein_b"),
    suffixes: Sequence[str] = ("_a", "_b"), broadcast_rows: int = BROADCAST_ROWS, share: float = HOT_SHARE, floor: int = HOT_FLOOR,
) -> DataFrame:
    """``rows`` with ``<value><suffix>`` for each side, looked up in ``table`` (one row per ``key``); null where there is
    none. A table of up to ``broadcast_rows`` rows is broadcast; for a larger one, hot keys meet a broadcast of their part
    and the others a shuffle join, so no hub unbalances it."""
    table = table.select(key, *values)
    small = table.limit(broadcast_rows + 1).count() <= broadcast_rows
    hot: list = []
    if not small:
        rows = materialize(rows, "endpoints")
        ends = rows.select(F.explode(F.array(*sides)).alias(key))
        hot = hot_keys(ends, key, len(sides) * rows.count(), share, floor)
    out = rows
    for side, suffix in zip(sides, suffixes, strict=True):
        mine = f"__{side}"
        right = table.select(F.col(key).alias(mine), *(F.col(v).alias(f"{v}{suffix}") for v in values))
        if small:
            out = out.join(F.broadcast(right), F.col(side) == F.col(mine), "left").drop(mine)
        else:
            out = lookup(out.withColumn(mine, F.col(side)), right, mine, [f"{v}{suffix}" for v in values], hot).drop(mine)
    return out


def sketch_heavy_hitters(rows: DataFrame, key: str, total: int, share: float = HOT_SHARE, floor: int = HOT_FLOOR) -> list:
    """Candidate heavy keys from a frequent-items sketch, a superset of the keys above ``max(floor, share * total)``.

    The sketch of 2**15 items takes some 2 MB a task (4 MB with text keys) whatever the number of rows.

    The sketch tracks 2**15 items, so an estimate is off by at most about 0.02 % of the rows; keys are kept from half
    the limit on. At most ``2 / share`` keys come back.
    """
    limit = max(floor, share * total) / 2
    if total <= limit:
        return []
    items = min(10_000, int(2 / share) + 1)
    top = rows.filter(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k({key}, {items}, {2**15})").alias("top"))
    found = top.select(F.explode("top").alias("t")).filter(F.col("t.count") >= limit).select("t.item")
    return [r[0] for r in found.collect()]


def per_key_counts(rows: DataFrame, key: str, partner: str, positive: Column, heavy: list) -> DataFrame:
    """Per key: rows, positive rows and distinct partners, with the work of heavy keys spread.

    ``rows`` has one row per (record, key). Heavy keys are picked out by a broadcast and aggregated in two levels,
    first per (key, partner), so that a heavy key is shared by all tasks; the rest takes one ordinary shuffle by key,
    after which both levels are local. A null partner is counted in the rows but is no partner; a null key is no key.
    """
    spark = rows.sparkSession
    rows = rows.filter(F.col(key).isNotNull())
    flagged = rows.select(F.col(key), F.col(partner), positive.cast("bigint").alias("pos"))

    def two_levels(part: DataFrame) -> DataFrame:
        inner = part.groupBy(key, partner).agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("p"))
        return inner.groupBy(key).agg(
            F.sum("n").alias("n_rows"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_positive"), F.count(partner).alias("n_partners")
        )

    if not heavy:
        return two_levels(flagged.repartition(F.col(key)))
    keys = F.broadcast(spark.createDataFrame([(k,) for k in heavy], f"{key} {dict(rows.dtypes)[key]}"))
    hot = two_levels(flagged.join(keys, key, "left_semi"))
    rest = two_levels(flagged.join(keys, key, "left_anti").repartition(F.col(key)))
    return hot.unionByName(rest)


def key_hash(*keys: str) -> Column:
    """64-bit hash of a key for the detection of hot keys: a collision can only make a key look hotter."""
    return F.xxhash64(*keys)


def with_group_min(rows: DataFrame, keys: Sequence[str], value: str, out: str, hot: list, size: str | None = None) -> DataFrame:
    """``rows`` with ``out``, the least ``value`` among the rows of equal ``keys`` (null equals null), and ``size``, if
    named, the number of those rows.

    ``hot`` holds key hashes. Ordinary keys take one shuffle and a window; rows of hot keys are reduced in two salted
    levels to one row per key, which is broadcast, so they are never gathered.
    """

    def windowed(part: DataFrame) -> DataFrame:
        over = W.partitionBy(*keys)
        part = part.withColumn(out, F.min(value).over(over))
        return part.withColumn(size, F.count(F.lit(1)).over(over)) if size else part

    if not hot:
        return windowed(rows)
    flag = is_hot(key_hash(*keys), hot)
    hot_rows = rows.filter(flag)
    first = hot_rows.groupBy(*keys, F.spark_partition_id().alias("__salt")).agg(F.min(value).alias(out), F.count(F.lit(1)).alias("__n"))
    least = first.groupBy(*keys).agg(F.min(out).alias(out), F.sum("__n").alias("__n"))
    least = least.select(*(F.col(k).alias(f"__{k}") for k in keys), out, *([F.col("__n").alias(size)] if size else []))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return windowed(rows.filter(~flag)).unionByName(hot_rows.join(F.broadcast(least), same).select(*rows.columns, out, *([size] if size else [])))


def balanced_join(rows: DataFrame, table: DataFrame, key: str, hot: list) -> DataFrame:
    """Inner join on ``key``; rows of the bounded list of hot keys meet a broadcast of their part of ``table``."""
    if not hot:
        return rows.join(table, key)
    mine, theirs = is_hot(F.col(key), hot), is_hot(F.col(key), hot)
    heavy = rows.filter(mine).join(F.broadcast(table.filter(theirs)), key)
    return heavy.unionByName(rows.filter(~mine).join(table.filter(~theirs), key))


#: Rows of each side that meet in one cell of :func:`grid_join`.
CELL_ROWS = 1000


def grid_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: Column, right_id: Column, cell: int = CELL_ROWS, most_right: int | None = None
) -> DataFrame:
    """Inner join on ``keys`` that stays balanced however many rows a key has on either side, or on both.

    Keys are counted on both sides first. The rows of a key with more than ``cell ** 2`` joined pairs are cut by a hash
    of their ids into parts of about ``cell`` rows, and every part of one side meets every part of the other in a cell of
    its own, so a task never holds more than some thousand rows of one cell. Repeating a row costs a ``cell``-th of the
    pairs it takes part in. Where no key of ``right`` is known to have more than ``most_right`` rows, and no key of
    ``left`` has enough to matter, the right side is not counted.
    """
    key = F.xxhash64(*keys)
    of_left = left.groupBy(key.alias("__k")).agg(F.count(F.lit(1)).alias("__nl"))
    if most_right is not None and (of_left.agg(F.max("__nl")).first()[0] or 0) * most_right <= cell * cell:
        return left.join(right, list(keys))
    sizes = (
        of_left.join(right.groupBy(key.alias("__k")).agg(F.count(F.lit(1)).alias("__nr")), "__k")
        .filter(F.col("__nl") * F.col("__nr") > cell * cell)
    )
    parts = lambda n: F.ceil(F.col(n) / cell).cast("bigint")
    big = sizes.select("__k", "__nl", "__nr", parts("__nl").alias("__pl"), parts("__nr").alias("__pr"))
    big = materialize(big, "grid")
    n_big, rows_left, rows_right = big.agg(F.count(F.lit(1)), F.sum("__nl"), F.sum("__nr")).first()
    if not n_big:
        discard(big)
        return left.join(right, list(keys))
    limit = max(hot_limit(left, rows_left), cell), max(hot_limit(right, rows_right), cell)
    hot_of = lambda n, most: [r[0] for r in big.filter(F.col(n) > most).select("__k").collect()]
    step = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(n, F.lit(1)) - 1))
    own = lambda ident, n: F.pmod(F.xxhash64(ident), F.coalesce(n, F.lit(1)))
    a = lookup(left.withColumn("__k", key), big, "__k", ["__pl", "__pr"], hot_of("__nl", limit[0]))
    a = a.select(*left.columns, own(left_id, F.col("__pl")).alias("__i"), step(F.col("__pr")).alias("__j"))
    b = lookup(right.withColumn("__k", key), big, "__k", ["__pl", "__pr"], hot_of("__nr", limit[1]))
    b = b.select(*right.columns, own(right_id, F.col("__pr")).alias("__j"), step(F.col("__pl")).alias("__i"))
    return a.join(b, [*keys, "__i", "__j"]).drop("__i", "__j")

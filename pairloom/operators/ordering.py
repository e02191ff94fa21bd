"""Order-dependent columns without a single-task window: dense numbers and running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize


def dense_index(rows: DataFrame, order: Sequence[Column | str], out: str, start: int = 0) -> DataFrame:
    """``rows`` with ``out`` = start, start + 1, ... in the total order ``order``.

    Range partitions are sorted apart and numbered from the sizes of those before them; only these sizes, one per
    partition, reach the driver.
    """
    spark = rows.sparkSession
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    placed = materialize(parts, "numbered")
    part = F.shiftright("__m", 33)
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().collect())
    offsets, seen = [], start
    for p, n in sizes:
        offsets.append((p, seen))
        seen += n
    table = F.broadcast(spark.createDataFrame(offsets, "__p bigint, __before bigint"))
    joined = placed.withColumn("__p", part).join(table, "__p")
    return joined.select(*rows.columns, (F.col("__before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).alias(out))


#: Rows that one task orders in :func:`running_sums`.
ROWS_PER_SLICE = 200_000
#: Sorted by the driver's side of a top-k up to this many rows; more are ranked in range partitions.
TOP_ROWS = 50_000


def first_rows(rows: DataFrame, order: Sequence[Column | str], n: int, top: int = TOP_ROWS) -> DataFrame:
    """The first ``n`` rows in the total order ``order``: a top-k where ``n`` is small, else by their dense number, so a
    large sample is never gathered in one task."""
    if n <= top:
        return rows.orderBy(*order).limit(n)
    return dense_index(rows, order, "__place").filter(F.col("__place") < n).drop("__place")


def running_sums(
    rows: DataFrame, keys: Sequence[str], by: str, sums: dict[str, str], descending: bool = True, slices: int | None = None, ties: Sequence[str] = ()
) -> DataFrame:
    """``rows`` with, per ``keys``, the sums of columns over all rows up to the own one in the order of the number
    ``by`` and, where it is equal, of the columns ``ties``; together they must be distinct per key.

    The range of ``by`` is cut at approximate quantiles, by default into slices of about ROWS_PER_SLICE rows; a slice
    starts from the total of the slices before it, so one key never needs a single sorted task. Empty tables and
    single-valued ``by`` are one slice.
    """
    rows = materialize(rows, "ordered")  # read four times below
    slices = slices or min(10_000, 1 + rows.count() // ROWS_PER_SLICE)
    cuts = []
    if slices > 1:
        cuts = rows.agg(F.percentile_approx(F.col(by).cast("double"), [i / slices for i in range(1, slices)], max(1000, 10 * slices))).first()[0] or []
    bounds = [-float("inf"), *sorted({c for c in cuts if c is not None and c == c}), float("inf")]
    rows = rows.withColumn("__by", F.col(by).cast("double"))
    if len(bounds) > 2:
        sliced = Bucketizer(splits=bounds, inputCol="__by", outputCol="__slice", handleInvalid="keep").transform(rows)
    else:
        sliced = rows.withColumn("__slice", F.lit(0.0))
    sign = F.lit(-1 if descending else 1)
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in (by, *ties)]
    totals = sliced.groupBy(*keys, "__slice").agg(*(F.sum(c).alias(f"__t_{o}") for o, c in sums.items()))
    before = W.partitionBy(*keys).orderBy(sign * F.col("__slice")).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*keys, "__slice", *(F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__b_{o}") for o in sums))
    inside = W.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = sliced.select("*", *(F.sum(c).over(inside).alias(f"__l_{o}") for o, c in sums.items()))
    same = F.lit(True)
    right = totals.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__slice").alias("__s"), *(f"__b_{o}" for o in sums))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = local.join(right, same & (F.col("__slice") == F.col("__s")))
    columns = [c for c in rows.columns if c != "__by"]
    return joined.select(*columns, *((F.col(f"__b_{o}") + F.col(f"__l_{o}")).alias(o) for o in sums))


def hash_order(seed: int, *keys: Column | str) -> Column:
    """Deterministic pseudo-random order: md5 of seed and keys as hex text, the same on any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *keys))

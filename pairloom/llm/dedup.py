"""Duplicates hidden by formatting: one row per record with its number of copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import HOT_FLOOR, HOT_SHARE, hot_keys, is_hot, key_hash, with_group_min

_SALTS = 64


def _hot(rows: DataFrame, keys: Sequence[str], total: int, share: float, floor: int) -> list:
    return hot_keys(rows, key_hash(*keys), total, share, floor)


def collapse(rows: DataFrame, keys: Sequence[str], identifier: str, total: int, share: float = HOT_SHARE, floor: int = HOT_FLOOR) -> DataFrame:
    """One row per canonical key (null equals null): ``keys``, ``first_row_index``, ``n_copies``.

    Keys above ``max(floor, share * total)`` rows, at most ``1 / share`` of them, are found exactly from partial counts
    and aggregated in two levels, over (key, salt) and then key; all others take one shuffle. The representative is the
    row of the least ``identifier``. An empty table gives no rows; columns other than those named are ignored.
    """
    rows = rows.select(*keys, identifier)
    measures = [F.min(identifier).alias("first_row_index"), F.count(F.lit(1)).alias("n_copies")]
    hot = _hot(rows, keys, total, share, floor)
    flag = is_hot(key_hash(*keys), hot)
    rest = rows.filter(~flag).groupBy(*keys).agg(*measures)
    if not hot:
        return rest
    salted = rows.filter(flag).groupBy(*keys, F.pmod(F.xxhash64(identifier), F.lit(_SALTS)).alias("__salt")).agg(*measures)
    heavy = salted.groupBy(*keys).agg(F.min("first_row_index").alias("first_row_index"), F.sum("n_copies").alias("n_copies"))
    return rest.unionByName(heavy)


def copies(rows: DataFrame, keys: Sequence[str], identifier: str, total: int, share: float = HOT_SHARE, floor: int = HOT_FLOOR) -> DataFrame:
    """(``first_row_index``, ``copy_row_index``) for each row but the first of its canonical key, balanced as above."""
    rows = rows.select(*keys, identifier)
    hot = _hot(rows, keys, total, share, floor)
    found = with_group_min(rows, keys, identifier, "first_row_index", hot)
    return found.filter(F.col(identifier) != F.col("first_row_index")).select("first_row_index", F.col(identifier).alias("copy_row_index"))

"""A reproducible sample that only grows with the data: randomised block selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import HOT_FLOOR, HOT_SHARE, hot_keys, key_hash, with_group_min

#: Sequence numbers per block; a power of two, as the permutation below works on its bits.
BLOCK_BITS = 10
#: Identifiers have at most 19 digits.
_TEN_19 = "10000000000000000000"


def chosen(sequence: Column, fraction: float, seed: int) -> Column:
    """Whether the position ``sequence`` is chosen: a function of the seed and the position alone.

    A hash of the block number keys a permutation of the positions of the block; the first ``fraction`` of the permuted
    positions are chosen, filled or not. A fractional position is granted to a block by another hash of its number.
    """
    size = 1 << BLOCK_BITS
    low = F.lit(size - 1)
    block = F.shiftright(sequence, BLOCK_BITS)
    x = sequence.bitwiseAND(low)
    for turn in range(3):
        h = F.xxhash64(F.lit(seed), block, F.lit(turn))
        x = (x * h.bitwiseAND(low).bitwiseOR(F.lit(1)) + F.shiftright(h, 20).bitwiseAND(low)).bitwiseAND(low)
        x = x.bitwiseXOR(F.shiftright(x, BLOCK_BITS // 2))
    wanted = fraction * size
    whole = int(wanted)
    grant = F.xxhash64(F.lit(seed), block, F.lit(3)).bitwiseAND(F.lit(2**32 - 1)) < F.lit(int((wanted - whole) * 2**32))
    return x < F.lit(whole) + grant.cast("int")


def stable_sample(
    rows: DataFrame,
    unit: str,
    identifier: str,
    arrived: str,
    specs: list[tuple[str, float, int]],
    total: int,
    share: float = HOT_SHARE,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """``rows`` with ``spec_name``, once for each (name, fraction, seed) of ``specs`` that takes their ``unit``.

    The persistent sequence number of a unit is the ``identifier`` (a non-negative bigint) of its first row by
    ``arrived`` and identifier; rows that arrive later never change it. A null ``arrived`` counts as the earliest, a
    null identifier as 0, and rows without a unit have no number and are in no sample. Other columns come along, except
    one that is itself called ``spec_name``.
    """
    rows = rows.filter(F.col(unit).isNotNull()).drop("spec_name")
    micros = F.coalesce(F.unix_micros(F.col(arrived).cast("timestamp")), F.lit(-(10**17)))
    first = micros.cast("decimal(19,0)") * F.lit(_TEN_19).cast("decimal(20,0)") + F.coalesce(F.col(identifier), F.lit(0)).cast("decimal(19,0)")
    hot = hot_keys(rows, key_hash(unit), total, share, floor)
    keyed = with_group_min(rows.withColumn("__first", first.cast("decimal(38,0)")), [unit], "__first", "__least", hot)
    sequence = F.pmod(F.col("__least"), F.lit(_TEN_19).cast("decimal(38,0)")).cast("bigint")
    keyed = keyed.withColumn("__sequence", sequence)
    takes = F.array(*(F.when(chosen(F.col("__sequence"), fraction, seed), F.lit(name)) for name, fraction, seed in specs))
    return keyed.select(*rows.columns, F.explode(F.array_compact(takes)).alias("spec_name"))

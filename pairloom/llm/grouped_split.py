"""Splits that keep related records together: grouped iterative stratification."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.ordering import dense_index
from ..operators.skew import HOT_FLOOR, HOT_SHARE, hot_keys, lookup
from ..session import materialize

#: Groups of more than 1 / LARGE_SHARE of all rows are classes of their own.
LARGE_SHARE = 2000
#: Classes of groups with like label vectors are collected; they get coarser until there are no more than this many.
MOST_CLASSES = 100_000


@dataclass
class Unit:
    """``times`` groups of the same label counts (or of so many on average)."""

    name: str
    labels: tuple[float, ...]
    times: int = 1


def _fill(need: list[float], weight: float, times: int, then: list[float]) -> list[int]:
    """How many of ``times`` units of ``weight`` each place gets, if every unit goes where most is needed: the needs
    are levelled from the top, what rounding leaves goes to the largest fractions, ties by ``then`` and position."""
    order = sorted(range(len(need)), key=lambda i: -need[i])
    level, total = 0.0, 0.0
    for k, i in enumerate(order, 1):
        total += need[i]
        level = (total - weight * times) / k
        if k == len(order) or level >= need[order[k]]:
            break
    exact = [max(0.0, need[i] - level) / weight for i in range(len(need))]
    out = [int(x + 1e-9) for x in exact]
    for i in sorted(range(len(need)), key=lambda i: (-(exact[i] - out[i]), -need[i], -then[i], i))[: times - sum(out)]:
        out[i] += 1
    return out


def place(units: list[Unit], shares: dict[str, float]) -> dict[str, dict[str, int]]:
    """Iterative stratification over whole groups: the rarest outstanding label first, the groups with most of it first,
    each into the split that needs most of that label, then most rows; ties by the order of ``shares``. For each unit,
    how many of its groups each split gets."""
    if not units:
        return {}
    width = len(units[0].labels)
    totals = [sum(u.labels[i] * u.times for u in units) for i in range(width)]
    splits = list(shares)
    need = {s: [shares[s] * t for t in totals] for s in splits}
    waiting = {u.name: u for u in units}
    out: dict[str, dict[str, int]] = {}
    while waiting:
        outstanding = [sum(u.labels[i] * u.times for u in waiting.values()) for i in range(width)]
        labels = [i for i in range(width) if outstanding[i] > 1e-9]
        rarest = min(labels, key=lambda i: outstanding[i]) if labels else None
        holders = [u for u in waiting.values() if rarest is None or u.labels[rarest] > 0]
        holders.sort(key=lambda u: (-(u.labels[rarest] if rarest is not None else 0), -sum(u.labels), u.name))
        for unit in holders:
            rows = [sum(need[s]) for s in splits]
            of_label = rows if rarest is None else [need[s][rarest] for s in splits]
            given = _fill(of_label, unit.labels[rarest] if rarest is not None else 1.0, unit.times, rows)
            out[unit.name] = dict(zip(splits, given, strict=True))
            for s, n in out[unit.name].items():
                need[s] = [a - b * n for a, b in zip(need[s], unit.labels, strict=True)]
            del waiting[unit.name]
    return out


def refine(units: list[Unit], given: dict[str, dict[str, int]], shares: dict[str, float], steps: int = 2000) -> dict[str, dict[str, int]]:
    """``given`` with groups moved between splits as long as that brings label counts and rows nearer to ``shares``.

    The greedy placement looks at one label at a time and has nothing left to even out the rows with; each step here
    makes the move of like groups from one split to another that lowers the squared gaps (of every label and of all
    rows, each in proportion to its total) the most.
    """
    if not units or len(shares) < 2:
        return given
    splits = list(shares)
    v = np.array([[*u.labels, sum(u.labels)] for u in units], float)
    have = np.array([[given[u.name][s] for s in splits] for u in units], np.int64)
    totals = (v * np.array([[u.times] for u in units])).sum(0)
    weight = 1 / np.maximum(totals, 1)
    need = np.array([shares[s] for s in splits])[:, None] * totals - have.T @ v
    bend = 2 * (v * v) @ weight
    for _ in range(steps):
        best = None
        for s in range(len(splits)):
            for t in range(len(splits)):
                if s != t:
                    slope = 2 * (v @ ((need[s] - need[t]) * weight))
                    times = np.clip(np.rint(-slope / np.maximum(2 * bend, 1e-300)), 1, np.maximum(have[:, s], 1))
                    change = np.where(have[:, s] > 0, slope * times + bend * times * times, np.inf)
                    i = int(np.argmin(change))
                    if change[i] < -1e-9 and (best is None or change[i] < best[0]):
                        best = change[i], i, s, t, int(times[i])
        if best is None:
            break
        _, i, s, t, n = best
        have[i, s] -= n
        have[i, t] += n
        need[s] += n * v[i]
        need[t] -= n * v[i]
    return {u.name: dict(zip(splits, map(int, row), strict=True)) for u, row in zip(units, have, strict=True)}


def _binned(count: Column, bits: int) -> Column:
    """``count`` without its digits below the leading ``bits`` + 1 binary ones; small counts are kept as they are."""
    digits = F.floor(F.log2(F.greatest(count, F.lit(1)).cast("double"))).cast("int")
    step = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(digits - bits, F.lit(0)))
    return count - count % step


class GroupedSplit:
    """Groups of ``rows`` (``row_id``, nullable bigint entities ``a`` and ``b``, ``label``) that share an entity.

    Entities that tie no records together must already be null. A row without entities is a group of its own. Labels
    are counted by the values of ``labels``, any other value (and null) in one more class. Other columns are ignored, so
    their names may be any. An empty table has no groups.
    """

    def __init__(self, rows: DataFrame, total: int, labels: tuple = (0, 1), share: float = HOT_SHARE, floor: int = HOT_FLOOR):
        self.total, self.labels, self.share, self.floor = total, labels, share, floor
        rows = rows.select("row_id", "a", "b", "label")
        self.rows = rows.withColumn("node", F.coalesce("a", "b"))
        roots = connected_components(rows.select(F.col("a").alias("u"), F.col("b").alias("v")), share, floor)
        self.roots = materialize(roots, "roots")

    def root_of(self, nodes: DataFrame) -> DataFrame:
        """``nodes`` (one row per ``node``) with ``root``; a node without edges is its own."""
        return nodes.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def torn(self, splits: DataFrame) -> DataFrame:
        """Roots of the groups whose rows have two or more different splits in ``splits`` (``row_id``, ``split``)."""
        per_node = self.rows.select("row_id", "node").filter("node is not null").join(splits, "row_id")
        per_node = per_node.groupBy("node").agg(F.min("split").alias("low"), F.max("split").alias("high"))
        groups = self.root_of(per_node).groupBy("root").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        return groups.filter("low < high").select("root")

    def assign(self, shares: dict[str, float]) -> DataFrame:
        """``row_id``, ``root`` (null for a row without entities) and ``split`` of every row."""
        spark = self.rows.sparkSession
        kinds = [F.col("label") == v for v in self.labels]
        known = kinds[0]
        for k in kinds[1:]:
            known = known | k
        vector = [F.count(F.when(k, 1)).alias(f"n{i}") for i, k in enumerate(kinds)]
        vector.append(F.count(F.when(~F.coalesce(known, F.lit(False)), 1)).alias(f"n{len(kinds)}"))
        names = [f"n{i}" for i in range(len(kinds) + 1)]
        total_of = [F.sum(n).alias(n) for n in names]

        nodes = self.root_of(self.rows.filter("node is not null").groupBy("node").agg(*vector))
        nodes = materialize(nodes, "nodes")
        groups = nodes.groupBy("root").agg(*total_of).select(F.lit(False).alias("loose"), F.col("root").alias("item"), *names)
        # a row without entities is a group of its own
        single = [F.coalesce(k, F.lit(False)).cast("bigint").alias(f"n{i}") for i, k in enumerate(kinds)]
        single.append((~F.coalesce(known, F.lit(False))).cast("bigint").alias(names[-1]))
        loose = self.rows.filter("node is null").select(F.lit(True).alias("loose"), F.col("row_id").alias("item"), *single)
        items = materialize(groups.unionByName(loose), "groups")
        size = sum((F.col(n) for n in names), F.lit(0))
        large = F.when(size * LARGE_SHARE > self.total, F.col("item"))
        # from fine classes to coarse ones; the last step has one class per power of two of the size, so it always fits
        for counts, bits in [*((names, b) for b in range(6, -1, -1)), (None, 0)]:
            parts = [_binned(F.col(n), bits) for n in counts] if counts else [_binned(size, 0)]
            keyed = items.select("*", F.concat_ws("/", F.coalesce(large.cast("string"), F.lit("")), *(x.cast("string") for x in parts)).alias("unit"))
            classes = keyed.groupBy("unit").agg(F.count(F.lit(1)).alias("times"), *total_of)
            found = classes.limit(MOST_CLASSES + 1).collect()
            if len(found) <= MOST_CLASSES:
                break
        found.sort(key=lambda r: r["unit"])
        units = [Unit(r["unit"], tuple(r[n] / r["times"] for n in names), r["times"]) for r in found]
        placed = refine(units, place(units, shares), shares)
        # the groups of a class are numbered, and each split takes a run of numbers
        limits, start = [], 0
        for r in found:
            upto = start
            for split, n in placed[r["unit"]].items():
                upto += n
                limits.append((r["unit"], split, start, upto)) if n else None
                start = upto
        numbered = dense_index(keyed, ["unit", F.xxhash64("loose", "item"), "loose", "item"], "__n")
        runs = F.broadcast(spark.createDataFrame(limits, "unit string, split string, low bigint, high bigint"))
        split_of = materialize(numbered.join(runs, "unit").filter("__n >= low and __n < high").select("loose", "item", "split"), "placed")
        node_split = nodes.select("node", F.col("root").alias("item")).join(split_of.filter("not loose"), "item").select("node", F.col("item").alias("root"), "split")
        hot = hot_keys(self.rows, "node", self.total, self.share, self.floor)
        tied = lookup(self.rows.filter("node is not null").select("row_id", "node"), node_split, "node", ["root", "split"], hot)
        free = self.rows.filter("node is null").select("row_id", F.col("row_id").alias("item")).join(split_of.filter("loose").dropDuplicates(["item"]), "item")
        return tied.select("row_id", "root", "split").unionByName(free.select("row_id", F.lit(None).cast("bigint").alias("root"), "split"))

"""Mixing sources to target weights: budgets down a tree, repeats in seeded epochs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.skew import HOT_FLOOR, HOT_SHARE, hot_keys, key_hash, with_group_min
from ..session import materialize

#: Leaves of the tree (and targets) are collected; more than this many are refused.
MAX_LEAVES = 100_000
#: Texts that one slice of the epoch order holds about; a slice of a leaf is what one task orders. The order is that of
#: the hash whatever the number of slices.
SLICE_ROWS = 50_000


def budget(leaves: dict[tuple, tuple[float, float]], total: float) -> dict[tuple, float]:
    """Share ``total`` over ``leaves`` (path: (weight, capacity)) from the root of the tree of paths down.

    A node's weight and capacity are the sums of its leaves'. Children get budgets by weight; what one cannot hold goes
    to its siblings by weight, and only what all of them together cannot hold was ever given to the node's siblings.
    Children without weight get nothing. What exceeds the capacity of the whole tree stays unused.
    """

    def share(items: dict[tuple, tuple[float, float]], depth: int, amount: float) -> dict[tuple, float]:
        if len(items) == 1 and all(len(p) == depth for p in items):
            return {p: min(amount, cap) for p, (_, cap) in items.items()}
        children: dict = {}
        for path, leaf in items.items():
            children.setdefault(path[depth], {})[path] = leaf
        weight = {k: sum(w for w, _ in c.values()) for k, c in children.items()}
        room = {k: sum(cap for w, cap in c.values() if w > 0) for k, c in children.items()}
        given, open_, left = {k: 0.0 for k in children}, {k for k in children if weight[k] > 0}, amount
        while open_ and left > 0:
            scale = left / sum(weight[k] for k in open_)
            full = {k for k in open_ if weight[k] * scale >= room[k]}
            if not full:
                given |= {k: weight[k] * scale for k in open_}
                break
            for k in full:
                given[k] = room[k]
                left -= room[k]
            open_ -= full
        out: dict[tuple, float] = {}
        for k, c in children.items():
            out |= share(c, depth + 1, given[k])
        return out

    return share(leaves, 0, total) if leaves else {}


class Mixture:
    """A mixture of ``rows`` (``doc_id``, ``digest`` of the text, ``n_tokens``, the ``levels``).

    ``shares`` gives (target share, greatest number of uses of a text) for each value of the first level; within it the
    weight follows the tokens. Rows of other sources don't take part. A text delivered several times is one text, that
    of the least ``doc_id``. ``total`` is the size of the mixture in tokens, by default all distinct tokens there are.
    """

    def __init__(
        self, rows: DataFrame, shares: dict[str, tuple[float, int]], levels: Sequence[str], seed: int, total_rows: int, total: int | None = None
    ):
        rows = materialize(rows.filter("n_tokens > 0"), "mix-rows")
        hot = hot_keys(rows, key_hash("digest"), total_rows, HOT_SHARE, HOT_FLOOR)
        once = with_group_min(rows, ["digest"], "doc_id", "first", hot).filter("doc_id = first")
        self.texts = materialize(once.select("doc_id", "n_tokens", *levels), "mix-texts")
        self.shares, self.levels, self.seed = shares, list(levels), seed
        stats = self.texts.groupBy(*levels).agg(F.sum("n_tokens").alias("t")).limit(MAX_LEAVES + 1).collect()
        if len(stats) > MAX_LEAVES or len(shares) > MAX_LEAVES:
            raise ValueError(f"more than {MAX_LEAVES} leaves")
        self.tokens = {tuple(r[c] for c in levels): r["t"] for r in stats}
        by_source: dict = {}
        for path, t in self.tokens.items():
            by_source[path[0]] = by_source.get(path[0], 0) + t
        self.by_source = by_source
        self.total = sum(by_source.values()) if total is None else total
        leaves = {p: (shares[p[0]][0] * t / by_source[p[0]], float(t * shares[p[0]][1])) for p, t in self.tokens.items()}
        self.budgets = budget(leaves, self.total)
        self.slice_bits = max(6, min(30, (total_rows // SLICE_ROWS).bit_length()))
        self._selection: DataFrame | None = None

    def selection(self) -> DataFrame:
        """Texts of the mixture with ``copies``, the number of their uses: the whole epochs that fit the budget of the
        leaf, and one more for a prefix of the next epoch, whose order is a hash of seed, epoch and ``doc_id``."""
        if self._selection is not None:
            return self._selection
        spark = self.texts.sparkSession
        plan = []
        for path, b in self.budgets.items():
            t = self.tokens[path]
            whole = min(int(b // t), self.shares[path[0]][1])
            rest = int(b - whole * t) if whole < self.shares[path[0]][1] else 0
            plan.append((*path, whole, rest))
        types = dict(self.texts.dtypes)
        schema = ", ".join(f"{c} {types[c]}" for c in self.levels) + ", whole int, rest bigint"
        leaf = F.broadcast(spark.createDataFrame(plan, schema))
        order = F.xxhash64(F.lit(self.seed), "whole", "doc_id")
        rows = self.texts.join(leaf, self.levels).withColumn("__order", order)
        rows = rows.withColumn("__slice", F.shiftright("__order", 64 - self.slice_bits).cast("int"))
        rows = materialize(rows, "mix-order")
        slices = rows.groupBy(*self.levels, "__slice").agg(F.sum("n_tokens").alias("t"))
        upto = F.sum("t").over(W.partitionBy(*self.levels).orderBy("__slice").rowsBetween(W.unboundedPreceding, W.currentRow))
        slices = slices.withColumn("__before", upto - F.col("t")).drop("t")
        placed = rows.join(slices, [*self.levels, "__slice"])
        inside = W.partitionBy(*self.levels, "__slice").orderBy("__order", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
        reached = F.col("__before") + F.sum("n_tokens").over(inside)
        # the text at the end of the budget is used if half of it fits
        copies = F.col("whole") + (reached - F.col("n_tokens") / 2 <= F.col("rest")).cast("int")
        out = placed.withColumn("copies", copies).filter("copies > 0").select("doc_id", *self.levels, "n_tokens", "copies")
        self._selection = out
        return out

    def report(self) -> DataFrame:
        """Per target: share wanted and reached, tokens there, planned and used, and the shortfall; also for sources
        that are absent."""
        first = self.levels[0]
        used = {r[0]: r[1] for r in self.selection().groupBy(first).agg(F.sum(F.col("n_tokens") * F.col("copies"))).collect()}
        whole = sum(used.values()) or 1
        planned: dict = {}
        for path, b in self.budgets.items():
            planned[path[0]] = planned.get(path[0], 0.0) + b
        rows = []
        for source, (share, repeats) in sorted(self.shares.items()):
            aim = share * self.total
            got = int(used.get(source, 0))
            rows.append((source, share, repeats, int(self.by_source.get(source, 0)), int(planned.get(source, 0.0)), got, round(got / whole, 6), max(0, int(aim) - got)))
        schema = f"{first} string, target_share double, max_repeats int, available_tokens bigint, planned_tokens bigint, used_tokens bigint, actual_share double, missing_tokens bigint"
        return self.texts.sparkSession.createDataFrame(rows, schema)

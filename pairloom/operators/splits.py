"""Splits of a pair table: stratified, provided, edge-level (C1) and entity-level (C2, C3), single and best of many."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .audit import overlaps
from .mapping import uncovered
from .ordering import dense_index, hash_order, running_sums
from .pairs import ConstraintError, require_empty, unordered
from .skew import endpoint_lookup


@dataclass(frozen=True)
class Strategy:
    name: str
    protocol_id: str
    drop_reason: str | None = None


# Protocol ids and reasons for dropping a row.
STRATEGIES = {
    s.name: s
    for s in (
        Strategy("provided_column", "ppi.provided.v1"),
        Strategy("random", "ppi.random_pair.v1"),
        Strategy("c1", "ppi.c1.v1"),
        Strategy("c2", "ppi.c2.v1", "both_endpoints_held_out"),
        Strategy("c3", "ppi.c3.v1", "endpoints_in_different_partitions"),
    )
}


def uniform(seed: int, *keys: Column | str) -> Column:
    """Number in [0, 2**52) from the md5 of seed and keys, exact as a double and the same on any engine."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 13), 16, 10).cast("double")


def provided(rows: DataFrame, column: str) -> DataFrame:
    """``split`` from a column, without regard to case and blanks; other values are refused."""
    named = rows.withColumn("split", F.lower(F.trim(F.col(column))))
    require_empty(named.filter(~F.coalesce(F.col("split").isin("train", "val", "test"), F.lit(False))).select(column).distinct(), "unknown splits")
    return named


def random_pairs(rows: DataFrame, identifier: str, train: float = 0.8, val: float = 0.1, seed: int = 0) -> DataFrame:
    """Stratified by label with exact sizes per label: the first floor(train * n) of the hash order of a label train, the
    next up to floor((train + val) * n) validate, the rest tests."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect()
    offsets, start = [], 0
    for r in counts:
        offsets.append((r["label"], start, math.floor(train * r["n"] + 1e-9), math.floor((train + val) * r["n"] + 1e-9)))
        start += r["n"]
    table = F.broadcast(rows.sparkSession.createDataFrame(offsets, "__label int, __start bigint, __train bigint, __val bigint"))
    numbered = dense_index(rows, [F.col("label").asc_nulls_first(), hash_order(seed, F.col(identifier).cast("string")), identifier], "__n")
    placed = numbered.join(table, F.col("label").eqNullSafe(F.col("__label")))
    j = F.col("__n") - F.col("__start")
    return placed.select(*rows.columns, F.when(j < F.col("__train"), "train").when(j < F.col("__val"), "val").otherwise("test").alias("split"))


def edge_units(rows: DataFrame) -> DataFrame:
    """(lo, hi, size): repeated unordered pairs move as one."""
    lo, hi = unordered("protein_a", "protein_b")
    return rows.groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.count(F.lit(1)).alias("size"))


def c1(rows: DataFrame, val: float = 0.1, test: float = 0.1, seed: int = 0) -> DataFrame:
    """Edge hold-out in which every endpoint of a held-out edge occurs in training.

    Each entity anchors its last edge in the hash order to training, so whatever part of the other edges is held out,
    no repair is needed. Free edges go to test and then to validation in hash order, each as close to its size as whole
    units allow.
    """
    units = materialize(edge_units(rows).withColumn("u", uniform(seed, "lo", "hi")), "units")
    ends = units.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("entity"), "u", "lo", "hi")
    anchors = ends.groupBy("entity").agg(F.max(F.struct("u", "lo", "hi")).alias("m")).select("m.lo", "m.hi").distinct()
    free = units.join(anchors, ["lo", "hi"], "left_anti")
    total = units.agg(F.sum("size")).first()[0] or 0
    run = running_sums(free, [], "u", {"upto": "size"}, descending=False, ties=["lo", "hi"])
    middle = F.col("upto") - F.col("size") / 2.0
    place = F.when(middle <= test * total, "test").when(middle <= (test + val) * total, "val").otherwise("train")
    held = run.select(F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), place.alias("__place"))
    lo, hi = unordered("protein_a", "protein_b")
    keyed = rows.withColumn("__l", lo).withColumn("__h", hi)
    joined = keyed.join(held, (F.col("__l") == F.col("__lo")) & (F.col("__h") == F.col("__hi")), "left")
    return joined.select(*rows.columns, F.coalesce("__place", F.lit("train")).alias("split"))


# --- entity-level splits -----------------------------------------------------------------------------------------------------


def held_out_fraction(mode: str, test: float) -> float:
    """Share of groups to hold out so that the kept pairs have a share ``test`` of test pairs."""
    if mode == "c2":
        return test / (2 - test)
    return math.sqrt(test) / (math.sqrt(test) + math.sqrt(1 - test))


def partition_counts(mode: str, n_groups: int, val: float, test: float) -> tuple[int, int, int]:
    """Groups of the train, validation and test partition, each at least one, as close to the wanted shares as can be."""
    if n_groups < 3:
        raise ConstraintError("a three-way split needs three groups")
    train = 1 - val - test
    raw = [1.0, val / (2 * train), test / (2 * train)] if mode == "c2" else [math.sqrt(x) for x in (train, val, test)]
    raw = [n_groups * w / sum(raw) for w in raw]
    counts = [max(1, math.floor(w)) for w in raw]
    while sum(counts) != n_groups:
        gap = [w - c for w, c in zip(raw, counts, strict=True)]
        if sum(counts) < n_groups:
            counts[gap.index(max(gap))] += 1
        else:
            open_ = [i for i in range(3) if counts[i] > 1]
            counts[min(open_, key=lambda i: gap[i])] -= 1
    return counts[0], counts[1], counts[2]


def check_groups(rows: DataFrame, groups: DataFrame) -> None:
    """``groups`` (protein_id, group_id) must cover every endpoint once."""
    require_empty(uncovered(rows, groups, "protein_id"), "proteins without a group")
    require_empty(groups.groupBy("protein_id").count().filter("count > 1"), "proteins with several groups")


def _ranked_groups(groups: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """(trial, group_id, rank): the groups in the hash order of each seed, rank from 1."""
    trial = F.explode(F.array(*(F.struct(F.lit(i).alias("trial"), F.lit(s).cast("string").alias("seed")) for i, s in enumerate(seeds))))
    names = groups.select("group_id").distinct().select("group_id", trial.alias("t"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", "t.seed", "group_id")), 1, 13), 16, 10).cast("double")
    keyed = names.select("t.trial", "group_id", u.alias("u"), F.lit(1).alias("one"))
    return running_sums(keyed, ["trial"], "u", {"rank": "one"}, descending=False, ties=["group_id"]).select("trial", "group_id", "rank")


def partitions(groups: DataFrame, counts: Sequence[int], seeds: Sequence[int]) -> DataFrame:
    """(trial, group_id, part): part 0 for the first counts[0] groups of the order of a seed, then 1, then 2."""
    rank, first, second = F.col("rank"), counts[0], counts[0] + (counts[1] if len(counts) > 2 else 0)
    part = F.when(rank <= first, 0).when(rank <= second, 1).otherwise(2)
    return _ranked_groups(groups, seeds).select("trial", "group_id", part.alias("part"))


def _place(mode: str, a: Column, b: Column) -> Column:
    low, high = F.least(a, b), F.greatest(a, b)
    split = F.when(high == 0, "train")
    if mode == "c2":
        return split.when((low == 0) & (high == 1), "val").when((low == 0) & (high == 2), "test").otherwise("dropped")
    return split.when((low == 1) & (high == 1), "val").when((low == 2) & (high == 2), "test").otherwise("dropped")


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with ``group_a`` and ``group_b``; rows of an endpoint without a group are left out."""
    named = endpoint_lookup(rows, groups.withColumnRenamed("group_id", "group"), "protein_id", ["group"])
    return named.filter("group_a is not null and group_b is not null")


def _placed(grouped: DataFrame, parts: DataFrame, mode: str) -> DataFrame:
    """``grouped`` once per trial of ``parts``, with ``split`` (dropped included) and the group on the training side.

    All trials travel as one array per group, so many trials cost the two look-ups of one.
    """
    arrays = materialize(parts.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("trial", "part"))).alias("parts")), "group-parts")
    out = endpoint_lookup(grouped, arrays, "group_id", ["parts"], ("group_a", "group_b"), broadcast_rows=20_000)
    flat = out.select(*grouped.columns, F.explode(F.arrays_zip("parts_a", "parts_b")).alias("z"))
    trial, pa, pb = F.col("z.parts_a.trial"), F.col("z.parts_a.part"), F.col("z.parts_b.part")
    return flat.select(*grouped.columns, trial.alias("trial"), _place(mode, pa, pb).alias("split"), F.when(pa == 0, F.col("group_a")).when(pb == 0, F.col("group_b")).alias("train_group"))


def place_groups(rows: DataFrame, groups: DataFrame, parts: DataFrame, mode: str) -> DataFrame:
    """``rows`` with the groups of both endpoints and ``split`` (with ``dropped``), once per trial of ``parts``."""
    return _placed(_with_groups(rows, groups), parts, mode)


def unrepresented(placed: DataFrame, *by: str) -> DataFrame:
    """C2: groups on the training side of a held-out pair that no training pair shows."""
    held = placed.filter("split in ('val', 'test')").select(*by, F.col("train_group").alias("g")).distinct()
    shown = placed.filter("split = 'train'").select(*by, F.explode(F.array("group_a", "group_b")).alias("g")).distinct()
    return held.join(shown, [*by, "g"], "left_anti")


def _unrepresented_rows(placed: DataFrame) -> DataFrame:
    return unrepresented(placed, "trial").select("trial").distinct()


def trial_scores(placed: DataFrame, mode: str, val: float, test: float) -> DataFrame:
    """Per trial that is valid: kept pairs, size error and label error, from rows or from cells of ``n_rows`` rows.

    A trial is valid if every split holds every label and, in C2, every group on the training side of a held-out pair
    occurs in a training pair.
    """
    n = F.sum("n_rows") if "n_rows" in placed.columns else F.count(F.lit(1))
    counts = placed.groupBy("trial", "split", "label").agg(n.alias("n"))
    overall = counts.groupBy("trial", "label").agg(F.sum("n").alias("n_all"))
    overall = overall.withColumn("rate_all", F.col("n_all") / F.sum("n_all").over(W.partitionBy("trial")))
    kept = counts.filter("split <> 'dropped'").withColumn("n_split", F.sum("n").over(W.partitionBy("trial", "split")))
    n_labels = overall.groupBy("trial").agg(F.count(F.lit(1)).alias("n_labels"))
    cells = kept.join(overall.select("trial", "label", "rate_all"), ["trial", "label"])
    aim = F.when(F.col("split") == "val", F.lit(val)).when(F.col("split") == "test", F.lit(test))
    per_split = cells.groupBy("trial", "split").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels"), F.sum(F.abs(F.col("n") / F.col("n_split") - F.col("rate_all"))).alias("label_error")
    )
    total = F.sum("n").over(W.partitionBy("trial"))
    per_split = per_split.withColumn("size_error", F.coalesce(F.abs(F.col("n") / total - aim), F.lit(0.0)))
    wanted = 3 if val > 0 else 2
    scores = per_split.groupBy("trial").agg(
        F.sum("n").alias("n_kept"), F.sum("size_error").alias("size_error"), F.sum("label_error").alias("label_error"),
        F.min("labels").alias("least_labels"), F.count(F.lit(1)).alias("n_splits"),
    ).join(n_labels, "trial")
    valid = scores.filter((F.col("least_labels") == F.col("n_labels")) & (F.col("n_splits") == wanted))
    if mode == "c2":
        valid = valid.join(_unrepresented_rows(placed), "trial", "left_anti")
    return valid.select("trial", "n_kept", "size_error", "label_error")


def trial_distances(placed: DataFrame, trials: Sequence[int]) -> DataFrame:
    """Per trial: distance of the degree shapes of validation and test from training (only for tied trials)."""
    rows = placed.filter(F.col("trial").isin(list(trials)) & (F.col("split") != "dropped"))
    degree = rows.select("trial", "split", F.explode(F.array("protein_a", "protein_b")).alias("p")).groupBy("trial", "split", "p").agg(F.count(F.lit(1)).alias("d"))
    points = F.array(*(F.lit(i / 20) for i in range(21)))
    counted = degree.groupBy("trial", "split", "d").agg(F.count(F.lit(1)).alias("n"))
    shapes = counted.groupBy("trial", "split").agg(F.percentile("d", points, F.col("n")).alias("q"), (F.sum(F.col("n") * F.col("d")) / F.sum("n")).alias("m"))
    shapes = shapes.select("trial", "split", F.transform("q", lambda x: x / F.col("m")).alias("q"))
    train = shapes.filter("split = 'train'").select("trial", F.col("q").alias("t"))
    other = shapes.filter("split <> 'train'").join(train, "trial")
    gap = F.aggregate(F.zip_with("q", "t", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / 21
    return other.groupBy("trial").agg(F.sum(gap).alias("distance"))


def entity_split(
    rows: DataFrame, groups: DataFrame, mode: str, val: float = 0.1, test: float = 0.1, seed: int = 0, n_trials: int = 1
) -> DataFrame:
    """``rows`` with ``split`` and ``drop_reason`` from the best of ``n_trials`` assignments of whole groups.

    Best: most pairs kept, then least size error, then least label error, then least degree distance (computed for ties
    only), then the first trial. With one trial, the assignment of ``seed`` is taken if it is valid.
    """
    check_groups(rows, groups)
    n_groups = groups.select("group_id").distinct().count()
    if val > 0:
        counts: Sequence[int] = partition_counts(mode, n_groups, val, test)
    else:
        held = min(max(1, round(n_groups * held_out_fraction(mode, test))), n_groups - 1)
        counts = (n_groups - held, 0, held)
    parts = materialize(partitions(groups, counts, [seed + t for t in range(n_trials)]), "parts")
    grouped = materialize(_with_groups(rows, groups), "grouped-rows")
    # trials are scored on counts per pair of groups and label, so no row is repeated for every trial
    cells = materialize(grouped.groupBy("group_a", "group_b", "label").agg(F.count(F.lit(1)).alias("n_rows")), "group-cells")
    scored = _placed(cells, parts, mode)
    scores = trial_scores(scored, mode, val, test).collect()
    if not scores:
        raise ConstraintError(f"none of {n_trials} assignments is valid")
    key = lambda r: (-r["n_kept"], r["size_error"], r["label_error"])
    best = min(map(key, scores))
    tied = sorted(r["trial"] for r in scores if key(r) == best)
    if len(tied) > 1:
        among = _placed(grouped, parts.filter(F.col("trial").isin(tied)), mode)
        distance = {r["trial"]: r["distance"] for r in trial_distances(among, tied).collect()}
        tied.sort(key=lambda t: (distance.get(t, math.inf), t))
    chosen = _placed(grouped, parts.filter(F.col("trial") == tied[0]), mode)
    reason = F.when(F.col("split") == "dropped", STRATEGIES[mode].drop_reason)
    return chosen.select(*rows.columns, "split", reason.alias("drop_reason"))


def split_pairs(rows: DataFrame, strategy: str, identifier: str = "source_row_index", groups: DataFrame | None = None, **options) -> DataFrame:
    """Dispatcher over the registered strategies; ``rows`` with ``split``."""
    if strategy not in STRATEGIES:
        raise ConstraintError(f"unknown strategy {strategy!r}; there are {sorted(STRATEGIES)}")
    if strategy == "provided_column":
        return provided(rows, options["column"])
    if strategy == "random":
        return random_pairs(rows, identifier, **options)
    if strategy == "c1":
        return c1(rows, **options)
    if groups is None:
        ends = rows.select(F.explode(F.array("protein_a", "protein_b")).alias("protein_id")).distinct()
        groups = ends.withColumn("group_id", F.col("protein_id"))
    return entity_split(rows, groups, strategy, **options)


# --- audits ------------------------------------------------------------------------------------------------------------------


def label_balance_error(rows: DataFrame) -> DataFrame:
    """One row: sum over splits and labels of the absolute deviation of the label's rate from its rate in all rows."""
    cells = rows.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    rates = cells.groupBy("label").agg(F.sum("n").alias("n_label"))
    total = F.sum("n_label").over(W.partitionBy())
    rates = rates.select(F.col("label").alias("__label"), (F.col("n_label") / total).alias("rate"))
    sizes = cells.groupBy("split").agg(F.sum("n").alias("n_split"))
    grid = sizes.join(F.broadcast(rates))  # a few splits by a few labels
    counted = cells.select(F.col("split").alias("__split"), F.col("label").alias("__l"), "n")
    joined = grid.join(counted, (F.col("split") == F.col("__split")) & F.col("__label").eqNullSafe(F.col("__l")), "left")
    return joined.agg(F.sum(F.abs(F.coalesce("n", F.lit(0)) / F.col("n_split") - F.col("rate"))).alias("label_balance_error"))


def class_summary(rows: DataFrame) -> DataFrame:
    """Count and rate of each label per split."""
    cells = rows.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("rate", F.col("n") / F.sum("n").over(W.partitionBy("split")))


def cluster_sizes(groups: DataFrame) -> DataFrame:
    """One row: clusters, least, median, mean and greatest size, and the share of the largest."""
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_clusters"), F.min("n").alias("min"), F.percentile("n", 0.5).alias("median"), F.avg("n").alias("mean"),
        F.max("n").alias("max"), (F.max("n") / F.sum("n")).alias("largest_fraction"),
    )


def invariants(rows: DataFrame, mode: str) -> DataFrame:
    """(invariant, n_violations) of a split with ``split`` in train, val, test (dropped rows aside)."""
    kept = rows.filter("split <> 'dropped'")
    ends = kept.select("split", F.explode(F.array("protein_a", "protein_b")).alias("p")).groupBy("p").agg(F.collect_set("split").alias("s"))
    in_train = F.array_contains("s", "train")
    shared = overlaps(kept, "unordered_pairs").agg(F.coalesce(F.sum("n_shared"), F.lit(0)).alias("n"))
    checks = [shared.select(F.lit("no_shared_pairs").alias("invariant"), F.col("n").cast("bigint").alias("n_violations"))]
    if mode == "c1":
        checks.append(ends.agg(F.count_if(~in_train).alias("n_violations")).select(F.lit("held_out_endpoints_in_train").alias("invariant"), "n_violations"))
    else:
        joined = endpoint_lookup(kept.filter("split <> 'train'"), ends.select("p", in_train.alias("t")), "p", ["t"])
        n_train = F.coalesce(F.col("t_a").cast("int"), F.lit(0)) + F.coalesce(F.col("t_b").cast("int"), F.lit(0))
        want = 1 if mode == "c2" else 0
        checks.append(joined.agg(F.count_if(n_train != want).alias("n_violations")).select(F.lit(f"exactly_{want}_endpoint_in_train").alias("invariant"), "n_violations"))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out

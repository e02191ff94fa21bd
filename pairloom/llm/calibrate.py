"""A sample that follows given category shares: exponential tilting by Newton steps, drawn by the pivotal method."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of one category that one task draws from at a time.
BLOCK_ROWS = 50_000
#: Largest table of targets; it is collected.
MAX_CATEGORIES = 100_000


@dataclass
class Category:
    key: tuple
    per_mille: int
    available: int = 0
    wanted: int = 0
    target: float = 0.0
    probability: float = 0.0


def set_targets(categories: list[Category], size: int, minimum: int, nominal: int) -> None:
    """Expected counts: floors and exhausted categories are fixed, the rest shares what remains by its shares.

    Floors win: if they need more rows than ``size``, the sample is as large as they need and holds nothing else.
    ``nominal`` is the size asked for, from which ``wanted`` follows; ``size`` is at most the number of rows.
    """
    for c in categories:
        c.wanted = max(nominal * c.per_mille // 1000, minimum)
    fixed: dict[int, float] = {i: float(c.available) for i, c in enumerate(categories) if c.available <= minimum}
    while True:
        free = [i for i in range(len(categories)) if i not in fixed]
        rest, weight = max(0.0, size - sum(fixed.values())), sum(categories[i].per_mille for i in free)
        want = {i: rest * categories[i].per_mille / weight if weight else 0.0 for i in free}
        short = {i: float(categories[i].available) for i in free if want[i] > categories[i].available}
        low = {i: float(min(minimum, categories[i].available)) for i in free if want[i] < minimum}
        if not short and not low:
            break
        fixed |= short or low
    for i, c in enumerate(categories):
        c.target = fixed.get(i, want.get(i, 0.0))


def tilt(categories: list[Category], size: int, population: int, tolerance: float = 1e-10, steps: int = 200) -> int:
    """Inclusion probabilities base * exp(lambda_c) whose category moments meet the targets; returns the Newton steps.

    Minimises the convex dual sum_c N_c * base * exp(lambda_c) - target_c * lambda_c. Its gradient and (diagonal)
    Hessian need nothing but the category counts, which the cluster has summed up. Steps are cut to 2 in size, so the
    iteration cannot overshoot.
    """
    live = [c for c in categories if c.target > 0 and c.available > 0]
    base = min(1.0, size / max(population, 1)) or 1.0
    n = np.array([c.available for c in live], float)
    t = np.array([c.target for c in live], float)
    lam = np.zeros(len(live))
    done = 0
    for done in range(1, steps + 1):  # noqa: B007
        moment = n * base * np.exp(lam)
        gradient = moment - t
        if not len(live) or np.max(np.abs(gradient) / np.maximum(t, 1)) < tolerance:
            break
        lam -= np.clip(gradient / moment, -2, 2)
    for c, p in zip(live, base * np.exp(lam), strict=True):
        c.probability = min(1.0, float(p)) if p < 1 - 1e-12 else 1.0
    return done


def tilt_margins(cells: dict[tuple, int], targets: list[dict], size: int, population: int, tolerance: float = 1e-9, steps: int = 200) -> dict[tuple, float]:
    """Inclusion probability of each cell whose counts meet the targets of several overlapping margins at once.

    A cell is a tuple with one value per margin, ``targets[m]`` gives the rows wanted per value of margin m, and a cell
    has the probability base * exp(sum of the multipliers of its values), at most 1. The dual is minimised by Newton
    steps with its full Hessian, the matrix of joint counts of the values, which needs nothing but the cell counts that
    the cluster has summed up. Margins are redundant (each sums to the size), so steps are least-squares solutions. Cells
    that would need more rows than they have are taken whole and leave the targets. Cells with a value that no target
    names, or with a target of 0, have probability 0. Targets that contradict each other are met as nearly as the last
    step does.
    """
    live = [k for k in cells if cells[k] > 0 and all(t.get(v, 0) > 0 for t, v in zip(targets, k, strict=True))]
    out = dict.fromkeys(cells, 0.0)
    if not live:
        return out
    names = [(m, v) for m, t in enumerate(targets) for v in t if t[v] > 0]
    row_of = {x: i for i, x in enumerate(names)}
    member = np.zeros((len(names), len(live)))
    for j, k in enumerate(live):
        for m, v in enumerate(k):
            member[row_of[m, v], j] = 1
    n = np.array([cells[k] for k in live], float)
    want = np.array([targets[m][v] for m, v in names], float)
    base, whole, lam = min(1.0, size / max(population, 1)) or 1.0, np.zeros(len(live), bool), np.zeros(len(names))
    for _ in range(len(live) + 1):
        for _ in range(steps):
            moment = np.where(whole, n, n * base * np.exp(np.clip(lam @ member, -50, 50)))
            gradient = member @ moment - want
            if np.max(np.abs(gradient) / np.maximum(want, 1)) < tolerance:
                break
            hessian = (member * np.where(whole, 0, moment)) @ member.T
            lam -= np.clip(np.linalg.lstsq(hessian, gradient, rcond=1e-12)[0], -2, 2)
        p = np.where(whole, 1.0, base * np.exp(np.clip(lam @ member, -50, 50)))
        over = p > 1 + 1e-9
        if not over.any():
            break
        whole |= over
    for k, x in zip(live, p, strict=True):
        out[k] = min(1.0, float(x))
    return out


def pivotal(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Pivotal method: duels between neighbours until at most one unit is undecided; sums and expectations are kept."""
    p = p.astype(float).copy()
    active = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
    while len(active) > 1:
        half = len(active) // 2
        a, b, last = active[: 2 * half : 2], active[1 : 2 * half : 2], active[2 * half :]
        pa, pb, u = p[a], p[b], rng.random(half)
        s = pa + pb
        small = s < 1
        first = u < np.where(small, pa / s, (1 - pb) / np.maximum(2 - s, 1e-300))
        high, low = np.where(small, s, 1.0), np.where(small, 0.0, s - 1)
        p[a], p[b] = np.where(first, high, low), np.where(first, low, high)
        pair = np.stack([a, b], 1).ravel()
        active = np.concatenate([pair, last])
        active = active[(p[active] > 1e-9) & (p[active] < 1 - 1e-9)]
    return p


def _draw(units: DataFrame, seed: int, level: int, by: list[str]) -> DataFrame:
    """One level of duels: per group of ``by`` all units but at most one are decided; losers are gone."""

    def duel(key, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["__rank", "unit_id"], kind="stable")
        rng = np.random.default_rng([seed & (2**63 - 1), level, *(int(k) + 1 for k in key)])
        p = pivotal(pdf["p"].to_numpy(), rng)
        kept = p > 1e-9
        return pd.DataFrame({"unit_id": pdf["unit_id"][kept], "category": pdf["category"][kept], "p": np.where(p[kept] > 1 - 1e-9, 1.0, p[kept])})

    ranked = units.withColumn("__rank", F.xxhash64(F.lit(seed), "unit_id"))
    return ranked.groupBy(*by).applyInPandas(duel, "unit_id bigint, category int, p double")


def draw(units: DataFrame, categories: list[Category], seed: int) -> DataFrame:
    """(``unit_id``, ``category``) of a fixed-size sample from ``units`` (``unit_id``, ``category``).

    Blocks are cut by a hash of the unit, so the result doesn't depend on the partitioning. Each level leaves at most
    one undecided unit per block, so levels shrink by ``BLOCK_ROWS``, first within each category, and once each has one
    block left, across them, however many categories there are; at most ``BLOCK_ROWS`` units meet in the last level,
    which runs across categories and so keeps the total.
    """
    spark = units.sparkSession
    probability = [(i, c.probability) for i, c in enumerate(categories) if c.probability > 0]
    blocks = {i: max(1, -(-categories[i].available // BLOCK_ROWS)) for i, p in probability if p < 1}
    known = units.join(F.broadcast(spark.createDataFrame(probability, "category int, p double")), "category")
    decided = [known.filter("p >= 1").select("unit_id", "category")]
    rest, level, left = known.filter("p < 1"), 0, 0
    while True:
        place = F.xxhash64(F.lit(seed), F.lit(level) if level else F.lit("block"), "unit_id")
        if blocks:
            table = F.broadcast(spark.createDataFrame(list(blocks.items()), "category int, blocks bigint"))
            open_ = rest.join(table, "category").withColumn("__block", F.pmod(place, F.col("blocks")))
            left = sum(blocks.values())
        else:
            left = max(1, -(-left // BLOCK_ROWS))
            open_ = rest.withColumn("__block", F.pmod(place, F.lit(left)))
        drawn = materialize(_draw(open_.select("unit_id", "category", "p", "__block"), seed, level, ["category", "__block"] if blocks or not level else ["__block"]), f"drawn-{level}")
        decided.append(drawn.filter("p = 1").select("unit_id", "category"))
        rest = drawn.filter("p < 1")
        level += 1
        if left <= BLOCK_ROWS:
            break
        # blocks of one category meet again until each category has at most one row left; then categories meet
        blocks = {i: -(-n // BLOCK_ROWS) for i, n in blocks.items()} if any(n > 1 for n in blocks.values()) else {}
    last = sorted(tuple(r) for r in rest.select("category", "unit_id", "p").collect())
    p = pivotal(np.array([r[2] for r in last]), np.random.default_rng([seed & (2**63 - 1), 10**6])) if last else np.array([])
    # within a category first (sorted), then across; a last lone unit is settled by rounding, so the size is exact
    winners = [(r[1], r[0]) for r, x in zip(last, p, strict=True) if x >= 0.5]
    decided.append(spark.createDataFrame(winners, "unit_id bigint, category int"))
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out


def count_categories(rows: DataFrame, keys: list[str], targets: list[Category]) -> None:
    """Fill ``available`` from counts that the cluster sums up; categories without a target are left out there."""
    if len(targets) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories")
    by = category_index(rows, keys, targets).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    found = {r[0]: r[1] for r in by.filter("category is not null").collect()}
    for i, c in enumerate(targets):
        c.available = found.get(i, 0)


def category_index(rows: DataFrame, keys: list[str], targets: list[Category]) -> DataFrame:
    """``rows`` with ``category``, the position of their key in ``targets``; null if it has none (or is null)."""
    types = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)
    table = rows.sparkSession.createDataFrame([(*c.key, i) for i, c in enumerate(targets)], f"{types}, category int")
    return rows.join(F.broadcast(table), keys, "left")


def nominal_size(max_examples: int | None, fraction: float | None, population: int) -> int:
    return max_examples if max_examples is not None else math.floor(population * (fraction or 0.0))


def report(spark, categories: list[Category], names: list[tuple[str, str]], drawn: dict[int, int] | None = None) -> DataFrame:
    """Per category what was wanted, there, aimed at and drawn, and the gap to what was wanted."""
    rows = [
        (*c.key, c.per_mille, c.wanted, c.available, round(c.target, 6), None if drawn is None else drawn.get(i, 0), max(0, c.wanted - c.available))
        for i, c in enumerate(categories)
    ]
    types = ", ".join(f"{n} {t}" for n, t in names)
    return spark.createDataFrame(rows, f"{types}, target_per_mille int, wanted bigint, available bigint, target double, drawn bigint, gap bigint")


def falls_short() -> Column:
    return F.col("available") < F.col("wanted")

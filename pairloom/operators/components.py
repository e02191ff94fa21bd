"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import HOT_FLOOR, HOT_SHARE, hot_keys, key_hash, with_group_min
from ..session import discard, materialize


def _star(edges: DataFrame, n: int, share: float, floor: int, symmetric: bool) -> DataFrame:
    """Link neighbours of each node ``u`` to the least of them and ``u``: the larger ones, or all smaller ones."""
    if symmetric:
        edges = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        n *= 2
    hot = hot_keys(edges, key_hash("u"), n, share, floor)
    met = with_group_min(edges, ["u"], "v", "m", hot)
    if symmetric:  # large star
        return met.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    # small star: every edge points from larger to smaller
    both = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
    return met.select(F.explode(both).alias("e")).select("e.u", "e.v").filter("u > v")


def connected_components(edges: DataFrame, share: float = HOT_SHARE, floor: int = HOT_FLOOR, most_rounds: int = 60) -> DataFrame:
    """(``node``, ``root``) for each node of ``edges`` (``u``, ``v`` bigint); the root is the least node.

    Alternates large-star and small-star steps until the edges no longer change, which takes a number of rounds about
    logarithmic in the longest path. Nodes with very many neighbours are reduced by salted partial minima. Self loops,
    repeated edges and nulls are ignored, so a node that has no other edge is absent.
    """
    edges = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "edges")
    before = None
    for _ in range(most_rounds):
        n, check = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, check) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = n, check
        large = materialize(_star(edges, n, share, floor, True).distinct(), "large-star") if n > floor else _star(edges, n, share, floor, True)
        small = materialize(_star(large, 2 * n, share, floor, False).distinct(), "small-star")
        discard(edges)
        discard(large)
        edges = small
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")

"""Sequence clusters without an external tool: minwise hashing of k-mer sets and connected components.

An approximation: two sequences share a cluster if a chain of sequences of k-mer Jaccard similarity of at least the
threshold, found through shared buckets, leads from one to the other. All pairs that share a bucket count, and there are
enough bands to lose a pair at the threshold with probability ``MISSED`` at most. The contract of a supplied mapping
(read_clusters) is the exact alternative.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import connected_components
from .features import kmers
from .ordering import dense_index
from .skew import HOT_FLOOR, HOT_SHARE, hot_keys, key_hash, lookup, with_group_min

MISSED = 1e-3
#: Members of a bucket that one block holds; two blocks are compared at a time.
BLOCK = 1000
#: Sequences a signature of this many rows takes before it gets another one, and the factor from there to the next: unrelated
#: sequences of 3-mers then share a bucket with a handful of others, however long the table is.
SHORTEST_WIDTH, SHORT_ROWS, ROWS_PER_WIDTH = 3, 20_000, 30


def width_for(n: int) -> int:
    return SHORTEST_WIDTH + max(0, math.ceil(math.log(max(n, 1) / SHORT_ROWS, ROWS_PER_WIDTH)))


def bands_for(threshold: float, width: int, missed: float = MISSED) -> int:
    """Bands that lose a pair of similarity ``threshold`` with probability ``missed`` at most."""
    return 1 if threshold >= 1 else math.ceil(math.log(missed) / math.log1p(-(threshold**width)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _buckets(rows: DataFrame, bands: int, width: int) -> DataFrame:
    """(n, bucket) of ``rows`` (n, terms not empty), one per band; many hashes of long arrays are vectorised in Python."""
    seeds = _mix(np.arange(1, bands * width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def sign(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                hashes = batch.column(1)
                flat = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                lengths = hashes.value_lengths().to_numpy(zero_copy_only=False)
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                out = np.empty((batch.num_rows, bands), np.uint64)
                for b in range(bands):
                    bucket = np.full(batch.num_rows, b, np.uint64)
                    for s in seeds[b * width : (b + 1) * width]:
                        bucket = _mix(bucket * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(_mix(flat ^ s), starts))
                    out[:, b] = bucket
                n = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), bands)
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(out.ravel().view(np.int64))], ["n", "bucket"])

    return rows.select("n", F.transform("terms", lambda t: F.xxhash64(t)).alias("h")).mapInArrow(sign, "n bigint, bucket bigint")


def _similar(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose sets have a Jaccard similarity of at least ``threshold``."""
    side = lambda c: rows.select(F.col("n").alias(c), F.col("terms").alias(f"terms_{c}"))
    both = pairs.distinct().join(side("u"), "u").join(side("v"), "v")
    common = F.size(F.array_intersect("terms_u", "terms_v"))
    return both.filter(common / (F.size("terms_u") + F.size("terms_v") - common) >= threshold).select("u", "v")


def _pairs_between(members: DataFrame, share: float, floor: int, block: int) -> DataFrame:
    """(u, v) of all ``members`` (bucket, n, root) of a bucket that differ in ``root``; large buckets go in blocks."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
    sizes = sizes.filter("low < high").select("bucket", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    hot = hot_keys(members, "bucket", members.count(), share, floor)
    rows = lookup(members, sizes, "bucket", ["blocks"], hot).filter("blocks is not null")
    own = F.pmod(F.xxhash64("n"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "n", "root")
    left, right = (rows.select("bucket", "i", "j", *(F.col(c).alias(f"{c}_{s}") for c in ("own", "n", "root"))) for s in "uv")
    # two members of one block meet where both blocks are theirs, others where the blocks are theirs
    met = left.join(right, ["bucket", "i", "j"]).filter("n_u < n_v and root_u <> root_v and (own_u <> own_v or i = j)")
    return met.select(F.col("n_u").alias("u"), F.col("n_v").alias("v"))


def cluster_sequences(sequences: DataFrame, threshold: float = 0.5, k: int = 3, bands: int | None = None, width: int | None = None, share: float = HOT_SHARE, floor: int = HOT_FLOOR, block: int = BLOCK) -> DataFrame:
    """(protein_id, cluster_id) of ``sequences`` (protein_id, sequence); the id is the least protein of the cluster.

    Equal k-mer sets are one. Within a bucket each sequence is first compared with the least member; then all others are
    compared that this has not brought into one cluster, so a bucket of related sequences costs one comparison each and
    no pair of a bucket that could join two clusters is passed over. ``width`` follows the number of sequences and ``bands``
    the threshold unless they are given. Sequences shorter than ``k`` are clusters of their own.
    """
    rows = dense_index(sequences.select("protein_id", F.array_distinct(kmers(F.col("sequence"), k)).alias("terms")), ["protein_id"], "n")
    rows = materialize(rows, "clustered")
    n_rows = rows.count()
    width = width_for(n_rows) if width is None else width
    bands = bands_for(threshold, width) if bands is None else bands
    keyed = rows.filter(F.size("terms") > 0).select("n", F.md5(F.concat_ws(" ", F.array_sort("terms"))).alias("key"))
    same = materialize(with_group_min(keyed, ["key"], "n", "first", hot_keys(keyed, key_hash("key"), n_rows, share, floor)).select("n", "first"), "same-terms")
    sets = materialize(rows.join(same.filter("n = first").select("n"), "n").select("n", "terms"), "term-sets")
    buckets = materialize(_buckets(sets, bands, width), "buckets")
    hot = hot_keys(buckets, key_hash("bucket"), buckets.count(), share, floor)
    members = materialize(with_group_min(buckets, ["bucket"], "n", "least", hot).filter("n <> least"), "bucket-members")
    near = materialize(_similar(members.select(F.col("n").alias("u"), F.col("least").alias("v")), sets, threshold), "near")
    known = members.join(connected_components(near, share, floor), F.col("n") == F.col("node"), "left")
    known = materialize(known.select("bucket", "n", F.coalesce("root", "n").alias("root")), "bucket-roots")
    far = _similar(_pairs_between(known, share, floor, block), sets, threshold)
    edges = near.unionByName(far).unionByName(same.filter("n <> first").select(F.col("n").alias("u"), F.col("first").alias("v")))
    roots = connected_components(edges, share, floor)
    named = rows.select("protein_id", "n").join(roots, F.col("n") == F.col("node"), "left").withColumn("root", F.coalesce("root", "n"))
    names = rows.select(F.col("n").alias("root"), F.col("protein_id").alias("cluster_id"))
    return named.join(names, "root").select("protein_id", "cluster_id")

"""Records that occur, exactly or nearly, on both sides of a train / evaluation cut."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import HOT_FLOOR, HOT_SHARE, grid_join, hot_keys, key_hash, with_group_min
from ..session import materialize

#: Rows of a class that meet as one part with those of another.
PART_ROWS = 1000


def band_plan(threshold: float, most_shingles: int | None = None, missed: float = 1e-3) -> tuple[int, int]:
    """(bands, rows of a band) that lose a pair of similarity ``threshold`` with probability ``missed`` at most.

    Where sets are so small that no similarity between ``threshold`` and 1 can occur, equal sets always share every
    bucket, so one long band loses nothing.
    """
    if most_shingles is not None and (most_shingles - 1) / most_shingles < threshold:
        return 1, 16
    bands = rows = 1
    for r in range(1, 33):
        b = 1
        while (1 - threshold**r) ** b > missed:
            b += 1
        if b > 40 and r > 1:  # one row a band takes the bands it needs, whatever their number
            break
        bands, rows = b, r
    return bands, rows


def _large_signature(bands: int, rows: int):
    """Minwise hashes of sets of any size, all hashes of a batch of sets at once."""

    @F.pandas_udf("array<bigint>")
    def sign(hashes: pd.Series) -> pd.Series:
        sizes = hashes.str.len().to_numpy()
        flat = np.concatenate(hashes.to_list()).astype(np.int64).astype(np.uint64) if len(hashes) else np.zeros(0, np.uint64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(hashes) else np.zeros(0, np.int64)
        out = np.zeros((len(hashes), bands), np.uint64)
        seeds = np.random.default_rng(20).integers(0, 2**63, bands * rows, np.uint64)
        with np.errstate(over="ignore"):
            for i, seed in enumerate(seeds):
                h = (flat ^ seed) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                least = np.minimum.reduceat(h ^ (h >> np.uint64(29)), starts) if len(hashes) else h
                b = i // rows
                out[:, b] = (out[:, b] * np.uint64(0xBF58476D1CE4E5B9) + least) ^ (out[:, b] >> np.uint64(31))
        return pd.Series(list(out.astype(np.int64)))

    return sign


def word_shingles(text: Column, width: int = 5) -> Column:
    """Hashes of all runs of ``width`` words (lower-case letters and digits); the one run of all words where there are
    fewer, none for null and wordless texts."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))

    def runs(w: Column) -> Column:
        whole = F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, width), " ")))
        return F.when(F.size(w) > width, F.array_distinct(each)).otherwise(whole)

    return F.get(F.transform(F.array(words), runs), F.lit(0))  # bound once: a lambda would cut the text again for each run


def signature(shingles: Column, bands: int, rows: int, most_shingles: int | None = None) -> Column:
    """One bucket per band: a hash of ``rows`` minwise hashes of the shingle set.

    Sets known to be small are hashed element by element in generated code, others by arrays in batches.
    """
    if most_shingles is not None and most_shingles <= 8:
        parts = [F.get(shingles, F.lit(k)) for k in range(most_shingles)]
        smallest = lambda i: F.least(F.lit(None).cast("bigint"), *(F.when(p.isNotNull(), F.xxhash64(p, F.lit(i))) for p in parts))
    else:
        return _large_signature(bands, rows)(F.transform(shingles, lambda s: F.xxhash64(s)))
    return F.array(*(F.xxhash64(F.lit(b), *(smallest(b * rows + r) for r in range(rows))) for b in range(bands)))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


class CrossSplitOverlap:
    """Overlaps between training rows and evaluation rows of ``rows`` (``row_id``, ``is_train``, ``shingles``, ...).

    Rows of equal sides and shingle sets are one class; minwise signatures are banded per class, only buckets that hold
    both a training and an evaluation class give candidates, and these are verified by exact Jaccard similarity. So
    copies meet as counts and are only unfolded where row pairs are asked for. Null or empty shingle sets overlap with
    nothing; other columns are carried along.
    """

    def __init__(
        self,
        rows: DataFrame,
        total: int,
        threshold: float = 0.8,
        most_shingles: int | None = None,
        share: float = HOT_SHARE,
        floor: int = HOT_FLOOR,
    ):
        rows = rows.filter(F.size("shingles") > 0).withColumn("shingles", F.array_sort(F.array_distinct("shingles")))
        self.share, self.floor, self.total = share, floor, total
        rows = materialize(rows, "overlap-rows")
        hot = hot_keys(rows, key_hash("is_train", "shingles"), total, share, floor)
        # every member knows the size of its class
        self.members = materialize(with_group_min(rows, ["is_train", "shingles"], "row_id", "class_id", hot, "class_rows"), "overlap-members")
        bands, width = band_plan(threshold, most_shingles)
        classes = self.members.filter("row_id = class_id").dropDuplicates(["class_id", "is_train"]).select(
            "class_id", "class_rows", "is_train", "shingles", F.posexplode(signature(F.col("shingles"), bands, width, most_shingles)).alias("band", "bucket")
        )
        side = lambda train, name: classes.filter(F.col("is_train") == train).select(
            "band", "bucket", F.col("class_id").alias(f"{name}_class"), F.col("class_rows").alias(f"n_{name}"), F.col("shingles").alias(f"{name}_shingles")
        )
        on = ["band", "bucket"]
        if bands == 1:  # a bucket is one set, so it holds one class of either side
            candidates = side(True, "train").join(side(False, "eval"), on)
        else:  # it may hold any number of classes on both sides
            classes = materialize(classes, "overlap-buckets")
            candidates = grid_join(side(True, "train"), side(False, "eval"), on, F.col("train_class"), F.col("eval_class"), PART_ROWS)
        confirmed = candidates.filter(jaccard(F.col("train_shingles"), F.col("eval_shingles")) >= threshold)
        confirmed = confirmed.select("train_class", "eval_class", "n_train", "n_eval")
        self.confirmed = materialize(confirmed.distinct() if bands > 1 else confirmed, "overlap-classes")

    def row_pairs(self) -> DataFrame:
        """(``train_id``, ``eval_id``) for every confirmed pair of rows.

        Classes are cut on both sides into parts of about PART_ROWS rows, and each pair of parts is a cell of its own, so
        a class of one row and one of 10^9 are unfolded by as many tasks as two large ones.
        """
        parts = lambda n: F.ceil(F.col(n) / PART_ROWS).cast("bigint")
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), parts(n) - 1))
        cells = self.confirmed.select("train_class", "eval_class", "n_eval", each("n_train").alias("train_part"))
        cells = cells.select("train_class", "eval_class", "train_part", each("n_eval").alias("eval_part"))
        member = lambda train, name: self.members.filter(F.col("is_train") == train).select(
            F.col("row_id").alias(f"{name}_id"), F.col("class_id").alias(f"{name}_class"),
            F.pmod(F.xxhash64("row_id"), parts("class_rows")).alias(f"{name}_part"),
        )
        # one class may meet any number of others, so its cells are spread as well; a part has twice PART_ROWS at most
        largest = self.confirmed.agg(F.max("n_train"), F.max("n_eval")).first()
        most = [min(n or 0, 2 * PART_ROWS) for n in largest]
        met = grid_join(cells, member(True, "train"), ["train_class", "train_part"], F.hash("eval_class", "eval_part"), F.col("train_id"), PART_ROWS, most[0])
        met = met.select("train_id", "eval_class", "eval_part")
        return grid_join(met, member(False, "eval"), ["eval_class", "eval_part"], F.col("train_id"), F.col("eval_id"), PART_ROWS, most[1]).select("train_id", "eval_id")

    def report(self, *by: str) -> DataFrame:
        """Per value of ``by`` of the evaluation row: evaluation rows that overlap, and pairs; nothing is unfolded."""
        matched = self.confirmed.groupBy("eval_class").agg(F.sum("n_train").alias("n_train"))
        rows = self.members.filter("not is_train").groupBy("class_id", *by).agg(F.count(F.lit(1)).alias("n"))
        joined = rows.join(matched, rows["class_id"] == matched["eval_class"])
        return joined.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") * F.col("n_train")).alias("n_pairs"))

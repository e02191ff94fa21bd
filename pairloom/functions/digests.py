"""Digests of rows and tables, and canonical JSON on the driver."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical_json(value: object) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def json_sha256(value: object) -> str:
    return hashlib.sha256(canonical_json(value)).hexdigest()


def file_sha256(path: str | Path) -> str:
    """Digest of a file, or of the data files of a folder in the order of their names."""
    path = Path(path)
    parts = sorted(p for p in path.iterdir() if p.name[0] not in "._") if path.is_dir() else [path]
    digest = hashlib.sha256()
    for part in parts:
        with open(part, "rb") as f:
            while block := f.read(1 << 20):
                digest.update(block)
    return digest.hexdigest()


def row_sha256(df: DataFrame, columns: Iterable[str]):
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def table_sha256(df: DataFrame, columns: Iterable[str]) -> str:
    """Digest of a table that doesn't depend on order or partitioning.

    Row digests (with their counts) are grouped by their first three characters and added up in each group, digit block
    by digit block; the 4096 sums are hashed on the driver. A sum does not depend on the order, so neither a sort nor a
    gathered table is needed, and unlike an exclusive or, it keeps every row.
    """
    columns = sorted(columns)
    rows = df.select(row_sha256(df, columns).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    keyed = rows.select(F.substring("h", 1, 3).alias("k"), F.concat_ws("*", "h", F.col("n").cast("string")).alias("x"))
    groups = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.conv(F.substring(F.sha2("x", 256), 1 + 15 * i, 15), 16, 10).cast("decimal(28,0)")).cast("string").alias(f"x{i}") for i in range(4)))
    parts = sorted(tuple(r) for r in groups.collect())
    return json_sha256({"columns": columns, "parts": [list(p) for p in parts]})


def content_checksum(df: DataFrame) -> int:
    """Order-independent 64-bit checksum; a quick look, no identity."""
    return df.agg(F.bit_xor(F.xxhash64(*df.columns))).first()[0] or 0

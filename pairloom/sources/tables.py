"""Delimited tables, read as text: separators by extension, compression, ZIP members, missing-value tokens."""

from __future__ import annotations

import lzma
import zipfile
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.pairs import ConstraintError, require_columns

# Separators by extension, compression suffixes, texts that mean a missing value.
SEPARATORS = {".csv": ",", ".tab": "\t", ".tsv": "\t", ".txt": "\t"}
COMPRESSED = (".bz2", ".gz", ".xz")
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def infer_separator(path: str) -> str:
    """By the extension, below a compression suffix; unknown ones are refused."""
    name = PurePosixPath(path)
    if name.suffix.lower() in COMPRESSED:
        name = name.with_suffix("")
    try:
        return SEPARATORS[name.suffix.lower()]
    except KeyError:
        raise ConstraintError(f"no separator is known for {path}") from None


def open_stream(path: str):
    """A seekable byte stream of a file on any file system that pyarrow knows (file, hdfs, s3, ...)."""
    import os
    import re

    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", path)
    system, inner = fs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri))
    return system.open_input_file(inner)


def zip_member(path: str, member: str | None) -> str:
    """The only file of an archive, or the one named."""
    with open_stream(path) as f, zipfile.ZipFile(f) as z:
        names = [i.filename for i in z.infolist() if not i.is_dir()]
    if member is None:
        if len(names) != 1:
            raise ConstraintError(f"{path} holds {names}; name one")
        return names[0]
    if member not in names:
        raise ConstraintError(f"{path} holds {names}, not {member}")
    return member


def _decoded_lines(spark: SparkSession, path: str, member: str | None, start: str | None = None) -> DataFrame:
    """Lines of files that Hadoop cannot decode (xz, ZIP members), streamed out by one task per file.

    With ``start``, lines are joined to records, each from a line that starts with it to the next such line; a record is
    all that is held at a time.
    """
    files = spark.read.format("binaryFile").load(path).select("path")

    def units(text):
        if start is None:
            for line in text:
                yield line.rstrip("\r\n")
            return
        held: list[str] = []
        for line in text:
            if line.startswith(start) and held:
                yield "\n".join(held)
                held = []
            held.append(line.rstrip("\r\n"))
        if held:
            yield "\n".join(held)

    def lines(batches):
        import io

        import pandas as pd

        for pdf in batches:
            for p in pdf["path"]:
                with open_stream(p) as stream:
                    raw = zipfile.ZipFile(stream).open(member) if member else lzma.open(stream)
                    rows: list[str] = []
                    with raw, io.TextIOWrapper(raw, "utf-8", newline="") as text:
                        for unit in units(text):
                            rows.append(unit)
                            if len(rows) == 20_000:
                                yield pd.DataFrame({"value": rows})
                                rows = []
                    yield pd.DataFrame({"value": rows})

    return files.mapInPandas(lines, "value string")


def read_table(
    spark: SparkSession, path: str, member: str | None = None, columns: Sequence[str] | None = None, limit: int | None = None
) -> DataFrame:
    """All columns as text, so ids keep their zeros; missing-value tokens are null. ``limit`` 0 reads the header only."""
    is_zip = path.lower().endswith(".zip")
    if member is not None and not is_zip:
        raise ConstraintError(f"{path} is no archive, but a member is named")
    inner = zip_member(path, member) if is_zip else path
    options = {"header": True, "sep": infer_separator(inner), "mode": "PERMISSIVE", "quote": '"', "escape": '"', "inferSchema": False}
    if is_zip or path.lower().endswith(".xz"):
        lines = _decoded_lines(spark, path, inner if is_zip else None)
        df = spark.read.options(**options).csv(lines.rdd.map(lambda r: r[0]))
    else:
        df = spark.read.options(**options).csv(path)
    if columns is not None:
        require_columns(df, columns)
        df = df.select(*columns)
    tokens = list(MISSING)
    df = df.select(*(F.when(~F.col(f"`{c}`").isin(tokens), F.col(f"`{c}`")).alias(c) for c in df.columns))
    return df if limit is None else df.limit(limit)


def header(spark: SparkSession, path: str, member: str | None = None) -> list[str]:
    return read_table(spark, path, member, limit=0).columns


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a file that is not there has no rows."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)

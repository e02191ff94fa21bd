"""FASTA files as tables; plain, gz, bz2 and xz."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import header_id, header_taxon
from ..operators.pairs import require_empty
from .tables import _decoded_lines


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(header, sequence, is_first): one row per record, cut at '>' after a line end, so files split between tasks."""
    if path.lower().endswith(".xz"):
        records = _decoded_lines(spark, path, None, ">").filter("trim(value) <> ''")
    else:
        records = spark.read.text(path, lineSep="\n>").filter("trim(value) <> ''")
    value = F.regexp_replace("value", r"\r", "")
    marked = records.select(F.regexp_replace(value, "^>", "").alias("body"), value.startswith(">").alias("marked"))
    cut = F.instr("body", "\n")
    head = F.when(cut > 0, F.substr("body", F.lit(1), cut - 1)).otherwise(F.col("body"))
    rest = F.when(cut > 0, F.substr("body", cut + 1)).otherwise("")
    return marked.select(F.trim(head).alias("header"), F.regexp_replace(rest, r"\s+", "").alias("sequence"), "marked")


def read_fasta(spark: SparkSession, path: str, id_format: str = "first_token", check: bool = True) -> DataFrame:
    """(protein_id, sequence, taxon_id). Repeated ids, blank headers, empty sequences and text before the first header
    are refused when ``check``."""
    records = read_records(spark, path)
    named = records.filter("header <> ''").select(
        header_id(F.col("header"), id_format).alias("protein_id"), "sequence", header_taxon(F.col("header")).alias("taxon_id")
    )
    if check:
        # only the first record of a file keeps its mark; without one the file starts with something else
        if records.limit(1).count() and not records.filter("marked").limit(1).count():
            require_empty(records.select("header"), "sequence before the first header")
        require_empty(records.filter("header = ''"), "blank header")
        require_empty(named.filter("sequence = ''").select("protein_id"), "empty sequence")
        require_empty(named.groupBy("protein_id").count().filter("count > 1"), "repeated id")
    return named

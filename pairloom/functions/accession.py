"""Accessions: reading them from endpoint spellings, and an order-preserving integer code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as decoration, and the accession format (two letters, five digits, one letter).
NOT_ALPHANUMERIC = r"[^\p{L}\p{Nd}]+"
ACCESSION = "[A-Z]{2}[0-9]{5}[A-Z]"


def alphanumeric(value: Column) -> Column:
    """Letters and digits of ``value`` in upper case; null stays null."""
    return F.upper(F.regexp_replace(value, NOT_ALPHANUMERIC, ""))


def accession_of(clean: Column) -> Column:
    """First accession in an already cleaned value, null if there is none."""
    # an array look-up, as nullif would evaluate the expressions below it twice, and again in every filter
    return F.get(F.regexp_extract_all(clean, F.lit(ACCESSION), F.lit(0)), F.lit(0))


def accession(value: Column) -> Column:
    """Accession named by a raw endpoint spelling, null if it names no protein."""
    return accession_of(alphanumeric(value))


def _letter(acc: Column, position: int) -> Column:
    return F.ascii(F.substring(acc, position, 1)).cast("bigint") - 65


def encode_accession(acc: Column) -> Column:
    """bigint whose numeric order is the alphabetical order of accessions."""
    head = _letter(acc, 1) * 26 + _letter(acc, 2)
    return (head * 100_000 + F.substring(acc, 3, 5).cast("bigint")) * 26 + _letter(acc, 8)


def decode_accession(code: Column) -> Column:
    rest = F.floor(code / 26).cast("bigint")
    head = F.floor(rest / 100_000).cast("bigint")
    return F.concat(
        F.char(F.floor(head / 26).cast("int") + 65),
        F.char((head % 26).cast("int") + 65),
        F.lpad((rest % 100_000).cast("string"), 5, "0"),
        F.char((code % 26).cast("int") + 65),
    )

"""Scalar functions on identifiers, headers and sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_sequence(sequence: Column) -> Column:
    """Without whitespace, in upper case."""
    return F.upper(F.regexp_replace(sequence, r"\s+", ""))


def sequence_sha256(sequence: Column) -> Column:
    return F.sha2(normalize_sequence(sequence), 256)


def prottrans_sequence(sequence: Column) -> Column:
    """Residues apart by spaces, rare ones as X."""
    return F.trim(F.regexp_replace(F.translate(normalize_sequence(sequence), "UZOB", "XXXX"), "(.)", "$1 "))


def header_id(header: Column, form: str = "first_token") -> Column:
    """Record id of a FASTA header without its >: the first token, or the accession of db|ACCESSION|NAME (else an error)."""
    token = F.nullif(F.element_at(F.split(F.trim(header), r"\s+"), 1), F.lit(""))
    if form == "first_token":
        return token
    if form != "uniprot_accession":
        raise ValueError(f"unknown header form {form!r}")
    inner = F.nullif(F.regexp_extract(token, r"^(?:sp|tr)\|([^|]+)\|", 1), F.lit(""))
    return F.coalesce(inner, F.raise_error(F.concat(F.lit("no accession in header "), header)).cast("string"))


def normalize_taxon(taxon: Column, strict: bool = False) -> Column:
    """Decimal taxon id of at least 1 without leading zeros; blank is null, anything else null or, if ``strict``, an error."""
    value = F.trim(taxon)
    digits = F.regexp_extract(value, r"^0*([1-9][0-9]*)$", 1)
    good = F.nullif(digits, F.lit(""))
    if not strict:
        return good
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(None).cast("string")).otherwise(
        F.coalesce(good, F.raise_error(F.concat(F.lit("bad taxon "), value)).cast("string"))
    )


def header_taxon(header: Column, strict: bool = True) -> Column:
    """Taxon of the OX= tokens of a header, null without any; different ones are an error."""
    tokens = F.filter(F.split(header, r"\s+"), lambda t: t.startswith("OX="))
    values = F.array_distinct(F.transform(tokens, lambda t: normalize_taxon(F.substr(t, F.lit(4)))))
    clash = F.raise_error(F.concat(F.lit("several taxa in header "), header)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(F.size(values) <= 1, F.get(values, F.lit(0))).otherwise(clash)


def safe_component(label: Column) -> Column:
    """Label fit for a path: other characters become _, outer dots and underscores go, nothing left is 'unnamed'."""
    clean = F.btrim(F.regexp_replace(label, r"[^A-Za-z0-9_.-]+", "_"), F.lit("._"))
    return F.when(F.coalesce(clean, F.lit("")) == "", "unnamed").otherwise(clean)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def domains_compatible(a: Column, b: Column, keys: Column) -> Column:
    """Whether any element of ``a`` and any of ``b`` form a key in ``keys``."""
    return F.exists(a, lambda x: F.exists(b, lambda y: F.array_contains(keys, pair_key(x, y))))


def random_sequence(length: Column, *seed: Column, alphabet: str = "ACDEFGHIKLMNPQRSTVWY") -> Column:
    """Residues drawn by a hash of seed and position."""
    letters = F.array(*(F.lit(c) for c in alphabet))
    pick = lambda i: F.get(letters, F.pmod(F.xxhash64(*seed, i), F.lit(len(alphabet))).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(1), length), pick), "")


def plant_motif(sequence: Column, motif: Column, position: Column) -> Column:
    """The motif over the residues from a 0-based position on."""
    return F.overlay(sequence, motif, position + 1)

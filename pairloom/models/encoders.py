"""Frozen sequence encoders: identity, length-sorted batches, a table of embeddings that is only ever added to."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import json_sha256
from ..functions.text import normalize_sequence, sequence_sha256
from ..operators.pairs import ConstraintError, require_empty

# Published encoders by short name (model, dimension, runs on a CPU).
PRESETS = {
    "esm2_8m": ("facebook/esm2_t6_8M_UR50D", 320, True),
    "esm2_35m": ("facebook/esm2_t12_35M_UR50D", 480, True),
    "esm2_150m": ("facebook/esm2_t30_150M_UR50D", 640, False),
    "esm2_650m": ("facebook/esm2_t33_650M_UR50D", 1280, False),
    "protbert": ("Rostlab/prot_bert", 1024, False),
    "prott5": ("Rostlab/prot_t5_xl_half_uniref50-enc", 1024, False),
}


@dataclass(frozen=True)
class EncoderSpec:
    """All that decides an embedding."""

    adapter: str
    model: str
    revision: str | None
    dimension: int
    pooling: str = "mean"  # the only one there is
    precision: str = "float32"
    max_residues: int | None = None

    def __post_init__(self) -> None:
        if self.pooling != "mean" or self.precision not in ("float32", "float16") or self.dimension < 1:
            raise ConstraintError(f"bad encoder {self}")

    @property
    def fingerprint(self) -> str:
        return json_sha256(asdict(self))

    @property
    def identity_strength(self) -> str:
        return "pinned" if self.revision and len(self.revision) == 40 else "named"

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


class Encoder(Protocol):
    spec: EncoderSpec

    def token_lengths(self, sequences: Sequence[str]) -> list[int]: ...

    def encode_batch(self, sequences: Sequence[str]): ...


class HashedKmerEncoder:
    """A small deterministic encoder that needs no weights: hashed k-mer counts, scaled to unit length."""

    def __init__(self, dimension: int = 64, k: int = 3):
        self.k, self.spec = k, EncoderSpec("hashed_kmers", f"k{k}", "0" * 40, dimension)

    def token_lengths(self, sequences: Sequence[str]) -> list[int]:
        return [len(s) for s in sequences]

    def encode_batch(self, sequences: Sequence[str]):
        import numpy as np
        import xxhash

        out = np.zeros((len(sequences), self.spec.dimension), "float32")
        for row, s in zip(out, sequences, strict=True):
            for i in range(len(s) - self.k + 1):
                h = xxhash.xxh64_intdigest(s[i : i + self.k])
                row[h % self.spec.dimension] += 1 if h >> 63 else -1
            row /= max(float(np.linalg.norm(row)), 1e-12)
        return out


def huggingface_encoder(preset: str, revision: str) -> Encoder:
    """A published encoder; needs transformers and torch, which are optional."""
    try:
        import torch
        from transformers import AutoModel, AutoTokenizer
    except ImportError as e:
        raise ConstraintError("published encoders need transformers and torch") from e
    name, dimension, _ = PRESETS[preset]
    tokenizer, model = AutoTokenizer.from_pretrained(name, revision=revision), AutoModel.from_pretrained(name, revision=revision).eval()

    class _Encoder:
        spec = EncoderSpec("huggingface", name, revision, dimension)
        spaced = "Rostlab" in name

        def _text(self, s: str) -> str:
            return " ".join(s.translate(str.maketrans("UZOB", "XXXX"))) if self.spaced else s

        def token_lengths(self, sequences):
            return [len(tokenizer(self._text(s))["input_ids"]) for s in sequences]

        def encode_batch(self, sequences):
            batch = tokenizer([self._text(s) for s in sequences], return_tensors="pt", padding=True, return_special_tokens_mask=True)
            special = batch.pop("special_tokens_mask").bool()
            with torch.inference_mode():
                hidden = model(**batch).last_hidden_state
            keep = (batch["attention_mask"].bool() & ~special).unsqueeze(-1)
            return ((hidden * keep).sum(1) / keep.sum(1).clamp(min=1)).float().numpy()

    return _Encoder()


def token_budget_batches(lengths: Sequence[int], most_padded_tokens: int, most_sequences: int) -> Iterator[list[int]]:
    """Positions in order of length, cut so that longest times number stays within the budget; one that exceeds it alone
    is a batch of its own."""
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    batch: list[int] = []
    for i in order:
        if batch and (len(batch) == most_sequences or lengths[i] * (len(batch) + 1) > most_padded_tokens):
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch


def residue_tokens(tokens: DataFrame) -> DataFrame:
    """(id, residue_index, token_index) from (id, special_mask): the tokens that stand for residues, in order."""
    kept = F.filter(F.transform("special_mask", lambda s, i: F.struct(i.alias("token_index"), s.alias("special"))), lambda t: ~t["special"])
    return tokens.select("id", F.posexplode(kept).alias("residue_index", "t")).select("id", "residue_index", F.col("t.token_index").alias("token_index"))


class EmbeddingTable:
    """Parquet table (fingerprint, sequence_sha256, embedding, embedding_sha256), partitioned by encoder; each embedding
    is written once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, spec: EncoderSpec) -> DataFrame:
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/fingerprint={spec.fingerprint}")
        if not jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jpath):
            return self.spark.createDataFrame([], "sequence_sha256 string, embedding array<float>, embedding_sha256 string")
        return self.spark.read.parquet(jpath.toString())

    def corrupt(self, spec: EncoderSpec) -> DataFrame:
        rows = self.read(spec)
        return rows.filter((F.sha2(F.to_json(F.struct("embedding")), 256) != F.col("embedding_sha256")) | (F.size("embedding") != spec.dimension))

    def encode(self, proteins: DataFrame, encoder: Encoder, most_padded_tokens: int = 1024, most_sequences: int = 8) -> DataFrame:
        """(protein_id, embedding): each distinct sequence is encoded once, ever. Embeddings with a wrong size or a value
        that is not finite are refused."""
        spec = encoder.spec
        rows = proteins.select("protein_id", normalize_sequence(F.col("sequence")).alias("sequence"), sequence_sha256(F.col("sequence")).alias("sequence_sha256"))
        require_empty(self.corrupt(spec).select("sequence_sha256"), "changed embeddings")
        new = rows.select("sequence_sha256", "sequence").dropDuplicates(["sequence_sha256"]).join(self.read(spec), "sequence_sha256", "left_anti")
        # sequences of like length go to one task, so that its batches need little padding
        ordered = new.repartitionByRange(F.length("sequence"), "sequence_sha256")

        def run(batches):
            import numpy as np
            import pandas as pd

            for pdf in batches:
                texts = pdf["sequence"].tolist()
                out = np.zeros((len(texts), spec.dimension), "float32")
                for part in token_budget_batches(encoder.token_lengths(texts), most_padded_tokens, most_sequences):
                    values = encoder.encode_batch([texts[i] for i in part])
                    if values.shape != (len(part), spec.dimension) or not np.isfinite(values).all():
                        raise ValueError("bad embedding")
                    out[part] = values
                yield pd.DataFrame({"sequence_sha256": pdf["sequence_sha256"], "embedding": list(out)})

        made = ordered.mapInPandas(run, "sequence_sha256 string, embedding array<float>")
        made = made.withColumn("embedding_sha256", F.sha2(F.to_json(F.struct("embedding")), 256))
        made.write.mode("append").parquet(f"{self.path}/fingerprint={spec.fingerprint}")
        return rows.join(self.read(spec), "sequence_sha256").select("protein_id", "embedding")

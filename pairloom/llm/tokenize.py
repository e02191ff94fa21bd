"""Corpus encoding with a public byte-level BPE vocabulary through a sentencepiece model built from it."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame

#: Longest pre-token kept in a worker's cache, and its number of entries; longer or further ones are encoded anew.
CACHE_CHARS, CACHE_SIZE = 48, 400_000

# Fixed value: the pre-token pattern that the published vocabulary was built with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed vocabulary files lie; every function takes another path as well."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> list[bytes]:
    """Byte strings of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def byte_alphabet() -> dict[int, str]:
    """A printable, space-free character for each byte: itself where it is one, else the next from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


def _field(number: int, wire: int, payload: bytes) -> bytes:
    return _varint(number << 3 | wire) + (_varint(len(payload)) + payload if wire == 2 else payload)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model: piece i is token i in the byte alphabet, scored by -i, without any
    normalisation; the unknown piece, which sentencepiece demands, comes last. Piece ids are the token ids."""
    letters = byte_alphabet()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(letters[b] for b in token).encode()
        out += _field(1, 2, _field(1, 2, piece) + _field(2, 5, struct.pack("<f", -float(rank))) + _field(3, 0, _varint(1)))
    out += _field(1, 2, _field(1, 2, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, _varint(2)))
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(len(tokens) + 1))  # BPE; vocabulary size
    trainer += _field(40, 0, _varint(len(tokens)))  # id of the unknown piece
    for number in (41, 42, 43):  # no begin, end and padding pieces
        trainer += _field(number, 0, _varint((1 << 64) - 1))
    normalizer = _field(1, 2, b"identity") + _field(3, 0, _varint(0)) + _field(4, 0, _varint(0)) + _field(5, 0, _varint(0))
    return bytes(out) + _field(2, 2, trainer) + _field(3, 2, normalizer)


class Encoder:
    """Encodes and decodes texts; null and empty texts have the empty list of ids."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self._sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._split = regex.compile(PATTERN).findall
        self._table = byte_alphabet()
        self._inverse = {ord(letter): b for b, letter in self._table.items()}
        self._cache: dict[str, list[int]] = {}

    def _mapped(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self._table)

    def encode(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        split = [self._split(t) if t else [] for t in texts]
        cache = self._cache
        new = list({p for pieces in split for p in pieces if p not in cache})
        fresh = dict(zip(new, self._sp.encode([self._mapped(p) for p in new], num_threads=1), strict=True)) if new else {}
        for pieces in split:
            ids: list[int] = []
            for p in pieces:
                known = cache.get(p)
                ids += fresh[p] if known is None else known
            yield ids
        if len(cache) + len(fresh) > CACHE_SIZE:
            cache.clear()
        cache.update((p, i) for p, i in fresh.items() if len(p) <= CACHE_CHARS)

    def decode(self, ids: list[int]) -> str:
        pieces = self._sp.id_to_piece(list(ids)) if ids else []
        return bytes(self._inverse[ord(c)] for p in pieces for c in p).decode()


def encode_documents(
    documents: DataFrame, doc_id: str, text: str, path: str | None = None, counts: bool = False, carry: Sequence[str] = ()
) -> DataFrame:
    """(``doc_id``, ``ids``) of every row, or (``doc_id``, ``n_tokens``) with ``counts``; whole texts, no special tokens.
    Columns named in ``carry`` come along.

    Null and empty texts have no tokens. Repeated ids and further columns don't matter: rows are encoded one by one,
    without a shuffle. The model travels to the workers once, as a broadcast of the fixed vocabulary.
    """
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(sentencepiece_model(read_ranks(path or vocabulary_path())))
    types = dict(documents.dtypes)

    def run(batches):
        import pyarrow as pa

        encoder = Encoder(model.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids = list(encoder.encode(part.column(1).to_pylist()))
                out = pa.array([len(i) for i in ids], pa.int64()) if counts else pa.array(ids, pa.list_(pa.int32()))
                kept = [part.column(0), *(part.column(2 + i) for i in range(len(carry)))]
                yield pa.RecordBatch.from_arrays([*kept, out], [doc_id, *carry, "n_tokens" if counts else "ids"])

    schema = ", ".join(f"{c} {types[c]}" for c in (doc_id, *carry))
    return documents.select(doc_id, text, *carry).mapInArrow(run, schema + (", n_tokens bigint" if counts else ", ids array<int>"))


def decode_documents(encoded: DataFrame, doc_id: str, path: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """(``doc_id``, ``text``, ``n_tokens``) from (``doc_id``, ``ids``): the exact text again; no ids are the empty text."""
    spark = encoded.sparkSession
    model = spark.sparkContext.broadcast(sentencepiece_model(read_ranks(path or vocabulary_path())))
    types = dict(encoded.dtypes)

    def run(batches):
        import pyarrow as pa

        encoder = Encoder(model.value)
        for batch in batches:
            ids = [i or [] for i in batch.column(1).to_pylist()]
            texts, sizes = pa.array([encoder.decode(i) for i in ids], pa.string()), pa.array([len(i) for i in ids], pa.int64())
            kept = [batch.column(0), *(batch.column(2 + i) for i in range(len(carry)))]
            yield pa.RecordBatch.from_arrays([*kept, texts, sizes], [doc_id, *carry, "text", "n_tokens"])

    schema = ", ".join(f"{c} {types[c]}" for c in (doc_id, *carry))
    return encoded.select(doc_id, "ids", *carry).mapInArrow(run, schema + ", text string, n_tokens bigint")

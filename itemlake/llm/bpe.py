"""Byte-level BPE through sentencepiece: the model is serialised from a rank file, then encodes pre-tokens."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from itemlake.llm.pretokens import PieceEncoder, binary, id_rows


def byte_symbols() -> list[str]:
    """A printable character for every byte: itself where it is one, else 256 + its number among the rest."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model: piece 0 is unknown, then the tokens by rank, scored by negative rank."""
    symbols = byte_symbols()
    order = sorted(ranks, key=ranks.__getitem__)
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, "".join(map(symbols.__getitem__, t)).encode()) + _field(2, float(-i)) + _field(3, 1) for i, t in enumerate(order)]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + b"".join(_field(k, (1 << 64) - 1) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """encode gives ranks as little-endian u32 bytes, decode the text's bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.ranks = ranks
        order = sorted(ranks, key=ranks.__getitem__)
        self.of_piece = np.array([0, *(ranks[t] for t in order)], np.uint32)  # piece id to rank
        self.table = {b: s for b, s in enumerate(byte_symbols())}
        self.tokens = dict(zip(ranks.values(), ranks, strict=True))
        self.encoder = PieceEncoder(self.pattern.findall, self.encode_pieces)

    def encode_pieces(self, pieces: list[str]) -> list:
        """Ranks of each pre-token: those in the vocabulary whole, as the rank files are meant, the others by merges."""
        out: list = [None] * len(pieces)
        at, keys = [], []
        for i, piece in enumerate(pieces):
            raw = piece.encode()
            if (rank := self.ranks.get(raw)) is not None:
                out[i] = (rank,)
            else:
                at.append(i)
                keys.append(raw.decode("latin-1").translate(self.table))
        for i, ids in zip(at, self.model.encode(keys, out_type=int, num_threads=1) if keys else [], strict=True):
            out[i] = self.of_piece[ids].tolist()
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encoder.encode(text) if text else b""

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One per worker process."""
    return Codec(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (doc_id unless told) and ids: each row's text as little-endian u32 token ranks.

    ranks_path is a rank file that every executor has. Null text counts as empty and has no ids;
    texts that spell special tokens are ordinary; repeated rows each give a row, an empty table
    none. Long texts are encoded in chunks cut where a pre-token must begin.
    """
    keep = ["doc_id"] if keep is None else keep

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in it:
            for lo, hi, ids, rows in c.encoder.encode_column(b.column(0)):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], id_rows(ids, rows).cast(pa.binary())], [*keep, "ids"])

    rows = docs.select(F.col("text").cast("string").alias("text"), *[F.col(k) for k in keep])
    schema = docs.select(*keep).schema.add("ids", "binary")
    return rows.mapInArrow(batches, schema)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """encoded (with ids) and decoded: the bytes of the ids; null ids decode to nothing."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in it:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                out = binary([c.decode(x or b"") for x in part.column("ids").to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(batches, StructType([*encoded.schema.fields, StructField("decoded", BinaryType())]))

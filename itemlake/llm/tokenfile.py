"""Token files: interleaved static rANS blocks under one frequency table a file, with checkpoints and checksums.

Layout: magic; the blocks' 32-bit words; a footer (zlib): frequency table, document ids and lengths,
and for each block its offset, tokens, words, CRC-32 and the lanes' states, which are the checkpoint
a decoder starts from; then the footer's length and CRC-32, and the magic again.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itemlake.llm.files import make_folder, open_store, write_atomically
from itemlake.llm.pretokens import PieceEncoder, binary
from itemlake.plans.scratch import materialise

MAGIC = b"RANSTOK1"
LANES, BLOCK_TOKENS, SCALE = 1024, 1 << 18, 20
#: Tokens below this are counted and looked up in arrays as long as the largest.
_DENSE = 1 << 22
_LOW = np.uint64(1 << 31)
U = np.uint64


def frequency_table(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, frequencies): every symbol that occurs, frequencies of at least 1 that sum to 2**SCALE."""
    if len(tokens) and tokens.max() < _DENSE:
        counts = np.bincount(tokens)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
    else:
        symbols, counts = np.unique(tokens, return_counts=True)
    if not len(symbols):
        return symbols.astype(np.uint32), np.zeros(0, np.uint32)
    if len(symbols) > 1 << SCALE:
        raise ValueError(f"more than {1 << SCALE} different tokens in a file")
    share = np.maximum(1, counts * (1 << SCALE) // counts.sum())
    rest = (1 << SCALE) - int(share.sum())
    order = np.argsort(-counts, kind="stable")
    if rest >= 0:
        share[order[0]] += rest
    else:  # take from the largest, none below 1
        for i in order:
            take = min(-rest, int(share[i]) - 1)
            share[i] -= take
            rest += take
            if not rest:
                break
    return symbols.astype(np.uint32), share.astype(np.uint32)


def encode_block(index: np.ndarray, freq: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(states, words) of token indexes dealt to LANES lanes in turn."""
    n = len(index)
    x = np.full(LANES, _LOW, U)
    out = []
    for t in range((n + LANES - 1) // LANES - 1, -1, -1):
        i = index[t * LANES : (t + 1) * LANES]
        f, v = freq[i], x[: len(i)]
        full = np.flatnonzero(v >= f << U(63 - SCALE))
        if len(full):
            out.append((v[full] & U(0xFFFFFFFF)).astype("<u4")[::-1])
            v[full] >>= U(32)
        q = v // f
        x[: len(i)] = (q << U(SCALE)) + (v - q * f) + start[i]
    words = np.concatenate(out)[::-1] if out else np.zeros(0, "<u4")
    return x, words


def decode_block(states: np.ndarray, words: np.ndarray, n: int, slot_index: np.ndarray, freq: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Token indexes; raises if the stream doesn't end as it began."""
    x, at, out = states.copy(), 0, np.empty(n, np.int32)
    for t in range((n + LANES - 1) // LANES):
        k = min(LANES, n - t * LANES)
        v = x[:k]
        slot = v & U((1 << SCALE) - 1)
        i = slot_index[slot.astype(np.int64)]
        out[t * LANES : t * LANES + k] = i
        v = freq[i] * (v >> U(SCALE)) + slot - start[i]
        low = np.flatnonzero(v < _LOW)
        if len(low):
            v[low] = (v[low] << U(32)) | words[at : at + len(low)]
            at += len(low)
        x[:k] = v
    if at != len(words) or (x != _LOW).any():
        raise ValueError("a block doesn't decode to its start")
    return out


def file_bytes(doc_ids: list[int | None], lengths: np.ndarray, tokens: np.ndarray) -> Iterator[bytes]:
    """The chunks of a file of whole documents, in the order given."""
    symbols, share = frequency_table(tokens)
    freq = share.astype(U)
    start = np.cumsum(freq) - freq
    at, blocks = len(MAGIC), []
    yield MAGIC
    rank = None
    if len(symbols) and symbols[-1] < _DENSE:
        rank = np.zeros(int(symbols[-1]) + 1, np.int32)
        rank[symbols] = np.arange(len(symbols))
    for i in range(0, len(tokens), BLOCK_TOKENS):
        part = tokens[i : i + BLOCK_TOKENS]
        states, words = encode_block(np.searchsorted(symbols, part) if rank is None else rank[part], freq, start)
        raw = words.astype("<u4").tobytes()
        blocks.append(struct.pack("<QIII", at, len(part), len(words), zlib.crc32(raw)) + states.astype("<u8").tobytes())
        yield raw
        at += len(raw)
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    body = [symbols.astype("<u4"), share.astype("<u4"), ids, known, lengths.astype("<u8")]
    raw = struct.pack("<IIIIII", SCALE, LANES, BLOCK_TOKENS, len(symbols), len(ids), len(blocks)) + b"".join(x.tobytes() for x in body) + b"".join(blocks)
    foot = zlib.compress(raw, 1)
    yield foot
    yield struct.pack("<QI", len(foot), zlib.crc32(foot)) + MAGIC


class TokenFile:
    """A file's footer, and its blocks on demand."""

    def __init__(self, uri: str, size: int):
        store, path = open_store(uri)
        self.uri, self.file = uri, store.open_input_file(path)
        n, crc = struct.unpack("<QI", (tail := self.file.read_at(20, size - 20))[:12])
        foot = self.file.read_at(n, size - 20 - n)
        if tail[12:] != MAGIC or zlib.crc32(foot) != crc:
            raise ValueError(f"{uri}: not a whole token file")
        raw = memoryview(zlib.decompress(foot))
        scale, lanes, self.block_tokens, n_symbols, n_docs, n_blocks = struct.unpack_from("<IIIIII", raw)
        if (scale, lanes) != (SCALE, LANES):
            raise ValueError(f"{uri}: written with other parameters")
        at = 24

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, kind, count, at)
            at += got.nbytes
            return got

        self.symbols, self.share = take("<u4", n_symbols), take("<u4", n_symbols)
        self.doc_ids, self.known, self.lengths = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs).astype(np.int64)
        self.blocks = []
        for _ in range(n_blocks):
            self.blocks.append((*struct.unpack_from("<QIII", raw, at), np.frombuffer(raw, "<u8", LANES, at + 20)))
            at += 20 + 8 * LANES
        self.n_tokens = int(self.lengths.sum())
        self.tables = None

    def block(self, i: int) -> np.ndarray:
        if self.tables is None:
            freq = self.share.astype(U)
            self.tables = np.repeat(np.arange(len(freq), dtype=np.int32), self.share), freq, np.cumsum(freq) - freq
        offset, n, n_words, crc, states = self.blocks[i]
        raw = self.file.read_at(4 * n_words, offset)
        if zlib.crc32(raw) != crc:
            raise ValueError(f"{self.uri}: block {i} is damaged")
        return self.symbols[decode_block(states, np.frombuffer(raw, "<u4"), n, *self.tables)]

    def documents(self, first: int, last: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, tokens) of documents that start in blocks first..last-1, and of those without tokens there."""
        ends = np.cumsum(self.lengths)
        starts = ends - self.lengths
        lo, hi = first * self.block_tokens, last * self.block_tokens
        final = last >= len(self.blocks)
        mine = np.flatnonzero((starts >= lo) & ((starts < hi) | final))
        have, at = np.zeros(0, np.uint32), None
        block = first
        for d in mine:
            s, e = int(starts[d]), int(ends[d])
            if at is None:
                block, at = s // self.block_tokens, s // self.block_tokens * self.block_tokens
            parts = [have]
            while at + sum(map(len, parts)) < e:
                parts.append(self.block(block))
                block += 1
            have = np.concatenate(parts) if len(parts) > 1 else have
            yield (int(self.doc_ids[d]) if self.known[d] else None), s, have[s - at : e - at]
            if e - at > self.block_tokens:
                have, at = have[e - at :], e


#: The pre-tokens of the tokenizers library's ByteLevel pattern (a fixed value).
_BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def tokenizer_encoder(path: str) -> PieceEncoder:
    """A cached encoder over a byte-level BPE file of the tokenizers library; its special tokens' strings are ordinary text.

    Files that normalise, add a space or split otherwise raise ValueError.
    """
    import regex
    from tokenizers import Tokenizer

    from itemlake.llm.bpe import byte_symbols

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    split = told.get("pre_tokenizer") or {}
    if told.get("normalizer") or told["model"]["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError(f"{path}: not a plain byte-level BPE file")
    tokenize, table = Tokenizer.from_file(path).model.tokenize, dict(enumerate(byte_symbols()))
    symbols = lambda p: "Ġ" + p[1:] if p[0] == " " and p[1:].isascii() and p[1:].isalpha() else p.encode().decode("latin-1").translate(table)

    return PieceEncoder(regex.compile(_BYTE_LEVEL).findall, lambda pieces: [[t.id for t in tokenize(symbols(p))] for p in pieces], 900_000)


@lru_cache(2)
def added_tokens(path: str):
    """The file's tokenizer, and a pattern (RE2) that finds a string of its added tokens (None if it has none)."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    known = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values() if t.content), key=len, reverse=True)
    return tokenizer, "|".join("".join(c if c.isalnum() or ord(c) > 127 else f"\\x{ord(c):02x}" for c in t) for t in known) if known else None


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, file_tokens: int = 4 << 20, match_added: bool = False) -> DataFrame:
    """Encode every row's text, append end_id, write token files in ascending doc_id order; returns the manifest.

    Rows are range-partitioned and sorted by doc_id (then text), nulls first, and a partition writes
    files of whole documents with about file_tokens tokens each, named in that order. A file's
    frequency table counts all its tokens. Null text counts as empty and has the end id only;
    repeated rows are repeated documents; an empty table leaves an empty folder. Other columns, whatever their names, are ignored.
    With match_added the strings of the file's added tokens are those tokens, as in Tokenizer.encode;
    otherwise they are ordinary text.
    """
    make_folder(folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, number = TaskContext.get(), 0
        encoder = tokenizer_encoder(tokenizer_path)
        tokenizer, added = added_tokens(tokenizer_path) if match_added else (None, None)
        ids, lengths, held, size = [], [], [], 0

        def flush():
            nonlocal ids, lengths, held, size, number
            path = f"{folder}/part-{context.partitionId():06d}-{number:06d}.ranstok"
            n = write_atomically(path, str(context.taskAttemptId()), file_bytes(ids, np.concatenate(lengths), np.concatenate(held)))
            row = pa.RecordBatch.from_pydict({"path": [path], "documents": [len(ids)], "tokens": [size], "bytes": [n]})
            ids, lengths, held, size, number = [], [], [], 0, number + 1
            return row

        def documents():
            """Runs of (ids, lengths, tokens with end ids)."""
            for batch in batches:
                names, texts = batch.column(0).to_pylist(), batch.column(1)
                special = pc.match_substring_regex(texts, added) if added else None
                if special is None or not pc.any(special).as_py():
                    for lo, hi, tokens, rows in encoder.encode_column(texts, 8 << 20):
                        yield names[lo:hi], np.diff(rows) + 1, np.insert(tokens, rows[1:], end_id)
                    continue
                for i, whole in enumerate(special.to_pylist()):
                    if whole:
                        tokens = np.array([*tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, end_id], np.uint32)
                    else:
                        tokens = np.concatenate([*(x[2] for x in encoder.encode_column(texts.slice(i, 1))), [end_id]]).astype(np.uint32)
                    yield [names[i]], np.array([len(tokens)]), tokens

        for names, sizes, tokens in documents():
            at = 0
            ends = np.cumsum(sizes)
            while at < len(names):
                done = int(ends[at - 1]) if at else 0
                stop = min(len(names), int(np.searchsorted(ends, done + file_tokens - size)) + 1)
                ids += names[at:stop]
                lengths.append(sizes[at:stop])
                held.append(tokens[done : ends[stop - 1]])
                size += int(ends[stop - 1]) - done
                at = stop
                if size >= file_tokens:
                    yield flush()
        if ids:
            yield flush()

    return materialise(rows.mapInArrow(put, "path string, documents long, tokens long, bytes long"), "token-manifest")


def read_tokens(spark: SparkSession, folder: str, blocks_a_task: int = 8) -> DataFrame:
    """doc_id, start, tokens (binary, little-endian u32) of every document in folder's files, in parallel from the checkpoints.

    start counts the tokens of all documents before, files in the order of their names. A task owns
    the documents that start in its blocks and reads on to their ends. Damaged files raise. Null ids
    stay null, null and empty texts have their end id; a folder without token files gives no row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ranstok").load(folder).select("path", "length")

    def footers(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = TokenFile(path, size)
                yield pa.RecordBatch.from_pydict({"path": [path], "length": [size], "n_blocks": [len(f.blocks)], "n_tokens": [f.n_tokens]})

    sizes = files.mapInArrow(footers, "path string, length long, n_blocks long, n_tokens long")
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    groups = sizes.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select(
        "path", "length", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_blocks") - 1, F.lit(0)), F.lit(blocks_a_task).cast("long"))).alias("first")
    )
    groups = groups.repartition(max(spark.sparkContext.defaultParallelism * 4, 8), "path", "first")

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for path, size, base, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out, held = [], 0
                for doc_id, start, tokens in TokenFile(path, size).documents(first, first + blocks_a_task):
                    out.append((doc_id, base + start, tokens.astype("<u4").tobytes()))
                    held += tokens.nbytes
                    if held > 4 << 20:
                        yield _rows(out)
                        out, held = [], 0
                if out:
                    yield _rows(out)

    return groups.mapInArrow(decode, "doc_id long, start long, tokens binary")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    ids, starts, tokens = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), binary(list(tokens))], ["doc_id", "start", "tokens"])

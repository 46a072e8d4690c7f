"""Removal of passages that an earlier document holds, by a greedy relative Lempel-Ziv parse over indexed blocks.

Every document is cut into blocks whose borders depend on its words alone: each window of WINDOW
words has an anchor, the GRAM-word gram in it with the smallest hash, and the windows that follow
one another with one anchor make a block of WINDOW words and more. All blocks of all documents
are indexed by the hash of their words, with their first place: the smallest document that holds
them, and where. A document is parsed from left to right against that index: a factor starts at the
first block that an earlier document holds and is extended block by block as long as the blocks
continue one another in that document; then the next factor starts behind it. Where a factor may
begin or end inside a block, which is where the block's anchor has other blocks in the index, the
parse goes on window by window, so that borders are at exactly the right word and no window
across a border is missed. Factors are WINDOW words long or more before they are cut where they
overlap, and cover the duplicate spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlake.llm.textarrays import all_spans, slices, span_hash, span_prefix, words
from itemlake.plans.scratch import materialise

WINDOW, GRAM = 50, 10
_REACH = WINDOW - GRAM + 1  # grams in a window
_AT_BITS = 24
_CHUNK = 1 << 22  # words looked at together


def _anchors(gram: np.ndarray) -> np.ndarray:
    """For each window of _REACH grams, the position of the (leftmost) smallest; hashes are cut to 40 bits here."""
    mask = np.uint64((1 << _AT_BITS) - 1)
    low = (gram & ~mask) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while 2 * width <= _REACH:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = _REACH - width
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    return (low & mask).astype(np.int64)


def _chunks(n: int) -> Iterator[tuple[int, int]]:
    """Ranges of words that overlap by WINDOW - 1."""
    at = 0
    while at == 0 or at + WINDOW <= n:
        yield at, min(n, at + _CHUNK)
        at += _CHUNK - WINDOW + 1


def pack(tag: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A text's tag (27 bits), a word (30 bits) and a count of windows (6 bits) in a long."""
    return (tag.astype(np.int64) & ((1 << 27) - 1)) << 36 | start.astype(np.int64) << 6 | n.astype(np.int64)


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 36, at >> 6 & ((1 << 30) - 1), at & 63


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, text) to (doc_id, anchor, rh, rx, at): every block of every document."""
    for batch in it:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        tags = batch.column(1).to_numpy(zero_copy_only=False)
        for s in slices(batch.column(2)):
            w = words(s)
            hashes, others = w.hashes(s.data), w.hashes(s.data, "other")
            for lo, hi in _chunks(len(hashes)):
                h, row = hashes[lo:hi], w.row[lo:hi]
                m = len(h) - WINDOW + 1
                if m <= 0:
                    continue
                gram = all_spans(h, "a", GRAM)
                p = _anchors(gram)
                inside = row[:m] == row[WINDOW - 1 :]
                new = inside.copy()
                new[1:] &= (p[1:] != p[:-1]) | ~inside[:-1]
                start = np.flatnonzero(new)
                if not len(start):
                    continue
                stop = np.flatnonzero(new | ~inside)  # where a block has ended by
                after = np.append(stop, m)[np.searchsorted(stop, start, side="right")]
                n = after - start
                a, b = span_prefix(h, "a"), span_prefix(others[lo:hi], "b")
                size = n + WINDOW - 1
                r = row[start]
                at = pack(tags[s.first + r], start + lo - w.first[r], n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[s.first + r]), _signed(gram[p[start]]), _signed(span_hash(a, "a", start, size)), _signed(span_hash(b, "b", start, size)), pa.array(at)],
                    ["doc_id", "anchor", "rh", "rx", "at"],
                )


def _windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, text, blocks) to (doc_id, rh, rx, at): each window of the blocks listed."""
    for batch in it:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        tags = batch.column(1).to_numpy(zero_copy_only=False)
        lists = batch.column(3)
        for s in slices(batch.column(2)):
            w = words(s)
            a, b = span_prefix(w.hashes(s.data), "a"), span_prefix(w.hashes(s.data, "other"), "b")
            start, row = [], []
            for r in range(s.last - s.first):
                tag, first, n = unpack(lists[s.first + r].values.to_numpy(zero_copy_only=False))
                mine = tag == tags[s.first + r]
                first, n = first[mine], n[mine]
                if len(n):
                    each = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                    start.append(each + w.first[r])
                    row.append(np.full(len(each), r))
            if start:
                at, r = np.concatenate(start), np.concatenate(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[s.first + r]), _signed(span_hash(a, "a", at, WINDOW)), _signed(span_hash(b, "b", at, WINDOW)), pa.array(pack(tags[s.first + r], at - w.first[r], np.ones(len(at), np.int64)))],
                    ["doc_id", "rh", "rx", "at"],
                )


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).bitwiseAND((1 << 27) - 1).alias("tag"), text.alias("text"))


def _copied(blocks: DataFrame, first: DataFrame) -> DataFrame:
    """Blocks that a smaller document holds: doc_id, tag, at, and the source's id and at."""
    found = blocks.join(first.select("rh", "rx", F.col("first.doc_id").alias("source"), F.col("first.at").alias("source_at")), ["rh", "rx"])
    return found.filter("source < doc_id").select("doc_id", F.shiftrightunsigned("at", 36).alias("tag"), "at", "source", "source_at")


def block_matches(docs: DataFrame) -> DataFrame:
    """doc_id, tag, at, source, source_at (see pack): blocks and windows whose words also start in the document source, the smallest one.

    Only blocks whose anchor occurs in two documents are looked at further. First places are
    map-side minima; a block equal to an earlier document's is one match, and of the others with a
    shared anchor only the first of each distinct block goes on to single windows, so that exact
    copies, however many, cost a row each. The blocks are made twice rather than stored; the
    texts are dealt by doc_id once, in an exchange that drop_copied reuses.
    """
    texts = _texts(docs).filter("doc_id is not null")
    blocks = texts.mapInArrow(_blocks, "doc_id long, anchor long, rh long, rx long, at long")
    shared = blocks.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor")
    shared = materialise(shared, "shared-anchors")  # so that both sides of the join are plain exchanges, which AQE splits at a hot anchor
    blocks = materialise(blocks.join(shared, "anchor", "left_semi"), "shared-blocks")
    place = F.min(F.struct("doc_id", "at")).alias("first")
    index = materialise(blocks.groupBy("rh", "rx").agg(place, F.max("doc_id").alias("last_doc"), F.min("anchor").alias("anchor")), "blocks-by-words")
    variants = index.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants"), F.min("first.doc_id").alias("lo"), F.max("first.doc_id").alias("hi"))
    variants = materialise(variants.filter("variants > 1 and lo < hi").select("anchor", "variants"), "variants")
    index = materialise(index.join(variants, "anchor", "left").drop("anchor"), "index")
    whole = _copied(blocks, index.filter("first.doc_id < last_doc"))
    edge = index.filter("variants > 1").select(F.col("first.doc_id").alias("doc_id"), F.col("first.at").alias("at"))
    listed = edge.groupBy("doc_id", F.shiftrightunsigned("at", 36).alias("tag")).agg(F.collect_list("at").alias("blocks"))  # at most a document's blocks
    windows = texts.join(listed, ["doc_id", "tag"]).select("doc_id", "tag", "text", "blocks").mapInArrow(_windows, "doc_id long, rh long, rx long, at long")
    first = windows.groupBy("rh", "rx").agg(place, F.max("doc_id").alias("last_doc")).filter("first.doc_id < last_doc")
    return whole.unionByName(_copied(windows, first))


def parse(at: np.ndarray, source: np.ndarray, source_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, words, source, start in the source) of the factors of one document, from its matches."""
    _, start, n = unpack(at)
    _, begin, _ = unpack(source_at)
    order = np.lexsort((source, start))
    start, n, source, shift = start[order], n[order], source[order], (begin - start)[order]
    goes_on = (start[1:] <= start[:-1] + n[:-1]) & (source[1:] == source[:-1]) & (shift[1:] == shift[:-1])
    new = np.flatnonzero(np.append(True, ~goes_on))
    end = np.maximum.reduceat(start + n, new) + WINDOW - 1
    behind = np.append(0, np.maximum.accumulate(end)[:-1])  # a factor starts behind those before it
    left = np.maximum(start[new], behind)
    keep = left < end
    return left[keep], (end - left)[keep], source[new][keep], (left + shift[new])[keep]


_FACTORS = "array<struct<start:bigint,n_words:bigint,source:bigint,source_start:bigint>>"


def copy_factors(docs: DataFrame) -> DataFrame:
    """doc_id, tag (27 bits of the text's hash), factors: the copy factors of every document that has some, from left to right.

    A factor's start and source_start are words (from 0) of the document and of the document source,
    n_words its length. Factors don't overlap; what lies between them is literal.
    """
    found = block_matches(docs).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("at", "source", "source_at")).alias("m"))  # at most a document's windows

    def factor(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for r in range(batch.num_rows):
                m = batch.column(2)[r].values
                out.append(parse(*(m.field(k).to_numpy(zero_copy_only=False) for k in range(3))))
            if out:
                ends = np.append(0, np.cumsum([len(x[0]) for x in out])).astype(np.int32)
                kinds = ["start", "n_words", "source", "source_start"]
                rows = pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], kinds)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), rows)], ["doc_id", "tag", "factors"])

    return found.mapInArrow(factor, f"doc_id long, tag long, factors {_FACTORS}")


def drop_copied(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with_text, kept_text: each row's words without those of its copy factors.

    kept_text joins the kept words by one space. A window that no earlier document holds is never
    touched, whatever else of the document goes. Null text has no words; null ids are neither
    earlier nor later than others, so they lose nothing; rows that repeat an id don't remove from
    one another; texts of less than WINDOW words lose nothing; an empty table gives no row. Other
    columns are ignored.
    """
    spans = copy_factors(docs).select("doc_id", "tag", F.col("factors.start").alias("starts"), F.col("factors.n_words").alias("sizes"))
    rows = _texts(docs).filter("doc_id is not null").join(spans, ["doc_id", "tag"], "left").select("doc_id", "tag", "text", "starts", "sizes")
    none = F.lit(None).cast("array<long>")
    rows = rows.unionByName(_texts(docs).filter("doc_id is null").withColumns({"starts": none, "sizes": none}))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            starts, sizes, out = batch.column(3), batch.column(4), []
            for s in slices(batch.column(2)):
                w = words(s)
                raw = s.data.tobytes()
                for r in range(s.last - s.first):
                    n = int(w.first[r + 1] - w.first[r])
                    text = raw[s.offsets[r] : s.offsets[r + 1]].split()
                    gone = 0
                    if starts[s.first + r].is_valid:
                        keep, at = [], 0
                        for start, size in zip(starts[s.first + r].as_py(), sizes[s.first + r].as_py(), strict=True):
                            keep += text[at:start]
                            at = start + size
                            gone += size
                        text = keep + text[at:]
                    kept = b" ".join(text)
                    out.append((n, gone, hashlib.sha256(kept).hexdigest(), *([kept.decode()] if with_text else [])))
            if out:
                types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]
    return rows.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else ""))

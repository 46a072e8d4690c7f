"""Ranked lexical search: documents grouped by the terms they share with an item, groups by falling bound."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itemlake.llm.textarrays import U, Slice, slices, words
from itemlake.plans.scratch import materialise

#: Terms are runs of ASCII letters and digits and of all bytes above; A-Z are lower-cased, all else parts them.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 256)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _FOLD[_c] = _c
_FOLD[65:91] = np.arange(97, 123)
#: Postings of a block of documents whose terms a task holds as arrays, and documents scored at first.
_BLOCK, _FIRST = 1 << 21, 64
_NO_ID = np.iinfo(np.int64).max


def _folded(s: Slice) -> Slice:
    return Slice(s.first, s.last, _FOLD[s.data], s.offsets)


def item_terms(text: str | None) -> Counter:
    """Terms of one item with their repeats."""
    return Counter(_FOLD[np.frombuffer((text or "").encode(), np.uint8)].tobytes().split())


class Vocabulary:
    """The distinct terms of a block of items, found in texts by hash and then compared byte by byte."""

    def __init__(self, terms: list[bytes]):
        self.terms = terms
        raw = np.frombuffer(b" ".join(terms), np.uint8)
        s = Slice(0, 1, raw, np.array([0, len(raw)]))
        h = words(s).hashes(raw)
        order = np.argsort(h, kind="stable")
        self.hashes, self.ids = h[order], order
        self.width = np.array([len(t) for t in terms], np.int64)
        self.bytes = {n: np.zeros((len(terms), n), np.uint8) for n in set(self.width.tolist())}
        for i, t in enumerate(terms):
            self.bytes[len(t)][i] = np.frombuffer(t, np.uint8)

    def find(self, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(terms per row, and of the words in the vocabulary: row, term number)."""
        w = words(s)
        total = np.diff(w.first)
        h = w.hashes(s.data)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        term, start, row = self.ids[at[hit]], w.start[hit], w.row[hit]
        size = w.end[hit] - start
        same = size == self.width[term]
        for n, known in self.bytes.items():
            of = np.flatnonzero(same & (size == n))
            for k in range(n):
                same[of] &= s.data[start[of] + k] == known[term[of], k]
        return total, row[same], term[same]


def postings(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n (terms with repeats), terms (rising numbers), tfs of every row of docs that has a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by ranked's item_block
    schema = "doc_id long, n long, terms array<int>, tfs array<int>"

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in it:
            for s in slices(batch.column(1)):
                total, row, term = v.find(_folded(s))
                pair, tf = np.unique(row * len(v.terms) + term, return_counts=True)
                some = np.flatnonzero(total > 0)
                row = pair // len(v.terms)
                offsets = np.append(np.searchsorted(row, some), len(row)).astype(np.int32)
                terms = pa.array((pair % len(v.terms)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(pa.array(offsets), x) for x in (terms, pa.array(tf.astype(np.int32)))]
                ids = batch.column(0).slice(s.first, s.last - s.first).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([ids, pa.array(total[some]), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(find, schema)


class _Best:
    """The k best (score, id) of one item so far; equal scores by rising id."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A document must reach this score to come in."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        on = score >= self.least
        score, ids = np.append(self.score, score[on]), np.append(self.id, ids[on])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]


class Block:
    """Postings of some documents by term, each with its saturation under the corpus statistics."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, stats: tuple[int, int]):
        total, length = stats
        self.ids = ids
        m = 25 + (75 * n * total) // length
        order = np.argsort(term, kind="stable")  # rows stay rising within a term
        self.row = row[order]
        self.sat = 1_000_000_000 * tf[order] // (1000 * tf[order] + 8 * m[self.row])
        term = term[order]
        self.first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        self.at = {int(t): i for i, t in enumerate(term[self.first])}
        self.best = np.maximum.reduceat(self.sat, self.first) if len(term) else np.zeros(0, np.int64)
        self.first = np.append(self.first, len(term))

    def search(self, weights: list[tuple[int, int]], best: _Best) -> int:
        """Bring one item's documents of this block into best; returns how many were scored.

        weights: (term number, weight times repeats). A mask has a bit a term of the item that the block
        holds. The bound of a mask is the sum of its terms' largest contributions in the block; as no
        document of the mask scores more, the search ends at the first mask whose bound is below the
        least score that still comes in.
        """
        have = [(self.at[t], w) for t, w in weights if t in self.at and w > 0]
        if not have:
            return 0
        top = np.array([w for _, w in have], np.int64) * self.best[[i for i, _ in have]]
        if int(top.sum()) < best.least:
            return 0
        masks = np.zeros((len(self.ids), (len(have) + 63) // 64), U)
        for j, (i, _) in enumerate(have):
            masks[self.row[self.first[i] : self.first[i + 1]], j // 64] |= U(1 << (j % 64))
        some = np.flatnonzero(masks.any(axis=1))
        masks = masks[some]
        key = masks[:, 0] if masks.shape[1] == 1 else np.ascontiguousarray(masks).view([("", U)] * masks.shape[1])[:, 0]
        _, sample, group = np.unique(key, return_index=True, return_inverse=True)
        distinct = masks[sample]
        bound = np.zeros(len(distinct), np.int64)
        for j in range(len(have)):
            bound[distinct[:, j // 64] >> U(j % 64) & U(1) == 1] += top[j]
        reach = bound[group]
        order = np.argsort(-reach, kind="stable")
        some, reach = some[order], reach[order]
        done, size = 0, _FIRST
        while done < len(some) and reach[done] >= best.least:
            stop = min(done + size, len(some))
            stop = int(np.searchsorted(-reach, -reach[stop - 1], side="right"))  # whole masks
            rows = np.sort(some[done:stop])
            score = np.zeros(len(rows), np.int64)
            for i, w in have:
                held = self.row[self.first[i] : self.first[i + 1]]
                at = np.searchsorted(held, rows)
                at[at == len(held)] = 0
                found = held[at] == rows
                score[found] += w * self.sat[self.first[i] + at[found]]
            best.add(score, self.ids[rows])
            done, size = stop, size * 4
        return done


def _blocks(it: Iterator[pa.RecordBatch], stats: tuple[int, int]) -> Iterator[Block]:
    for batch in it:
        ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        n = batch.column("n").to_numpy(zero_copy_only=False)
        start = 0
        sizes = np.diff(batch.column("terms").offsets.to_numpy())
        ends = np.cumsum(sizes)
        while start < len(ids):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _BLOCK, side="right")))
            of = slice(start, stop)
            terms, tfs = (batch.column(c).slice(start, stop - start).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tfs"))
            yield Block(ids[of], n[of], np.repeat(np.arange(stop - start), sizes[of]), terms, tfs, stats)
            start = stop


def _rank_block(docs: DataFrame, items: list[tuple[int, Counter]], k: int) -> DataFrame:
    """number (of the item), rank, doc_id, score for one block of items."""
    spark = docs.sparkSession
    terms = sorted({t for _, c in items for t in c})
    number = {t: i for i, t in enumerate(terms)}
    posts = materialise(postings(docs, Vocabulary(terms)), "postings")
    total, length = posts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(posts.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # at most the block's terms
    weight = [math.floor(1000 * math.log((2 * total + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(terms))]
    weighted = [(n, [(number[t], weight[number[t]] * r) for t, r in c.items()]) for n, c in items]
    shared = spark.sparkContext.broadcast(weighted)

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {n: _Best(k) for n, _ in shared.value}
        for block in _blocks(it, (total, length)):
            for n, w in shared.value:
                block.search(w, found[n])
        for n, b in found.items():
            none = b.id == _NO_ID
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.id), n)), pa.array(b.id, mask=none), pa.array(b.score)], ["number", "doc_id", "score"])

    local = posts.mapInArrow(search, "number long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # k rows of an item per task; a first round over 64 shares of an item's rows keeps the second one's small
    share = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    few = local.withColumn("r", F.row_number().over(Window.partitionBy("number", share).orderBy(*order))).filter(F.col("r") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).filter(F.col("rank") <= k).select("number", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, item_block: int = 8 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of every item (item_id, text).

    The score is the contract's integer BM25; N, L and df come from all documents. Items are taken in
    blocks of about item_block bytes of text (at least one item), each block against all documents: that
    is what tasks hold of the items. A document leaves the scan as its counts of the block's terms.
    Null texts have no term and neither rank nor are ranked; items or documents that repeat each give
    their own rows; documents without an id count in the statistics and rank last among equal scores;
    an empty table gives no row. Other columns are ignored.
    """
    spark = docs.sparkSession
    out, block, size, number = None, [], 0, {}

    def flush():
        nonlocal out, block, size, number
        if any(c for _, c in block):
            names = spark.createDataFrame(list(number.items()), "number long, item_id long")
            found = _rank_block(docs, block, k).join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score")
            out = found if out is None else out.unionByName(found)
        block, size, number = [], 0, {}

    for i, r in enumerate(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator()):
        block.append((i, item_terms(r.text)))
        number[i] = r.item_id
        size += len(r.text or "")
        if size >= item_block:
            flush()
    flush()
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")

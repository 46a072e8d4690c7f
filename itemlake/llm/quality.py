"""Quality rules: rule-based counts, and a hashed n-gram log-likelihood ratio of trusted against raw text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlake.llm.textarrays import U, Slice, mixed, slices, words

#: Hash buckets of the multinomials, and the fixed point of a bucket's log ratio.
BUCKETS, POINT = 1 << 16, 1 << 20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]".strip(b"[]"))] = True
_SPACES = " \t\n\x0b\x0c\r"


def ngram_buckets(s: Slice) -> np.ndarray:
    """Bucket of the three bytes from each byte on; BUCKETS where they would leave the row."""
    b = s.data.astype(np.uint32)
    out = np.full(len(b), BUCKETS, np.int64)
    if len(b) > 2:
        h = (b[:-2] * np.uint32(257) + b[1:-1]) * np.uint32(257) + b[2:]
        out[:-2] = (h * np.uint32(2654435761)) >> np.uint32(16)
    ends = s.offsets[1:]
    for k in (1, 2):
        at = ends - k
        out[at[at >= s.offsets[:-1]]] = BUCKETS
    return out


def trusted_ids(labels: DataFrame, limit: int) -> list[int]:
    """Ids labelled of good quality and not toxic; if more than limit, those with the smallest hashes."""
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return [r.doc_id for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()]


def log_ratio(docs: DataFrame, labels: DataFrame, trusted_limit: int = 20_000, prior: float = 50_000.0, evidence: float = 500_000.0) -> np.ndarray | None:
    """Per bucket, log of the trusted over the raw probability, in units of 1 / POINT; None if no document is trusted.

    The raw counts are those of every document, repeated rows included; the trusted ones those of at
    most trusted_limit labelled ids, with prior more grams dealt as the raw ones are (and more in
    proportion as fewer than evidence grams are trusted), so that a bucket which is as usual in both
    has ratio 1, and little evidence leaves all ratios near 1 and rejects little. Counts are summed per task before the shuffle, and
    BUCKETS sums reach the driver.
    """
    ids = np.sort(np.array(trusted_ids(labels, trusted_limit), np.int64))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
        for batch in it:
            trusted = np.isin(batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False), ids) & np.asarray(batch.column(0).is_valid())
            for s in slices(batch.column(1)):
                grams = ngram_buckets(s)
                raw += np.bincount(grams, minlength=BUCKETS + 1)
                if (take := trusted[s.first : s.last]).any():
                    good += np.bincount(grams[np.repeat(take, np.diff(s.offsets))], minlength=BUCKETS + 1)
        at = np.flatnonzero(raw[:BUCKETS])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], ["bucket", "raw", "good"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "bucket long, raw long, good long")
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect():  # BUCKETS rows at most
        raw[r.bucket], good[r.bucket] = r.raw, r.good
    if not good.sum():
        return None
    prior *= max(1.0, evidence / good.sum())
    base = raw / raw.sum()
    seen = raw > 0
    p = np.zeros(BUCKETS)
    p[seen] = np.log((good[seen] + prior * base[seen]) / (good.sum() + prior) / base[seen])
    return np.round(p * POINT).astype(np.int64)


def _repeat_words(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per row, the words inside 3-word windows that occur twice or more in it."""
    n = len(h)
    if n < 3:
        return np.zeros(rows, np.int64)
    gram = mixed(h[:-2] * U(3) + (h[1:-1] << U(7)) + (h[2:] << U(17)) + h[1:-1] * U(0x9E3779B97F4A7C15) + h[2:] * U(0xC2B2AE3D27D4EB4F))
    gram ^= mixed(row[:-2].astype(U) + U(0x5851F42D4C957F2D))
    inside = np.flatnonzero(row[:-2] == row[2:])
    order = inside[np.argsort(gram[inside])]
    same = gram[order[1:]] == gram[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = twice.copy()
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    return np.bincount(row[covered], minlength=rows)


def _dup_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    lines = text.split("\n")
    if len(seen := set(lines)) == len(lines):
        return 0
    wordy = sum(1 for x in lines if x.strip(_SPACES))
    return wordy - sum(1 for x in seen if x.strip(_SPACES))


_SCORES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score_sum long, n_grams long"


def score_batch(text: pa.Array, ratio: np.ndarray | None, threshold: float, min_words: int, max_repeat_percent: int) -> list[np.ndarray]:
    """The columns of _SCORES after doc_id."""
    parts = []
    table = None if ratio is None else np.append(ratio, 0)
    for s in slices(text):
        w = words(s)
        n_words = np.diff(w.first)
        lead = (s.data & 0xC0) != 0x80
        inside = np.zeros(len(s.data) + 1, np.int8)
        inside[w.start] += 1
        np.subtract.at(inside, w.end, 1)  # a word may end where the next row's begins
        chars = s.per_row(lead & (np.cumsum(inside[:-1], dtype=np.int8) > 0))
        repeat = _repeat_words(w.hashes(s.data), w.row, len(n_words))
        lines = np.array([_dup_lines(t) for t in text.slice(s.first, s.last - s.first).to_pylist()], np.int64)
        size = np.diff(s.offsets)
        grams = np.maximum(size - 2, 0)
        score = s.per_row(table[ngram_buckets(s)]) if table is not None else np.zeros(len(size), np.int64)
        failed = (n_words < min_words) | (100 * repeat > max_repeat_percent * n_words)
        kept = ~failed & (score >= np.ceil(threshold * POINT).astype(np.int64) * grams)
        parts.append([n_words, chars, s.per_row(_SYMBOL[s.data]), lines, repeat, failed, kept, score, grams])
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = -0.4, trusted_limit: int = 20_000, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Counts, verdicts and the score of every row of docs (doc_id, text); see _SCORES.

    A document is kept unless it fails a base rule or its mean log ratio per 3-byte gram, score_sum /
    (POINT * n_grams), is below threshold. The sums are integers, so the verdict doesn't depend on
    how rows are dealt. Null text counts as empty, which fails the base rules; a null id never is
    trusted; repeated rows each give a row; without trusted rows the method keeps everything; an
    empty table gives no row. Other columns are ignored.
    """
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratio(docs, labels, trusted_limit))  # BUCKETS numbers
    names = [x.split()[0] for x in _SCORES.split(", ")]

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                columns = score_batch(batch.column(1), ratio.value, threshold, min_words, max_repeat_percent)
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, _SCORES)


def keep_good(docs: DataFrame, labels: DataFrame, **rules) -> DataFrame:
    """The rows of docs, all columns whatever their names, whose text is kept (see quality_scores).

    The text decides: null, empty and short texts go, rows that repeat a text share its fate, null
    ids don't matter but are never trusted, texts of any length are read whole. Without trusted rows
    only the base rules reject; an empty table stays empty.
    """
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratio(docs, labels, rules.get("trusted_limit", 20_000)))
    at, threshold = docs.columns.index("text"), rules.get("threshold", -0.4)

    def good(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                kept = score_batch(batch.column(at), ratio.value, threshold, rules.get("min_words", 50), rules.get("max_repeat_percent", 50))[6]
                yield batch.filter(pa.array(kept))

    return docs.mapInArrow(good, docs.schema)

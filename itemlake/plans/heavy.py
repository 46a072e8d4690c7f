"""The most frequent value of each key, from bounded counters that are then counted again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlake.plans.scratch import materialise


def _counters(batches: Iterator[pa.RecordBatch], k: int, most: int) -> Iterator[pa.RecordBatch]:
    """Misra-Gries: k counters a key; where all are taken by others, each loses one and the key's loss grows by one. Rows: key, value (null: the loss), n."""
    held: dict[str, dict[str, int]] = {}
    lost: dict[str, int] = {}

    def rows() -> pa.RecordBatch:
        out = [(key, v, n) for key, c in held.items() for v, n in c.items()] + [(key, None, n) for key, n in lost.items()]
        held.clear()
        lost.clear()
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["key", "value", "n"])

    size = 0
    for batch in batches:
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            c = held.setdefault(key, {})
            if value in c or len(c) < k:
                size += value not in c
                c[value] = c.get(value, 0) + 1
                continue
            lost[key] = lost.get(key, 0) + 1
            for v in [v for v, n in c.items() if n == 1]:
                del c[v]
                size -= 1
            for v in c:
                c[v] -= 1
        if size > most:  # counters of parts add up, and so do their losses
            yield rows()
            size = 0
    yield rows()


def most_frequent(rows: DataFrame, key: str, value: str, k: int = 32, most: int = 500_000) -> DataFrame:
    """key, value, n: the most frequent value (text) of each key and how often it occurs; ties by the smallest value. Null keys or values don't count.

    Tasks count with at most k counters a key, so k rows a key leave a task, however many values it has. A
    counter is at most the key's summed loss below the truth, and a value without one occurs no more often than that. So if the
    largest counter is above the loss, the answer is among the values whose counter and loss together reach it:
    these are counted again exactly. Keys for which the bound doesn't decide are counted in full.
    """
    named = materialise(rows.select(F.col(key).alias("key"), F.col(value).alias("value")).filter("key is not null and value is not null"), "values")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counters(it, k, most)

    counters = named.mapInArrow(count, "key string, value string, n long").groupBy("key", "value").agg(F.sum("n").alias("n"))
    counters = materialise(counters, "counters")
    bounds = counters.groupBy("key").agg(F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("top"), F.coalesce(F.max(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("loss"))
    bounds = materialise(bounds, "bounds")
    decided = bounds.filter("top > loss")
    # with a loss of 0 the counters are the counts
    exact = counters.filter("value is not null").join(decided.filter("loss = 0").select("key"), "key", "left_semi")
    likely = counters.filter("value is not null").join(decided.filter("loss > 0"), "key").filter("n + loss >= top").select("key", "value")
    again = named.join(likely, ["key", "value"], "left_semi").groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    open_ = bounds.filter("top is null or top <= loss").select("key")
    full = named.join(open_, "key", "left_semi").groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    every = exact.unionByName(again).unionByName(full)
    best = every.groupBy("key").agg(F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value"))).alias("x"))
    return best.select(F.col("key").alias(key), F.col("x.value").alias(value), F.col("x.n").alias("n"))

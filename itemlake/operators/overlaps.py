"""Pairs of sets that meet under a key many sets hold, compared in tiles of sets instead of one by one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlake.plans.scratch import materialise

#: Sets on a side of a tile, about.
TILE = 1024
#: Columns of a tile's matrices at once, and rows of a batch.
_COLUMNS, _BATCH = 2048, 1 << 18
#: Pairs of sets that a task compares, about.
_TASK_PAIRS = 1 << 23


def _common(rows: tuple[np.ndarray, np.ndarray], columns: tuple[np.ndarray, np.ndarray], shape: tuple[int, int], first: int, last: int) -> np.ndarray:
    """How many of the columns first..last-1 two sets share, for all of both sides."""
    found = np.zeros(shape, np.float32)
    for lo in range(first, last, _COLUMNS):
        hi = min(last, lo + _COLUMNS)
        sides = []
        for row, column, n in zip(rows, columns, shape, strict=True):
            side, mine = np.zeros((n, hi - lo), np.float32), (column >= lo) & (column < hi)
            side[row[mine], column[mine] - lo] = 1
            sides.append(side)
        found += sides[0] @ sides[1].T
    return found


def tile_pairs(texts: tuple[pa.ListArray, pa.ListArray], key: list[int], least: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in a, place in b, shared) of the sets of two sides that share least numbers or more and key as the first of them.

    Every set's numbers are distinct and hold key. same: both sides are one, and a pair comes out once.
    """
    flat = [t.flatten().to_numpy(zero_copy_only=False) for t in texts]
    rows = tuple(np.repeat(np.arange(len(t)), np.diff(t.offsets.to_numpy())) for t in texts)
    numbers, place, count = np.unique(np.concatenate(flat), return_inverse=True, return_counts=True)
    kept = count > 1  # others are in one set only
    column = np.where(kept, np.cumsum(kept) - 1, -1)[place]
    columns = (column[: len(flat[0])], column[len(flat[0]) :])
    numbers, shape = numbers[kept], (len(texts[0]), len(texts[1]))
    border = int(np.searchsorted(numbers, key[-1], side="right"))
    met = _common(rows, columns, shape, 0, border) == len(key)
    shared = _common(rows, columns, shape, border, len(numbers)) + np.float32(len(key))
    if len(key) < least:
        met &= shared >= least
    if same:
        met = np.triu(met, 1)
    a, b = np.nonzero(met)
    return a, b, shared[a, b].astype(np.int32)


def pairs_in_tiles(rows: DataFrame, heavy: DataFrame, least: int) -> DataFrame:
    """choice_set_id_a, choice_set_id_b, shared: pairs of the sets in rows (key, choice_set_id, t, inner) that share least numbers of t or more, under the first key of these.

    Inner sets meet each other and all others, which don't meet among themselves. heavy (key, n_inner,
    n_all): the keys that take part. Sets of a key are dealt to chunks by a hash, and a tile is two chunks, so that
    no key goes through one task; tasks follow the pairs to be compared.
    """
    sides = F.when(F.col("inner"), F.col("n_inner")).otherwise(F.col("n_all") - F.col("n_inner"))
    dealt = rows.join(heavy, "key").withColumn("chunks", F.ceil(sides / TILE)).withColumn("chunk", F.pmod(F.xxhash64("choice_set_id"), F.col("chunks")))
    held = dealt.groupBy("key", "inner", "chunk").agg(F.max("chunks").alias("chunks"), F.collect_list(F.struct("choice_set_id", "t")).alias("sets"))
    held = materialise(held.select("key", "inner", "chunk", "chunks", F.col("sets.choice_set_id").alias("ids"), F.col("sets.t").alias("t")), "set-chunks")
    one, other = (held.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("inner", "chunk", "ids", "t")], F.col("chunks").alias(f"chunks_{x}")) for x in "ab")
    tile = ["key", "ids_a", "t_a", "ids_b", "t_b"]
    inside = held.filter("inner").select("key", F.col("ids").alias("ids_a"), F.col("t").alias("t_a"), *[F.lit(None).cast(held.schema[c].dataType).alias(f"{c}_b") for c in ("ids", "t")])
    within = one.filter("inner_a and chunks_a > 1").join(other.filter("inner_b and chunks_b > 1"), "key").filter("chunk_a < chunk_b").select(tile)
    across = one.filter("not inner_a").join(other.filter("inner_b"), "key").select(tile)
    work = heavy.agg(F.sum(F.col("n_inner").cast("double") * F.col("n_all"))).first()[0] or 0
    spread = rows.sparkSession.sparkContext.defaultParallelism
    tiles = inside.unionByName(within).unionByName(across).repartition(int(min(max(work / _TASK_PAIRS, spread), 20_000)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                key, ids_a, t_a, ids_b, t_b = (batch.column(c)[i] for c in range(5))
                same = not ids_b.is_valid
                ids = (ids_a.values, ids_a.values if same else ids_b.values)
                a, b, shared = tile_pairs((t_a.values, t_a.values if same else t_b.values), key.as_py(), least, same)
                for lo in range(0, len(a), _BATCH):
                    part = slice(lo, lo + _BATCH)
                    yield pa.RecordBatch.from_arrays(
                        [ids[0].take(pa.array(a[part])), ids[1].take(pa.array(b[part])), pa.array(shared[part])], ["choice_set_id_a", "choice_set_id_b", "shared"]
                    )

    id_type = rows.schema["choice_set_id"].dataType.simpleString()
    return tiles.mapInArrow(compare, f"choice_set_id_a {id_type}, choice_set_id_b {id_type}, shared int")

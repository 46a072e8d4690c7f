"""Embedding near-duplicates by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from itemlake.llm.tiles import classes_of, count_links, groups
from itemlake.operators.graph import connected_components
from itemlake.plans.scratch import materialise

BITS = 60


def _matrix(column: pa.Array | pa.ChunkedArray, wide: bool) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64 if wide else np.float32).reshape(len(rows), -1).astype(np.float64)


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by their largest component, which leaves cosines alone and can't overflow, and their lengths."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x, np.sqrt((x * x).sum(1))


def _planes(seed: int, sweep: int, size: int) -> np.ndarray:
    return np.random.default_rng([seed, sweep, size]).standard_normal((size, BITS))


def _star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the pairs connect, one for each vertex but the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(i):
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    take = label != np.arange(len(nodes))
    return nodes[take], nodes[label[take]]


def key_depths(keys: np.ndarray, window: int) -> np.ndarray:
    """For each key, how many leading bits it shares with at most window keys, itself included; BITS if more share all."""
    depth = np.full(len(keys), BITS)
    for bits in range(BITS - 1, -1, -1):
        _, at, n = np.unique(keys >> np.int64(BITS - bits), return_inverse=True, return_counts=True)
        few = n[at] <= window
        if not few.any():
            break
        depth[few] = bits
    return depth


def passes_for(recall: float, agree: float, depth: np.ndarray) -> int:
    """Passes after which a pair has met with probability recall, on average over depth.

    Each sign is the same for both with probability agree, and a pair whose first depth signs are
    the same is inside a window.
    """
    met = agree ** np.asarray(depth, float)
    n = 1
    while (1 - (1 - met) ** n).mean() < recall:
        n += 1
    return n


def near_vectors(vectors: DataFrame, threshold: float = 0.9, passes: int = 10, window: int = 64, block: int = 1024, tile: int = 1024, seed: int = 7, recall: float = 0.95, probe: int = 1 << 16) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding), by cosine >= threshold.

    In each pass vectors are ordered by BITS signs of random projections, read as one number, and
    each is compared with the window next ones. There are as many passes as pairs at the threshold
    need to meet with probability recall, at least passes: the leading signs that single out a
    window are counted on about probe vectors, and grow with the logarithm of the number of
    vectors. A vector goes through one exchange a pass, in which its neighbours come to stand beside
    it; only the rows at the partitions' borders are dealt again. Verified pairs of all passes are
    joined into components, and n_links counts the cosines >= threshold among all vectors of a
    component, compared in tiles, so windows bound the search and not the partners.

    Equal vectors are one from the start and count with their number; an id may have several
    vectors, each of which gives a row. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without an id, link with nothing and are their own component.
    Vectors of different lengths don't link. An empty table gives no row; other columns are ignored.
    """
    wide = isinstance(vectors.schema["embedding"].dataType.elementType, DoubleType)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>" if wide else "array<float>").alias("e"))
    fit = F.coalesce(F.size("e") > 0, F.lit(False)) & F.col("vec_id").isNotNull() & F.coalesce(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0), F.lit(False))

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.float64 if wide else np.float32
        for batch in it:
            raw = [np.asarray(x, kind).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["vec_id", "raw"])

    packed = rows.filter(fit).mapInArrow(pack, "vec_id long, raw binary").withColumn("key", F.md5("raw"))
    reps = packed.groupBy("key").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("raw").alias("raw"))
    reps = materialise(reps.withColumn("rep", F.monotonically_increasing_id()), "vectors")

    def project(it: Iterator[pa.RecordBatch], passes: int, with_raw: bool = True) -> Iterator[pa.RecordBatch]:
        weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in it:
            ids, raw = batch.column(0), batch.column(1)
            sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                mine = pa.array(np.flatnonzero(sizes == size))
                own, part = ids.take(mine), raw.take(mine)
                x, _ = _scaled(_matrix(part, wide))
                for sweep in range(passes):
                    key = ((x @ _planes(seed, sweep, x.shape[1]) >= 0) * weights).sum(1)
                    n = len(mine)
                    columns = [pa.array(np.full(n, sweep)), pa.array(np.full(n, size, np.int64)), pa.array(key), own, *([part] if with_raw else [])]
                    yield pa.RecordBatch.from_arrays(columns, placed_names[: len(columns)])

    placed_names = ["sweep", "size", "key", "rep", "raw"]
    order = placed_names[:4]
    agree = 1 - math.acos(max(-1.0, min(threshold, 1.0))) / math.pi  # the share of signs that a pair at the threshold has in common
    total = reps.count()
    share = min(1.0, probe / max(total, 1))
    some = reps.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = some.select("rep", "raw").mapInArrow(lambda it: project(it, 1, False), "sweep long, size long, key long, rep long").select("size", "key").toArrow()  # about probe rows
    sizes, seen = (drawn.column(c).to_numpy() for c in ("size", "key"))
    for size in np.unique(sizes):
        mine = seen[sizes == size]
        depth = key_depths(mine, window).astype(float)
        if share < 1 and len(mine) > window:  # the other halvings cost as many signs each as those that were seen
            depth *= 1 + math.log2(1 / share) / math.log2(len(mine) / window)
        # by the bound of unlike vectors, who shares more signs with a window shares them with vectors above the threshold, which need not all meet
        depth = depth[depth <= max(1.0, math.log(max(len(mine) / share / window, 1.0)) / -math.log(agree))] if agree < 1 else depth[:0]
        if len(depth):
            passes = max(passes, passes_for(recall, agree, depth))
    swept = reps.select("rep", "raw").mapInArrow(lambda it: project(it, passes), "sweep long, size long, key long, rep long, raw binary")
    sorted_passes = swept.repartitionByRange(*order).sortWithinPartitions(*order).select("sweep", "size", "rep", "raw")

    def near_pairs(sweep: np.ndarray, size: np.ndarray, ids: np.ndarray, raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Star edges between rows at most window apart, of one pass and length."""
        found_a, found_b = [], []
        cuts = np.flatnonzero(np.diff(sweep) | np.diff(size)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(ids)], strict=True):
            x, norm = _scaled(_matrix(raw.slice(lo, hi - lo), wide))
            for i in range(0, hi - lo, 256):
                j = min(hi - lo, i + 256)
                k = min(hi - lo, j + window)
                near = x[i:j] @ x[i:k].T / (norm[i:j, None] * norm[None, i:k]) >= threshold
                gap = np.arange(i, k)[None, :] - np.arange(i, j)[:, None]
                a, b = np.nonzero(near & (gap > 0) & (gap <= window))
                found_a.append(ids[lo + i + a])
                found_b.append(ids[lo + i + b])
        return _star_edges(np.concatenate(found_a), np.concatenate(found_b))

    nothing = {"a": pa.int64(), "b": pa.int64(), "part": pa.int64(), "at": pa.int64(), "sweep": pa.int64(), "size": pa.int64(), "rep": pa.int64(), "raw": pa.binary()}

    def told(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in nothing.items()], list(nothing))

    def neighbours(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges inside a partition, and its first and last window rows, which may have neighbours in other partitions."""
        part, at, tail = TaskContext.get().partitionId(), 0, None
        for batch in it:
            for lo in range(0, batch.num_rows, 4096):
                rows = batch.slice(lo, 4096)
                old = 0 if tail is None else tail.num_rows
                table = pa.Table.from_batches([rows] if tail is None else [tail, rows]).combine_chunks()
                sweep, size, ids = (table.column(c).to_numpy() for c in range(3))
                a, b = near_pairs(sweep, size, ids, table.column(3).combine_chunks())
                if len(a):
                    yield told(a=a, b=b)
                if at < window:
                    head = rows.slice(0, window - at)
                    yield told(part=np.full(head.num_rows, part), at=np.arange(at, at + head.num_rows), sweep=head.column(0), size=head.column(1), rep=head.column(2), raw=head.column(3))
                at += rows.num_rows
                tail = table.slice(max(0, old + rows.num_rows - window)).to_batches()[0]
        if tail is not None and (left := min(tail.num_rows, at - window)) > 0:  # those that were not among the first
            tail = tail.slice(tail.num_rows - left)
            yield told(part=np.full(left, part), at=np.arange(at - left, at), sweep=tail.column(0), size=tail.column(1), rep=tail.column(2), raw=tail.column(3))

    seen = materialise(sorted_passes.mapInArrow(neighbours, "a long, b long, part long, at long, sweep long, size long, rep long, raw binary"), "passes")
    # the border rows in order: what lies between two of them was near neither
    border = seen.filter("part is not null").drop("a", "b")
    inside = Window.partitionBy("part").orderBy("at")  # at most 2 * window rows
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = border.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = border.withColumn("rank", F.row_number().over(inside) - 1).join(starts, "part").withColumn("rank", F.col("rank") + F.col("start"))
    halo = F.when((F.col("rank") % block < window) & (F.col("rank") >= block), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    blocks = ranked.withColumn("back", F.explode(halo)).select((F.expr(f"rank div {block}") - F.col("back")).alias("block"), "rank", "sweep", "size", "rep", "raw")

    def across(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(it, ["block"]):
            table = table.sort_by("rank").combine_chunks()
            a, b = near_pairs(*(table.column(c).to_numpy() for c in ("sweep", "size", "rep")), table.column("raw").combine_chunks())
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    edges = seen.filter("a is not null").select("a", "b").unionByName(blocks.repartition("block").sortWithinPartitions("block").mapInArrow(across, "a long, b long"))
    clusters = connected_components(edges).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))

    def linked(table: pa.Table) -> np.ndarray:
        x, norm = _scaled(_matrix(table.column("raw"), wide))
        return x @ x.T / (norm[:, None] * norm[None, :]) >= threshold

    members = clusters.join(reps.select("rep", "copies", "raw"), "rep").withColumnRenamed("rep", "id").withColumn("band", F.lit(0))
    found = materialise(count_links(members, tile, linked), "links")
    classes = classes_of(found, reps.select(F.col("rep").alias("id"), F.col("id").alias("name"))).withColumnRenamed("id", "rep")
    per_key = reps.select("key", "rep", "id", "copies").join(classes, "rep", "left")
    per_key = per_key.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("smallest", "id").alias("component_id"))
    result = packed.select("vec_id", "key").join(per_key, "key").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return result.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

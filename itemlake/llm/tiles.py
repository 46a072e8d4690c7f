"""Exact comparison inside candidate clusters, tile by tile, without a row per pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlake.operators.graph import connected_components

LINKS = "id long, links long, low long"


def local_components(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the smallest row number reachable."""
    label = np.arange(len(linked))
    if not linked.any():
        return label
    a, b = np.nonzero(linked)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def in_tiles(members: DataFrame, tile: int) -> DataFrame:
    """members (cluster, id, band, ...) dealt to tiles: adds tile_a <= tile_b and chunk.

    Only members of the same band or of neighbouring ones are to meet. A band of a cluster with n rows has
    ceil(n / tile) chunks, by the hash of id; each two chunks of one band or of neighbours, and
    each chunk with itself, make a tile, so that two members meet in at most one and a task holds
    2 * tile rows or so, whatever the cluster's size.
    """
    sizes = members.groupBy("cluster", "band").agg(F.ceil(F.count(F.lit(1)) / tile).cast("long").alias("chunks"))
    around = sizes.select("cluster", F.col("band").alias("other_band"), F.col("chunks").alias("others"), F.explode(F.expr("array(band - 1, band, band + 1)")).alias("band"))
    code = lambda band, chunk: F.shiftleft(F.col(band).cast("long"), 32) + chunk
    return (
        members.join(sizes.join(around, ["cluster", "band"]), ["cluster", "band"])
        .withColumn("chunk", code("band", F.pmod(F.xxhash64("id"), F.col("chunks"))))
        .withColumn("other", F.explode(F.expr("sequence(0L, others - 1)")))
        .withColumn("other", code("other_band", F.col("other")))
        .withColumn("tile_a", F.least("chunk", "other"))
        .withColumn("tile_b", F.greatest("chunk", "other"))
        .drop("other", "others", "other_band", "chunks", "band")
    )


def groups(it: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal (integer) keys in a sorted stream of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in it:
        if not batch.num_rows:
            continue
        k = [batch.column(name).to_numpy(zero_copy_only=False) for name in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in k:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in k)
        new[0] = last is not None and first != last
        at = 0
        for cut in np.flatnonzero(new):
            if cut > at:
                held.append(batch.slice(at, cut - at))
            yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
        last = tuple(c[-1] for c in k)
    if held:
        yield pa.Table.from_batches(held)


def count_links(members: DataFrame, tile: int, linked: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """members (cluster, id, band, copies, ...) to LINKS rows: how many copies of others id is linked to in a tile, and the smallest id of its part.

    linked(table) is the boolean matrix of a tile's rows. Sum links by id for all; the rows' (id, low)
    are edges that connect the linked members.
    """
    keys = ["cluster", "tile_a", "tile_b"]

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(it, keys):
            if table.num_rows < 2:
                continue
            table = table.sort_by("id")
            ids, copies, chunk = (table.column(c).to_numpy() for c in ("id", "copies", "chunk"))
            m = linked(table)
            np.fill_diagonal(m, False)
            if table.column("tile_a")[0] != table.column("tile_b")[0]:
                m &= chunk[:, None] != chunk[None, :]
            low = ids[local_components(m)]
            take = m.any(1)
            if take.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[take]), pa.array((m @ copies)[take].astype(np.int64)), pa.array(low[take])], ["id", "links", "low"])

    rows = in_tiles(members, tile).repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(compare, LINKS)


def classes_of(links: DataFrame, ids: DataFrame) -> DataFrame:
    """id, smallest, links: for each linked id its number of links and the smallest name (ids: id, name) of those it reaches."""
    totals = links.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(links.select(F.col("id").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "id")
    lowest = parts.join(ids, "id").groupBy("component").agg(F.min("name").alias("smallest"))
    return totals.join(parts, "id").join(lowest, "component").select("id", "smallest", "links")

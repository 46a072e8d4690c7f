"""N-gram Jaccard self-join of documents by chosen paths over minhashed shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itemlake.llm.textarrays import Slice, Words, all_spans, mixed, slices, span_hash, span_prefix, words
from itemlake.llm.tiles import classes_of, count_links, groups, local_components
from itemlake.operators.graph import connected_components
from itemlake.plans.scratch import materialise

SHINGLE, COORDINATES = 5, 64
#: Bytes of text a task hashes at once; a worker stays some 120 MB smaller than with a megabyte, and is no slower.
_SLICE = 1 << 17
_rng = np.random.default_rng(41)
_FACTORS = _rng.integers(0, 1 << 31, COORDINATES, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.int64).astype(np.uint32)


def shingles(s: Slice, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row starts): each row's SHINGLE-word spans; the whole of a shorter text, none of an empty one."""
    h = w.hashes(s.data)
    n = np.diff(w.first)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    starts = np.append(0, np.cumsum(count))
    at = np.arange(starts[-1]) - np.repeat(starts[:-1] - w.first[:-1], count)
    size = np.repeat(np.minimum(n, SHINGLE), count)
    return span_hash(span_prefix(h, "a"), "a", at, size), starts


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """COORDINATES minhashes of each row; rows without shingles have none that means anything."""
    rows = len(starts) - 1
    out = np.zeros((rows, COORDINATES), np.uint32)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        for j in range(COORDINATES):
            v = low * _FACTORS[j]
            v ^= v >> np.uint32(15)
            v *= _SHIFTS[j] | np.uint32(1)
            out[full, j] = np.minimum.reduceat(v, starts[:-1][full])
    return out


def runs_for(recall: float, threshold: float, depth: int = 3) -> int:
    """Runs after which a pair at the threshold has met with the recall, after depth choices.

    A level passes a pair on with probability 1 - exp(-1) or more (an expected 1 / threshold chosen
    coordinates, each of which the two share with probability threshold).
    """
    one = 1.0
    for _ in range(depth):
        one = 1 - math.exp(-one)
    return math.ceil(math.log(1 - recall) / math.log(1 - one))


def _chosen(node: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) pairs: every node chooses each coordinate with probability 1 / (threshold * COORDINATES)."""
    limit = np.uint64(int((1 << 64) / (threshold * COORDINATES)) - 1)
    draw = mixed(node[:, None] + np.arange(1, COORDINATES + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
    return np.nonzero(draw < limit)


def _children(node: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child): a node's member goes to the child of each chosen coordinate and its minhash there."""
    row, j = _chosen(node, threshold)
    return row, mixed(node[row] ^ mixed(sig[row, j].astype(np.uint64) + (j.astype(np.uint64) << np.uint64(32)) + np.uint64(1)))


def _sig(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint32).reshape(len(rows), COORDINATES)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _text_keys(s: Slice, w: Words, rows: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two independent hashes of all words of the rows, in order."""
    return [span_hash(span_prefix(w.hashes(s.data, how), b), b, w.first[:-1][rows], n) for how, b in (("byte", "a"), ("other", "b"))]


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (128-bit hash of the words in order), sig; of rows with an id and a word."""

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for s in slices(batch.column(1), _SLICE):
                w = words(s)
                n = np.diff(w.first)
                sig = signatures(*shingles(s, w))
                take = np.flatnonzero(n)
                k = _text_keys(s, w, take, n[take])
                ids = batch.column(0).slice(s.first, s.last - s.first).take(pa.array(take))
                yield pa.RecordBatch.from_arrays([ids, _signed(k[0]), _signed(k[1]), pa.array([x.tobytes() for x in sig[take]], pa.binary())], ["doc_id", "k1", "k2", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).filter("doc_id is not null")
    return rows.mapInArrow(make, "doc_id long, k1 long, k2 long, sig binary")


def candidate_edges(reps: DataFrame, threshold: float, recall: float, bucket: int, depth: int, near: float, same: float) -> DataFrame:
    """(a, b): star edges among reps (rep, sig) whose estimated similarity is near or more.

    All runs start at once, each with its own root. In a node of at most bucket members all are
    compared; one member of a larger one, the pivot, which differs from node to node, is compared with all, and
    those near it have their edge. If at most 4 * bucket members are not near it, or after depth levels, these are
    compared with all, in tiles, and the node is done; else members not the same as the pivot go on to
    the node's children. So each member of a node that is done goes to a few tiles, instead of down through the levels left.
    Nodes with the same members are compared whole once; larger ones of them all go on, as their
    children differ. The root chooses too, so a tree of depth levels has depth + 1 choices.
    """
    runs = runs_for(recall, threshold, depth + 1)
    roots = mixed(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    child = "node long, rep long"

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                sig, ids = _sig(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
                for root in roots:
                    row, node = _children(np.full(len(ids), root), sig, threshold)
                    yield pa.RecordBatch.from_arrays([_signed(node), pa.array(ids[row])], ["node", "rep"])

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(it, ["node", "tile_a", "tile_b"]):
            table = table.sort_by("rep")
            sig, ids = _sig(table.column("sig")), table.column("rep").to_numpy()
            alike = np.zeros((len(ids), len(ids)), np.int16)
            for j in range(COORDINATES):
                alike += sig[:, None, j] == sig[None, :, j]
            chunk = table.column("chunk").to_numpy()
            close = alike >= near * COORDINATES
            inside = local_components(close & (chunk[:, None] == chunk[None, :]))
            if table.column("tile_a")[0] == table.column("tile_b")[0]:
                low = inside
                heads = np.arange(len(ids))
            else:  # each chunk's own tile tells its parts; this one adds what joins parts of the two
                low = local_components(close)
                heads = np.unique(inside)
            take = heads[low[heads] != heads]
            if len(take):
                yield pa.RecordBatch.from_arrays([pa.array(ids[take]), pa.array(ids[low[take]])], ["a", "b"])

    def alike(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return (sig := _sig(batch.column("sig"))), (sig == _sig(batch.column("pivot_sig"))).mean(1)

    def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                share = alike(batch)[1]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(share >= near), pa.array(share >= same)], ["node", "rep", "sig", "pivot", "joined", "equal"])

    def deeper(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                row, down = _children(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), _sig(batch.column(2)), threshold)
                yield pa.RecordBatch.from_arrays([_signed(down), batch.column(1).take(pa.array(row))], ["node", "rep"])

    stars, tiles, nodes = [], [], reps.select("rep", "sig").mapInArrow(first, child)
    for level in range(depth + 1):
        nodes = materialise(nodes, "nodes")
        mask = F.xxhash64("node")
        sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("least"), F.min(F.col("rep").bitwiseXOR(mask)).alias("pivot"), F.bit_xor(F.xxhash64("rep")).alias("who"))
        sizes = materialise(sizes.filter("n > 1").withColumn("pivot", F.col("pivot").bitwiseXOR(mask)), "node-sizes")
        whole = sizes.filter(F.col("n") <= bucket).groupBy("who", "n", "least").agg(F.min("node").alias("node")).select("node")
        zero = F.lit(0).cast("long")
        tiles.append(nodes.join(whole, "node").join(reps.select("rep", "sig"), "rep").select("node", zero.alias("tile_a"), zero.alias("tile_b"), zero.alias("chunk"), "rep", "sig"))
        big = sizes.filter(F.col("n") > bucket)
        if not big.take(1):
            break
        if level == depth:  # nothing goes on, so nodes with the same members are one
            big = big.groupBy("who", "n", "least").agg(F.min_by("pivot", "node").alias("pivot"), F.min("node").alias("node"))
        pivots = big.join(reps.select(F.col("rep").alias("pivot"), F.col("sig").alias("pivot_sig")), "pivot")
        large = nodes.join(pivots, "node").join(reps.select("rep", "sig"), "rep").select("node", "rep", "sig", "pivot", "pivot_sig")
        large = materialise(large.mapInArrow(judge, "node long, rep long, sig binary, pivot long, joined boolean, equal boolean"), "large-nodes")
        stars.append(large.filter("joined and rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
        opened = large.groupBy("node").agg(F.count_if(~F.col("joined")).alias("open"), F.count_if("joined").alias("done"))
        few = materialise(opened.withColumn("ends", (F.col("open") <= 4 * bucket) | F.lit(level == depth)), "open-members")
        tiles.append(_rest_tiles(large, few.filter("ends and open > 0"), bucket))
        if few.filter("not ends").isEmpty():
            break
        nodes = large.filter("not equal").join(few.filter("not ends").select("node"), "node", "left_semi").select("node", "rep", "sig").mapInArrow(deeper, child)
    keys = ["node", "tile_a", "tile_b"]  # a node is compared in one level, so tiles of all levels go through one exchange
    dealt = reduce(DataFrame.unionByName, tiles).repartition(*keys).sortWithinPartitions(*keys)
    return reduce(DataFrame.unionByName, stars, dealt.mapInArrow(compare, "a long, b long"))


def _rest_tiles(members: DataFrame, counts: DataFrame, bucket: int) -> DataFrame:
    """members (node, rep, sig, joined) of the nodes in counts (node, open, done: members not joined and joined), dealt to tiles in which every two meet of which one at least isn't joined."""
    sizes = counts.select("node", *(F.ceil(F.col(c) / bucket).cast("long").alias(c) for c in ("open", "done")))
    rows = members.join(sizes, "node").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), F.when(F.col("joined"), F.col("done")).otherwise(F.col("open")))))
    rows = rows.withColumn("chunk", F.when(F.col("joined"), F.col("open") + F.col("chunk")).otherwise(F.col("chunk")))  # joined chunks after the open ones
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, if(joined, open, open + done) - 1)")))
    return rows.select("node", F.least("chunk", "other").alias("tile_a"), F.greatest("chunk", "other").alias("tile_b"), "chunk", "rep", "sig")


def jaccard_join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.99, bucket: int = 128, depth: int = 4, tile: int = 256) -> DataFrame:
    """doc_id, class_id, n_links for every row: links to rows whose 5-word shingle sets have Jaccard >= threshold.

    class_id is the smallest doc_id reachable over links (the row's own if it has none), n_links the
    number of other rows linked directly. Texts of one to four words are one shingle; texts without
    a word, null ones included, and rows without an id link with nothing (class_id is then doc_id).
    Rows with the same words are one class from the start and count with their number of rows,
    repeated rows too. An empty table gives no row. Other columns are ignored.

    Chosen paths over minhashes find candidates: a pair at the threshold meets in one of the runs
    with probability recall, more similar pairs with more. Candidates join into clusters, and the
    exact similarity of all pairs in a cluster is computed from whole texts in tiles.
    """
    ratio = Fraction(str(threshold))
    sets = materialise(document_sets(docs), "sets")
    reps = sets.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
    reps = materialise(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")  # ids may have several texts: each has a number
    edges = candidate_edges(reps, threshold, recall, bucket, depth, near=threshold - 0.2, same=0.9)
    clusters = connected_components(edges).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    members = clusters.join(reps.select("rep", "id", "copies", "k1", "k2"), "rep")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    members = materialise(_hashed_sets(members.join(texts, "id"), threshold), "cluster-sets")

    def linked(table: pa.Table) -> np.ndarray:
        sets_ = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        size = np.array([len(x) for x in sets_])
        _, column, seen = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets_)), size)
        rank = np.cumsum(seen > 1) - 1
        keep = seen[column] > 1
        row, column = row[keep], rank[column[keep]]
        both = np.zeros((len(sets_), len(sets_)))
        for lo in range(0, int(rank[-1]) + 1 if len(rank) else 0, 8192):
            part = (column >= lo) & (column < lo + 8192)
            m = np.zeros((len(sets_), 8192 if rank[-1] >= 8192 else int(rank[-1]) + 1), np.float32)
            m[row[part], column[part] - lo] = 1
            both += m @ m.T
        either = size[:, None] + size[None, :] - both
        return both * ratio.denominator >= either * ratio.numerator

    found = materialise(count_links(members, tile, linked), "links")
    classes = classes_of(found, reps.select(F.col("rep").alias("id"), F.col("id").alias("name"))).withColumnRenamed("id", "rep")
    result = reps.select("k1", "k2", "rep", "id", "copies").join(classes, "rep", "left")
    per_set = result.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("smallest", "id").alias("class_id"))
    placed = sets.select("doc_id", "k1", "k2").join(per_set, ["k1", "k2"]).select("doc_id", "class_id", "n_links")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wordless = ids.filter(F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]"))
    return placed.unionByName(wordless.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def drop_near(docs: DataFrame, **join) -> DataFrame:
    """docs, all columns, with one row of each class of jaccard_join: the one with the smallest doc_id.

    Rows without an id stay; of rows with equal id and text one stays.
    """
    first = jaccard_join(docs, **join).filter("doc_id = class_id").select("doc_id").distinct()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text"), F.struct(*docs.columns).alias("row"))  # whatever the other columns are called
    same = Window.partitionBy("doc_id", "text").orderBy("doc_id")
    kept = rows.filter("doc_id is not null").join(first, "doc_id", "left_semi").withColumn("copy", F.row_number().over(same)).filter("copy = 1")
    return kept.select("row.*").unionByName(rows.filter("doc_id is null").select("row.*"))


def _hashed_sets(members: DataFrame, threshold: float) -> DataFrame:
    """cluster, id, copies, band, hashes: each number's set of shingles, once, made from the text whose words have its keys.

    Linked sets' sizes differ by a factor of threshold at most, so a band is a range of sizes as
    wide as that, and a set can only be linked into its own band and the neighbouring ones.
    """
    schema = "cluster long, id long, copies long, band int, hashes binary"

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("k1", "k2"))
            for s in slices(batch.column("text"), _SLICE):
                w = words(s)
                n = np.diff(w.first)
                full = np.flatnonzero(n)
                own = np.ones(len(full), bool)
                for key, k in zip(_text_keys(s, w, full, n[full]), (k1, k2), strict=True):
                    own &= key == k[s.first + full]
                h, starts = shingles(s, w)
                sets = [np.unique(h[starts[r] : starts[r + 1]]) for r in full[own]]
                band = np.floor(np.log(np.maximum(1, [len(x) for x in sets])) / -np.log(threshold) + 1e-9).astype(np.int32) if 0 < threshold < 1 else np.zeros(len(sets), np.int32)
                at = pa.array(s.first + full[own])
                columns = [batch.column(c).take(at) for c in ("cluster", "rep", "copies")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(band), pa.array([x.tobytes() for x in sets], pa.binary())], ["cluster", "id", "copies", "band", "hashes"])

    return members.select("cluster", "rep", "copies", "k1", "k2", "text").mapInArrow(make, schema).dropDuplicates(["id"])

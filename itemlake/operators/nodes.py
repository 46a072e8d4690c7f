"""Sums over the sets that meet in a node (sets that hold the same first texts), without a row per pair or per subset."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Nodes of so many sets are compared pair by pair at once with others; up to DENSE in blocks; larger ones by the next text, unless that makes more pairs.
_SMALL, _DENSE, _BLOCK, _COLUMNS = 24, 4096, 1024, 2048
#: Pairs of a task, about.
_TASK_PAIRS = 1 << 28
SUMS = "class_id long, n_near long, h0 long, h1 long"


def weights(level: int, least: int, most: int) -> np.ndarray:
    """What two sets count that share level texts and r = 0..most after these: a node's own subset and all that add some of the r.

    A subset of j >= least texts counts (-1)^(j - least) C(j - 1, least - 1), which makes one in all for each pair that shares least or more.
    """
    term = lambda j: (-1) ** (j - least) * math.comb(j - 1, least - 1) if j >= least else 0
    return np.array([sum(math.comb(r, u) * term(level + u) for u in range(r + 1)) for r in range(most + 1)], np.int64)


def _xor_where(odd: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each row of odd the exclusive or of the rows of h (n x 2) that it marks, eight at a time by a table."""
    bits = np.packbits(odd, axis=1, bitorder="little")
    h = np.concatenate([h, np.zeros((bits.shape[1] * 8 - len(h), 2), h.dtype)]).reshape(-1, 8, 2)
    table = np.zeros((len(h), 256, 2), h.dtype)
    for b in range(8):
        table[:, 1 << b : 2 << b] = table[:, : 1 << b] ^ h[:, b, None]
    out = np.zeros((len(odd), 2), h.dtype)
    for g in range(len(h)):
        out ^= table[g][bits[:, g]]
    return out


class _Sums:
    """The sums of rows (n, h) of which some meet in nodes; rest: start, length and values of each row's later texts."""

    def __init__(self, n: np.ndarray, h: np.ndarray, least: int):
        self.n, self.h, self.least = n, h, least
        self.near, self.x = np.zeros(len(n), np.int64), np.zeros_like(h)

    def add(self, row: np.ndarray, near: np.ndarray, x: np.ndarray) -> None:
        np.add.at(self.near, row, near)
        for k in (0, 1):
            np.bitwise_xor.at(self.x[:, k], row, x[:, k])

    def settle(self, level: int, node: np.ndarray, row: np.ndarray, rest: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Adds what the rows of each run of node are due from the others of it."""
        if not len(node):
            return
        cut = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        size = np.diff(np.append(cut, len(node)))
        small = (size > 1) & (size <= _SMALL)
        if small.any():
            self._pairs(level, cut[small], size[small], row, rest)
        for at, n in zip(cut[size > _SMALL], size[size > _SMALL], strict=True):
            own = slice(at, at + n)
            self._node(level, row[own], (rest[0][own], rest[1][own], rest[2]))

    def _pairs(self, level: int, cut: np.ndarray, size: np.ndarray, row: np.ndarray, rest: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        start, length, values = rest
        width = max(1, int(length.max()))
        f = weights(level, self.least, width)
        before = np.concatenate([[0], np.cumsum(size.astype(np.int64) ** 2)])
        lo = 0
        while lo < len(cut):
            hi = max(lo + 1, int(np.searchsorted(before, before[lo] + (1 << 18), side="right")) - 1)
            s = size[lo:hi].astype(np.int64)
            node = np.repeat(np.arange(lo, hi), s**2)
            place = np.arange(len(node)) - (before[node] - before[lo])
            a, b = cut[node] + place // size[node], cut[node] + place % size[node]
            a, b = a[a != b], b[a != b]
            both = np.zeros(len(a), np.int64)
            for i in range(width):
                mine = i < length[a]
                va = values[np.where(mine, start[a] + i, 0)] if len(values) else None
                for j in range(width):
                    if va is not None:
                        theirs = mine & (j < length[b])
                        both += theirs & (va == values[np.where(theirs, start[b] + j, 0)])
            w = f[both]
            self.add(row[a], w * self.n[row[b]], np.where((w % 2 != 0)[:, None], self.h[row[b]], 0))
            lo = hi

    def _node(self, level: int, row: np.ndarray, rest: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        start, length, values = rest
        who = np.repeat(np.arange(len(row)), length)
        at = np.arange(len(who)) - np.repeat(np.cumsum(length) - length, length)
        text = values[np.repeat(start, length) + at] if len(who) else np.zeros(0, values.dtype)
        _, column, held = np.unique(text, return_inverse=True, return_counts=True)
        later = held[held > 1].astype(float)
        if len(row) > _DENSE and (later**2).sum() < len(row) ** 2 or not len(later):
            own = int(weights(level, self.least, 0)[0])
            if own:
                all_n, all_h = self.n[row].sum(), np.bitwise_xor.reduce(self.h[row], axis=0)
                self.add(row, own * (all_n - self.n[row]), self.h[row] ^ all_h if own % 2 else np.zeros((len(row), 2), self.h.dtype))
            order = np.argsort(column, kind="stable")
            order = order[(held > 1)[column[order]]]
            who, at = who[order], at[order]
            self.settle(level + 1, column[order], row[who], (start[who] + at + 1, length[who] - at - 1, values))
            return
        number = np.where(held > 1, np.cumsum(held > 1) - 1, -1)[column]
        f = weights(level, self.least, int(length.max()))
        for i in range(0, len(row), _BLOCK):
            for j in range(i, len(row), _BLOCK):
                self._block(f, row, who, number, len(later), i, j)

    def _block(self, f: np.ndarray, row: np.ndarray, who: np.ndarray, number: np.ndarray, columns: int, i: int, j: int) -> None:
        a, b = row[i : i + _BLOCK], row[j : j + _BLOCK]
        shared = np.zeros((len(a), len(b)), np.float32)
        for lo in range(0, columns, _COLUMNS):
            sides = []
            for first, n in ((i, len(a)), (j, len(b))):
                e = slice(*np.searchsorted(who, [first, first + n]))
                mine = (number[e] >= lo) & (number[e] < lo + _COLUMNS)
                side = np.zeros((n, min(_COLUMNS, columns - lo)), np.float32)
                side[who[e][mine] - first, number[e][mine] - lo] = 1
                sides.append(side)
            shared += sides[0] @ sides[1].T
        r = shared.astype(np.uint8 if len(f) < 256 else np.int32)
        most = float(np.abs(f).max()) * max(int(self.n[a].max()), int(self.n[b].max())) * _BLOCK
        w, odd = f.astype(np.float32 if most < 1 << 24 else np.float64)[r], (f % 2 != 0)[r]
        if i == j:
            np.fill_diagonal(w, 0)
            np.fill_diagonal(odd, False)
        sides = [(a, b, w, odd)] if i == j else [(a, b, w, odd), (b, a, w.T, odd.T)]
        for to, of, ways, marks in sides:
            self.near[to] += (ways @ self.n[of].astype(w.dtype)).astype(np.int64)
            self.x[to] ^= _xor_where(marks, self.h[of])


def _sums(batch: pa.RecordBatch, level: int, least: int) -> pa.RecordBatch:
    ids, n, h0, h1, k0, k1 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("class_id", "n", "h0", "h1", "k0", "k1"))
    rest = batch.column("rest")
    values, offsets = rest.values.to_numpy(zero_copy_only=False), rest.offsets.to_numpy()
    sums = _Sums(n, np.stack([h0, h1], 1), least)
    node = np.cumsum(np.concatenate([[0], (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])]).astype(np.int64)) if len(ids) else k0
    sums.settle(level, node, np.arange(len(ids)), (offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64), values))
    due = (sums.near != 0) | sums.x.any(1)
    return pa.RecordBatch.from_arrays([pa.array(c[due]) for c in (ids, sums.near, sums.x[:, 0].copy(), sums.x[:, 1].copy())], ["class_id", "n_near", "h0", "h1"])


def node_sums(rows: DataFrame, level: int, least: int, work: float) -> DataFrame:
    """class_id, n_near, h0, h1: what each of the rows (class_id, n, h0, h1, k0, k1, rest) is due from the others of its node (k0, k1), of which a task holds one at a time; add up by class. work: pairs in all nodes."""
    conf = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    parts = int(min(max(work / _TASK_PAIRS, int(conf), rows.sparkSession.sparkContext.defaultParallelism), 20_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        join: Callable[[list], pa.RecordBatch] = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        for batch in batches:
            if not batch.num_rows:
                continue
            k0, k1 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k0", "k1"))
            new = np.flatnonzero((k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])) + 1
            first = 0 if last is not None and (k0[0], k1[0]) != last else None
            begins = int(new[-1]) if len(new) else first
            if begins is None:
                held.append(batch)
            else:
                if begins:
                    held.append(batch.slice(0, begins))
                yield _sums(join(held), level, least)
                held = [batch.slice(begins)]
            last = (k0[-1], k1[-1])
        if held:
            yield _sums(join(held), level, least)

    return rows.repartition(parts, "k0", "k1").sortWithinPartitions("k0", "k1").select("class_id", "n", "h0", "h1", "k0", "k1", "rest").mapInArrow(run, SUMS)

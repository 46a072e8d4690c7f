"""Words, hashes and n-grams of many texts at once, as numpy arrays over Arrow string buffers.

A word is a run of bytes other than space and 0x09-0x0D. Hashes are 64-bit polynomials (modulo
2**64, finished by a mixer). Spans of words get two with different bases; over the words' hashes
"byte" and "other", which share neither base nor byte values, they are 128 bits together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASES = {"byte": 0x9E3779B97F4A7C15, "other": 0xD6E8FEB86659FD93, "a": 0xD1342543DE82EF95, "b": 0xAF251AF3B0F025B5}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_WORD_TABLES = {"byte": _TABLE.copy(), "other": _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)}
for _t in _WORD_TABLES.values():
    _t[[32, 9, 10, 11, 12, 13]] = 0
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def powers(base: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16, 2 * len(have[0]) if have else 0)
        b = _BASES[base]
        up, down = np.full(size, b, U), np.full(size, pow(b, -1, 1 << 64), U)
        up[0] = down[0] = 1
        have = _powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have[0][:n], have[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@dataclass
class Slice:
    """Rows first..last-1 of a batch: their bytes, and each row's range in them (offsets has one more entry)."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def per_row(self, mask: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array over each row."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


@dataclass
class Words:
    start: np.ndarray  # byte
    end: np.ndarray
    row: np.ndarray  # in the slice
    first: np.ndarray  # each row's first word; one more entry

    def hashes(self, data: np.ndarray, base: str = "byte") -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, U)
        up, down = powers(base, len(data))
        values = _WORD_TABLES[base][data]
        values *= up
        return mixed(np.add.reduceat(values, self.start) * down[self.start])


def slices(column: pa.Array | pa.ChunkedArray, max_bytes: int = 1 << 20) -> Iterator[Slice]:
    """Cut a string column into slices of at least one row and about max_bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    at = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + max_bytes, side="right")) - 1)
        yield Slice(i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def words(s: Slice) -> Words:
    n = len(s.data)
    space = _IS_SPACE[s.data]
    edge = np.zeros(n + 1, bool)  # a row begins here
    edge[s.offsets] = True
    before = np.ones(n, bool)
    after = np.ones(n, bool)
    if n:
        before[1:] = space[:-1] | edge[1:n]
        after[:-1] = before[1:]
        after[:-1] = space[1:] | edge[1:n]
    start, end = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
    first = np.searchsorted(start, s.offsets)
    row = np.repeat(np.arange(len(s.offsets) - 1), np.diff(first))
    return Words(start, end, row, first)


def span_prefix(h: np.ndarray, base: str) -> np.ndarray:
    up, _ = powers(base, len(h) + 1)
    out = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[: len(h)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, base: str, start: np.ndarray, n) -> np.ndarray:
    """Hash of the words start..start+n-1."""
    _, down = powers(base, len(prefix))
    return mixed((prefix[start + n] - prefix[start]) * down[start])


def all_spans(h: np.ndarray, base: str, n: int) -> np.ndarray:
    """Hash of n words from every position (len(h) - n + 1 of them, row ends not regarded)."""
    m = max(0, len(h) - n + 1)
    prefix = span_prefix(h, base)
    _, down = powers(base, m)
    return mixed((prefix[n : n + m] - prefix[:m]) * down)

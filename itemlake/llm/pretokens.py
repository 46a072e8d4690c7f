"""Token ids of whole texts from cached pieces.

The pre-token patterns of byte-level BPE look at nothing to their left, and a match can't run from
a character that isn't white space into a space. So a text can be cut before every space that
follows a character other than white space, and the pieces encoded on their own; pieces repeat, and
a bounded cache keeps their ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts from this length on are cut into chunks first.
_LONG = 1 << 19
_MERGE, _NEW = -1, -2


class PieceEncoder:
    """split: pre-tokens of a string; encode_many: ids (sequences of int) of pre-tokens; limit: cached pieces.

    A word is what stands between two spaces, and its piece begins with the space before it. All ids
    lie in one pool; a piece's number leads to its place there. When the limit is reached, words that
    came once since the last time are forgotten, and those that came again stay.
    """

    def __init__(self, split: Callable[[str], list[str]], encode_many: Callable[[list[str]], list], limit: int = 600_000):
        self.split, self.encode_many, self.limit = split, encode_many, limit
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}  # word: number of " " + word, or _MERGE if no space may be cut off after it
        self.pieces: dict[str, int] = {"": 0}  # strings as they stand
        self.parts: dict[str, int] = {}  # numbers of pre-tokens other than a space and letters, which are words
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size, self.count = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32), 1  # number 0 is the empty piece
        self.came = np.zeros(1 << 14, np.int32)  # in how many runs of texts

    def _forget_rare(self) -> None:
        least = 2
        while np.count_nonzero(self.came[: self.count] >= least) > self.limit // 2:
            least *= 2
        often = (self.came[: self.count] >= least).tobytes()
        kept = {w: n for w, n in self.words.items() if n >= 0 and often[n]}
        numbers = np.fromiter(kept.values(), np.int64, len(kept))
        ids, size = self._ids(numbers), self.size[numbers]
        self._forget()
        self.words.update(zip(kept, self._add(size, ids), strict=True))
        self.came[1 : self.count] = 1

    def _ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of pieces, one after the other."""
        size = self.size[numbers]
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        at = np.repeat(self.start[numbers] - total[:-1], size)
        at += np.arange(total[-1], dtype=at.dtype)
        return self.pool[at]

    def _add(self, sizes: list[int] | np.ndarray, ids: np.ndarray) -> range:
        """Numbers of new pieces."""
        n, m = len(sizes), len(ids)
        if self.used + m > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(m, len(self.pool)), np.uint32)])
        if self.count + n > len(self.size):
            more = np.zeros(max(n, len(self.size)), np.int32)
            self.start, self.size, self.came = (np.concatenate([x, more]) for x in (self.start, self.size, self.came))
        self.pool[self.used : self.used + m] = ids
        mine = slice(self.count, self.count + n)
        self.size[mine] = sizes
        self.start[mine] = self.used + np.cumsum(self.size[mine]) - self.size[mine]
        self.used += m
        self.count += n
        return range(self.count - n, self.count)

    def _new(self, tokens: list[str]) -> range:
        """Numbers of pre-tokens."""
        ids = self.encode_many(tokens)
        sizes = list(map(len, ids))
        return self._add(sizes, np.fromiter(chain.from_iterable(ids), np.uint32, sum(sizes)))

    def _part_numbers(self, tokens: list[str]) -> np.ndarray:
        """Numbers of pre-tokens, those of a space and letters among the words."""
        found, words, parts = {}, [], []
        for p in set(tokens):
            if p[0] == " " and p[1:].isalpha():
                n = self.words.get(p[1:])
                words.append(p) if n is None else found.__setitem__(p, n)
            else:
                n = self.parts.get(p)
                parts.append(p) if n is None else found.__setitem__(p, n)
        numbers = self._new(words + parts)
        found.update(zip(words + parts, numbers, strict=True))
        self.words.update(zip((p[1:] for p in words), numbers, strict=False))
        self.parts.update(zip(parts, numbers[len(words) :], strict=True))
        self.came[np.fromiter(found.values(), np.int64, len(found))] += 1
        return np.fromiter(map(found.__getitem__, tokens), np.int64, len(tokens))

    def _encode(self, strings: list[str]) -> range:
        """Numbers of strings that begin where a pre-token must, by their cached pre-tokens."""
        cut = list(map(self.split, strings))
        parts = self._part_numbers(list(chain.from_iterable(cut)))
        ends = np.zeros(len(cut) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)), out=ends[1:])
        total = np.append(0, np.cumsum(self.size[parts], dtype=np.int64))
        return self._add(np.diff(total[ends]), self._ids(parts))

    def _learn(self, words: list[str]) -> None:
        plain, other = [], []
        for w in words:
            if w.isalpha():
                plain.append(w)
            elif not w or w[-1].isspace():
                self.words[w] = _MERGE
            else:
                other.append(w)
        self.words.update(zip(plain, self._new([" " + w for w in plain]), strict=True))  # letters after a space are one pre-token
        self.words.update(zip(other, self._encode([" " + w for w in other]), strict=True))

    def _word_numbers(self, words: list[str]) -> np.ndarray:
        got = np.fromiter(map(self.words.get, words, repeat(_NEW)), np.int64, len(words))
        if len(new := np.flatnonzero(got == _NEW)):
            unknown = [words[i] for i in new.tolist()]
            self._learn(unknown)
            got[new] = np.fromiter(map(self.words.__getitem__, unknown), np.int64, len(new))
        self.came[got[got >= 0]] += 1
        return got

    def _piece_numbers(self, pieces: list[str]) -> list[int]:
        new = list({p for p in pieces if p not in self.pieces})
        self.pieces.update(zip(new, self._encode(new), strict=True))
        return list(map(self.pieces.__getitem__, pieces))

    def _texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, row starts) of texts without nulls."""
        if len(self.words) + len(self.parts) + len(self.pieces) > self.limit:
            self._forget_rare()
        lists = pc.split_pattern(texts, " ")
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        begins = np.append(0, ends[:-1])
        words = lists.flatten().dictionary_encode()
        number = self._word_numbers(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]
        first = words.take(pa.array(begins)).dictionary_decode().to_pylist()
        merge = number == _MERGE
        merge[begins] = [bool(w) and w[-1].isspace() for w in first]
        odd = np.flatnonzero(np.add.reduceat(merge, begins, dtype=np.int64))
        number[begins] = self._piece_numbers(first)
        for r in odd:  # words after which a space can't be cut off are encoded together with the next
            lo, hi = begins[r], ends[r]
            said = texts[int(r)].as_py().split(" ")
            at, place, joined = 0, [], []
            while at < len(said):
                end = at
                while end < len(said) - 1 and merge[lo + end]:
                    end += 1
                if end > at or merge[lo + at]:
                    place.append(lo + at)
                    joined.append(("" if at == 0 else " ") + " ".join(said[at : end + 1]))
                    number[lo + at : lo + end + 1] = 0
                at = end + 1
            number[place] = self._piece_numbers(joined)
        size = self.size[number]
        total = np.zeros(len(size) + 1, np.int32 if len(texts) > 1 else np.int64)
        np.cumsum(size, out=total[1:])
        at = np.repeat(self.start[number] - total[:-1], size)
        at += np.arange(total[-1], dtype=at.dtype)
        ids = self.pool[at]
        return ids, total[np.append(begins, ends[-1])]

    def encode_column(self, column: pa.Array, max_bytes: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, ids, row starts in ids) of runs of rows with about max_bytes of text; null counts as empty."""
        column = pc.fill_null(column, "") if column.null_count else column
        size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(size):
            end = at + max(1, int(np.searchsorted(np.cumsum(size[at : at + 100_000]), max_bytes, side="right")))
            if end == at + 1 and size[at] >= _LONG:
                ids = np.concatenate([self._texts(pa.array([chunk]))[0] for chunk in safe_chunks(column[at].as_py())])
                yield at, end, ids, np.array([0, len(ids)])
            else:
                yield at, end, *self._texts(column.slice(at, end - at))
            at = end

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; none for null."""
        return [ids[a:b].tobytes() for _, _, ids, rows in self.encode_column(pa.array(texts, pa.string())) for a, b in zip(rows, rows[1:], strict=False)]

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch([text])[0]


def safe_chunks(text: str, size: int = _LONG // 2) -> Iterator[str]:
    """Pieces of about size characters that begin at a space after a character other than white space."""
    at = 0
    while len(text) - at > 2 * size:
        cut = text.find(" ", at + size)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def id_rows(ids: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Each row's ids as bytes."""
    offsets = np.asarray(rows, np.int64) * 4
    wide = offsets[-1] > (1 << 31) - 1
    return pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(rows) - 1, [None, pa.py_buffer(offsets.astype(np.int64 if wide else np.int32).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])

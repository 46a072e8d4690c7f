"""NFKC in slices: the same text for any slice, and few Python strings at once."""

from __future__ import annotations

import tracemalloc
import unicodedata

import pyarrow as pa
import pytest

from itemlake.functions import columns as C

TEXTS = ["ＡＢＣ　１", None, "", "é", "ﬁ" * 50, "x" * 300, None, "㍿"]


@pytest.mark.parametrize("size", [1, 7, 100, 1 << 20])
def test_any_slice_gives_the_same(monkeypatch, size):
    monkeypatch.setattr(C, "_NFKC_SLICE", size)
    want = [None if t is None else unicodedata.normalize("NFKC", t) for t in TEXTS]
    for texts in (pa.array(TEXTS), pa.array(["cut", *TEXTS]).slice(1), pa.array(TEXTS, pa.large_string())):
        assert C._nfkc(texts).to_pylist() == want
    assert C._nfkc(pa.array([], pa.string())).to_pylist() == [] and C._nfkc(pa.array([None], pa.string())).to_pylist() == [None]


def test_a_large_batch_is_not_all_python_strings():
    batch = pa.array(["Ａ" * 10_000] * 2000)  # 60 MB
    tracemalloc.start()
    C._nfkc(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 << 20

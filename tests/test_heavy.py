"""Most frequent values from bounded counters against plain counts, where the bound decides and where it doesn't."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from itemlake.plans import heavy


@settings(deadline=None)
@given(st.lists(st.tuples(st.sampled_from("xy"), st.sampled_from("abcdefg")), max_size=200), st.integers(1, 4), st.integers(1, 5))
def test_counters_are_within_their_loss(rows, k, most):
    batches = [pa.RecordBatch.from_pydict({"key": [r[0] for r in part], "value": [r[1] for r in part]}) for part in (rows[:70], rows[70:]) if part]
    found = [r for b in heavy._counters(iter(batches), k, most) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    true, got, loss = Counter(rows), Counter(), Counter()
    for key, value, n in found:
        (loss if value is None else got)[key if value is None else (key, value)] += n
    for key in "xy":
        for value in "abcdefg":
            assert got[key, value] <= true[key, value] <= got[key, value] + loss[key]


@pytest.mark.parametrize("k", [1, 2, 8])
def test_most_frequent(spark, k):
    r = random.Random(k)
    rows = [("flat", f"v{i % 60:02}") for i in range(600)] + [("hot", "a" if r.random() < 0.6 else f"v{r.randrange(500)}") for _ in range(3000)]
    rows += [("near", r.choice("abc")) for _ in range(500)] + [("one", "z"), ("tie", "b"), ("tie", "a"), (None, "a"), ("nothing", None)]
    rows += [(f"k{i}", f"v{r.randrange(4)}") for i in range(200) for _ in range(5)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "t string, o string").repartition(5)
    got = {x.t: (x.o, x.n) for x in heavy.most_frequent(df, "t", "o", k=k, most=40).collect()}
    counts: dict[str, Counter] = {}
    for t, o in rows:
        if t is not None and o is not None:
            counts.setdefault(t, Counter())[o] += 1
    assert got == {t: min(c.items(), key=lambda x: (-x[1], x[0])) for t, c in counts.items()}
    assert heavy.most_frequent(df.filter("false"), "t", "o").count() == 0

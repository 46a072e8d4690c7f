"""Counts of what runs' properties say against the runs one by one."""

from __future__ import annotations

import random
from collections import Counter

from itemlake.sources import textruns

SCHEMA = "doc_id long, paragraph int, run_no int, text string, bold boolean, italic boolean, underline boolean, size double, east_asia string, color string"


def test_counts_are_made_once_for_equal_properties(spark):
    r = random.Random(3)
    pick = lambda *x: r.choice([None, *x])
    rows = [(1, 0, i, pick("a", ""), pick(True, False), pick(True), pick(True, False), pick(10.5, 12.0), pick("MS Gothic", "other"), pick("FF0000")) for i in range(400)]
    runs = spark.createDataFrame(rows, SCHEMA)
    got = {(tuple(x.formats), tuple(x.unexpected)): x.n_runs for x in textruns.count_formats(runs).collect()}
    assert got == Counter((tuple(x.formats), tuple(x.unexpected)) for x in textruns.run_formats(runs).collect())
    want = Counter()
    for x in textruns.run_formats(runs.filter("text <> ''")).collect():
        want["eastAsia=" + (x.east_asia or "none")] += 1
        want.update(name for name in ("bold", "italic") if x[name])
        want.update(u.split("=")[0] for u in x.unexpected)
    assert {x.entry: x.n_runs for x in textruns.font_census(runs).collect()} == want
    bare = runs.select("text")
    assert [(x.formats, x.unexpected, x.n_runs) for x in textruns.count_formats(bare).collect()] == [([], [], 400)]
    assert textruns.count_formats(runs.filter("false")).isEmpty() and textruns.count_formats(bare.filter("false")).isEmpty()


def test_merge_runs_compares_formats_as_bits(spark):
    rows = [(1, 0, 1, "a", ["sub", "i"]), (1, 0, 2, "b", ["i", "sub", "i", None]), (1, 0, 3, "", ["strong"]), (1, 0, 4, "c", None), (1, 0, 5, "d", ["other"]), (1, 0, 6, "e", ["strong"])]
    runs = spark.createDataFrame(rows, "doc_id long, paragraph int, run_no int, text string, formats array<string>")
    merged = textruns.merge_runs(runs)
    got = [(r.island, r.text, r.formats) for r in merged.orderBy("island").collect()]
    assert got == [(1, "ab", ["i", "sub"]), (2, "cd", []), (3, "e", ["strong"])]
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    window = next(line for line in plan.splitlines() if "Window [" in line and "lag" in line)
    assert "lag(bits" in window  # numbers, no arrays of names, are shuffled and sorted

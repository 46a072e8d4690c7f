"""What each of five filters removes in every order of applying them, from 32 states of a Gray-code walk."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILTERS = "ABCDE"
#: Filters A to D of a text; the fifth asks for equal texts elsewhere.
_WORDS, _CAPITALS, _SYMBOLS = r"[^\x20\x09-\x0D]+", "[A-Z]", r"[#$%&*|]"
_MEASURES = ("docs", "good", "toxic")
_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: Column, min_words: int = 200, min_distinct_percent: int = 50, max_capital_percent: int = 3) -> Column:
    """Bits 0 to 3: text fails A, B, C, D. An empty text fails A alone: B and C compare zero with zero."""
    words = F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0))
    fails = (
        F.size(words) < min_words,
        100 * F.size(F.array_distinct(words)) < min_distinct_percent * F.size(words),
        100 * F.regexp_count(text, F.lit(_CAPITALS)).cast("long") > max_capital_percent * F.length(text),
        text.rlike(_SYMBOLS),
    )
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def mask_cells(docs: DataFrame, labels: DataFrame, **rules) -> DataFrame:
    """part, mask (bits of the filters that fail), docs, good, toxic: one row per part and mask that occurs.

    Texts leave their task as a SHA-256 and four bits. Rows of one id come together for the labels, which
    also counts its repeats; equal texts are then reduced per part and label before they meet, so a text
    that a third of all rows hold is a few rows. A row fails E if a row with the same text has a smaller id.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("same"), text_mask(text, **rules).alias("mask"),
    )
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    false = F.lit(False)
    rows = rows.join(marks, "doc_id", "left").select("doc_id", "part", "same", "mask", F.coalesce("good", false).alias("good"), F.coalesce("toxic", false).alias("toxic"))
    group = ["same", "part", "mask", "good", "toxic"]
    rows = rows.groupBy("doc_id", *group).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    equal = rows.groupBy(*group).agg(F.sum("n").alias("n"), first.alias("first"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"))
    smallest = F.min("first.doc_id").over(Window.partitionBy("same"))  # rows per text: parts x labels
    stay = F.col("no_id") + F.when(F.col("first.doc_id") == smallest, F.col("first.n")).otherwise(0)
    both = equal.withColumn("stay", stay).select(
        "part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("stay").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("stay")).alias("n")))).alias("c")
    )
    count = lambda on: F.sum(F.when(on, F.col("c.n")).otherwise(0))
    cells = both.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("docs"), count(F.col("good")).alias("good"), count(F.col("toxic")).alias("toxic"))
    return cells.filter("docs > 0")


def gray_states(mask: np.ndarray, measures: np.ndarray) -> np.ndarray:
    """measures summed over the survivors of each subset of filters, by the subset's bits: [2**filters, measures].

    The walk goes through all subsets by toggling one filter at a time. Each cell counts its active
    failures; only cells that the toggled filter fails change, and those whose counter leaves or
    reaches zero leave or rejoin the running survivors.
    """
    n = len(FILTERS)
    states = np.zeros((1 << n, measures.shape[1]), np.int64)
    failures = np.zeros(len(mask), np.int64)
    alive = measures.sum(axis=0)
    states[0] = alive
    active = 0
    for step in range(1, 1 << n):
        bit = (step & -step).bit_length() - 1
        hit = np.flatnonzero(mask >> bit & 1)
        active ^= 1 << bit
        if active >> bit & 1:
            alive = alive - measures[hit[failures[hit] == 0]].sum(axis=0)
            failures[hit] += 1
        else:
            failures[hit] -= 1
            alive = alive + measures[hit[failures[hit] == 0]].sum(axis=0)
        states[active] = alive
    return states


def _orders(cells: pd.DataFrame) -> pd.DataFrame:
    """All orders and steps of one part, at most 32 cells."""
    mask = cells["mask"].to_numpy(np.int64)
    measures = cells[list(_MEASURES)].to_numpy(np.int64)
    states = gray_states(mask, measures)
    fails = [int(measures[mask >> b & 1 == 1, 0].sum()) for b in range(len(FILTERS))]
    alone = [int(measures[mask == 1 << b, 0].sum()) for b in range(len(FILTERS))]
    rows, total = [], [0] * len(FILTERS)
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, b in enumerate(order, 1):
            after = before | 1 << b
            removed, good, toxic = (int(x) for x in states[before] - states[after])
            total[b] += removed
            rows.append((b, "".join(FILTERS[x] for x in order), step, int(states[after, 0]), removed, fails[b] - removed, alone[b], good, toxic))
            before = after
    part = cells["part"].iloc[0]
    return pd.DataFrame([(part, *r[1:], total[r[0]]) for r in rows], columns=[x.split()[0] for x in _SCHEMA.split(", ")])


def filter_audit(docs: DataFrame, labels: DataFrame, **rules) -> DataFrame:
    """One row per part (lang; null is ''), order of the filters and step; see _SCHEMA.

    docs: doc_id, text, lang; labels: doc_id, quality, toxic; other columns are ignored. Null text counts
    as empty. A row without an id has no label, isn't smaller than any and doesn't fail E; rows that
    repeat an id and a text share their fate in E, so neither is a copy of the other. An id with several
    labels is good or toxic if one of them says so; null labels say nothing. An empty table gives no row.
    """
    return mask_cells(docs, labels, **rules).groupBy("part").applyInPandas(_orders, _SCHEMA)

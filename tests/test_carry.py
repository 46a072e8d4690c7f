"""Values carried over partition borders against brute force, also where one question holds half of all rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from itemlake.operators import stats as S
from itemlake.plans.carry import in_order, last_before, last_known


def wanted(rows):
    out = {}
    for e, v, q, d, _, _ in rows:
        other = [r for r in rows if r[2] == q and r[0] != e and (d is None or (r[3] or "") < d)]
        best = max(other, key=lambda r: (r[3] or "", r[0], r[1]), default=None)
        out[e, v] = (best[4], best[5]) if best else (None, None)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_previous_stats(spark, seed):
    r = random.Random(seed)
    dates = {e: r.choice([None, *[f"200{k}-01-01" for k in range(7)]]) if e % 4 else f"200{e % 7}-01-01" for e in range(40)}
    pairs = {(e, v) for v in range(60) for e in r.sample(range(40), r.randint(1, 12))} | {(e, 100) for e in range(40)}
    rows = [(e, v, 7 if v > 40 else v, dates[e], None if r.random() < 0.1 else r.random(), None if r.random() < 0.2 else r.random()) for e, v in sorted(pairs)]
    df = spark.createDataFrame(rows, "exam_id long, qversion_id long, question_id long, exam_date string, p double, disc double").repartition(5)
    got = S.previous_stats(df).collect()
    assert len(got) == len(rows)
    assert {(x.exam_id, x.qversion_id): (x.prev_p, x.prev_disc) for x in got} == wanted(rows)
    assert S.previous_stats(df.filter("false")).count() == 0


@pytest.mark.parametrize("n_parts", [1, 2, 9, 40])
def test_groups_that_span_partitions(spark, n_parts):
    r = random.Random(n_parts)
    rows = [(r.choice([1, 1, 1, 2, 3]), r.choice([0, 1, 1, 1, 1, 2, 5]), i) for i in range(150)]
    spark.conf.set("spark.sql.shuffle.partitions", str(n_parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = in_order(spark.createDataFrame(rows, "k long, g long, v long"), ["k", "g", "v"])
        assert placed.select("_part").distinct().count() >= min(n_parts, 5)
        got = {x.v: x.before.v if x.before else None for x in last_before(placed, ["k"], ["g"], ["v"], "before").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k, g, v in rows:
        before = [x for x in rows if x[0] == k and x[1] < g]
        assert got[v] == (max(before, key=lambda x: (x[1], x[2]))[2] if before else None)


def test_a_question_with_half_of_all_rows_is_many_tasks(spark):
    n = 20_000
    rows = spark.range(n).select(
        (F.col("id") % 997).alias("exam_id"), F.col("id").alias("qversion_id"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("question_id"),
        F.concat(F.lit("2"), F.lpad((F.col("id") % 997).cast("string"), 3, "0")).alias("exam_date"), (F.col("id") / n).alias("p"), F.lit(0.1).alias("disc"),
    )
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = in_order(rows.withColumnRenamed("exam_date", "date"), ["question_id", "date", "exam_id", "qversion_id"])
        sizes = sorted(x["count"] for x in placed.groupBy("_part").count().collect())
        assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]
        got = S.previous_stats(rows).agg(F.count(F.lit(1)).alias("n"), F.count("prev_p").alias("k")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    first = rows.filter("question_id = 0 and exam_date = '2000'").count()
    assert (got.n, got.k) == (n, n // 2 - first)


@pytest.mark.parametrize("n_parts", [1, 3, 20])
def test_last_known_values(spark, n_parts):
    r = random.Random(n_parts)
    rows = [(r.choice([1, 1, 1, 2, 3]), i, r.choice([None, None, None, i]), "m" if r.random() < 0.02 else None) for i in range(200)]
    rows = [(k, i, None if k == 1 and 40 < i < 160 else v, m) for k, i, v, m in rows]
    spark.conf.set("spark.sql.shuffle.partitions", str(n_parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = in_order(spark.createDataFrame(rows, "k long, i long, v long, m string"), ["k", "i"])
        got = {x.i: (x.last_v, x.last_m) for x in last_known(placed, ["k"], ["v", "m"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k, i, _, _ in rows:
        upto = [x for x in rows if x[0] == k and x[1] <= i]
        assert got[i] == tuple(next((x[c] for x in reversed(upto) if x[c] is not None), None) for c in (2, 3))


def test_one_long_document_is_segmented_in_many_tasks(spark):
    from itemlake.sources.textruns import segment_questions

    n = 30_000
    kind = F.col("id") % 7
    text = F.when(kind == 0, F.concat((F.col("id") / 7 % 900 + 1).cast("int").cast("string"), F.lit(". stem"))).when(kind.isin(2, 3, 4), F.concat(F.substring(F.lit("xxabcxx"), kind.cast("int") + 1, F.lit(1)), F.lit(" choice"))).otherwise("line")
    paragraphs = spark.range(3, n).select(F.lit(1).alias("doc_id"), F.col("id").alias("paragraph"), text.alias("text")).unionByName(spark.createDataFrame([(2, 0, "line"), (2, 1, "a x")], "doc_id int, paragraph long, text string"))
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = {(r.doc_id, r.paragraph): r for r in segment_questions(paragraphs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    number, last = None, None
    for i in range(3, n):
        k, r = i % 7, rows[1, i]
        mark = "stem" if k == 0 else "choice" if k in (2, 3, 4) and number is not None else None
        number, last = (i // 7 % 900 + 1 if k == 0 else number), mark or last
        assert (r.kind, r.number) == (mark or ("continuation" if last == "stem" else "stray"), number), i
    assert {(rows[2, i].kind, rows[2, i].number) for i in (0, 1)} == {("stray", None)}


def test_medians(spark):
    from itemlake.plans.medians import medians

    r = random.Random(9)
    values = {"even": [0.1, 0.4, 0.2, 0.9], "odd": [3.0, 1.0, 2.0], "ties": [0.5] * 9 + [0.7] * 9, "one": [4.0], "none": [None, None], "some": [None, 1.0, 2.0], None: [7.0, 8.0]}
    values["hot"] = [r.random() for _ in range(60_001)]
    values["close"] = [0.5 + r.random() / 1e9 for _ in range(20_000)]
    values["half"] = [0.0] * 30_000 + [1.0] * 30_000
    rows = [(k, True, v) for k, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "t string, f boolean, v double").repartition(4)
    got = {x.t: (x.n_values, x.median) for x in medians(df, ["t", "f"], F.col("v")).collect()}
    for k, vs in values.items():
        known = sorted(v for v in vs if v is not None)
        middle = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2 if known else None
        assert got[k] == (len(known), middle), k
    few = {x.t: x.median for x in medians(df, ["t", "f"], F.col("v"), accuracy=50).collect()}
    assert few == {k: m for k, (_, m) in got.items()}
    assert medians(df.filter("false"), ["t"], F.col("v")).count() == 0

"""Change sets merged into a bucketed bank against the snapshot operators, with untouched buckets left as they are."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from itemlake.operators import bank as B
from itemlake.operators import changes as K

VERSION = "id long, question_id long, version_no int, choice_set_id long, choice_order string, correct string, stem_html string"


@pytest.fixture(scope="module")
def bank(spark):
    n = 400
    questions = spark.createDataFrame([(i, "draft" if i % 7 == 0 else "active", None) for i in range(1, n)], "id long, status string, derived_from long")
    versions = spark.createDataFrame([(i * 10 + k, i, k, i % 30, "12345", "a", f"Q{i}のはどれか。1つ選べ。") for i in range(1, n) for k in range(1, 2 + i % 2)], VERSION)
    tags = spark.createDataFrame([(i, f"t{i % 5}") for i in range(1, n)] + [(i, "more") for i in range(1, n, 3)], "question_id long, tag string")
    return questions, versions, tags


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def files(table):
    root = Path(table.path.removeprefix("file://"))
    return {p.relative_to(root): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def test_changes_are_those_of_the_snapshots(spark, bank, tmp_path):
    questions, versions, tags = bank
    q = K.BucketedTable(spark, f"file://{tmp_path}/q", n_buckets=32).create(questions)
    v = K.BucketedTable(spark, f"file://{tmp_path}/v", bucket_key="question_id", n_buckets=32).create(versions)
    t = K.BucketedTable(spark, f"file://{tmp_path}/t", key=["question_id", "tag"], bucket_key="question_id", n_buckets=32).create(tags)
    batch = spark.createDataFrame([(1, "新しいのはどれか。1つ選べ。", 3, "12345", "a", "active"), (2, "どれか。", 3, "12345", "a", "active"), (3, "別。2つ選べ。", 4, "54321", "ab", "draft")], "batch_key long, stem_html string, choice_set_id long, choice_order string, correct string, status string")
    before = files(v)
    new_q, new_v, report = K.register_changes(batch, q.top(), v.top())
    want_q, want_v, want_report = B.register_questions(questions, versions, batch)
    columns = ["id", "status", "derived_from"]
    assert len(q.merge(new_q)) <= 2 and len(v.merge(new_v)) <= 2
    assert rows(q.read(), columns) == rows(want_q, columns) and rows(v.read(), versions.columns) == rows(want_v, versions.columns)
    assert rows(report, ["batch_key", "blocked", "question_id"]) == rows(want_report, ["batch_key", "blocked", "question_id"])
    after = files(v)
    assert sum(after.get(p) == at for p, at in before.items()) >= len(before) - 2 * max(1, len(before) // 32)
    assert (q.top(), v.top()) == (401, want_v.agg(F.max("id")).first()[0])

    revised = spark.createDataFrame([(5, "Q5のはどれか。1つ選べ。", 5, "54321", "a"), (6, "直した。1つ選べ。", 6, "12345", "a"), (8, "Q8どれか。すべて選べ。", 8, "12345", "ab"), (9, "だめ", 9, "12345", "a")], "question_id long, stem_html string, choice_set_id long, choice_order string, correct string")
    keys = revised.select("question_id", F.col("question_id").alias("id"))
    want_v2, want_report = B.revise_questions(want_v, want_q, revised)
    puts, report = K.revise_changes(v.near(keys), q.near(keys), revised, v.top())
    assert set(v.merge(puts)) <= set(v.buckets_of(keys))
    assert rows(v.read(), versions.columns) == rows(want_v2, versions.columns)
    assert rows(report, report.columns) == rows(want_report, report.columns)

    ids = spark.createDataFrame([(3,), (4,), (3,), (9999,)], "question_id long")
    q.merge(K.retire_changes(q.near(ids.withColumnRenamed("question_id", "id")), ids))
    assert rows(q.read(), columns) == rows(B.retire_questions(want_q, ids), columns)

    given = spark.createDataFrame([(3, [" x", "more"]), (4, []), (5, ["t0", "", "t0"]), (777, ["new"])], "question_id long, tags array<string>")
    t.merge(K.tag_changes(t.near(given), given))
    want_t = B.set_tags(tags, given)
    assert rows(t.read(), ["question_id", "tag"]) == rows(want_t, ["question_id", "tag"])
    t.merge(K.change(t.read(), K.DELETE))  # every row: buckets keep only keys that are gone
    assert t.read().count() == 0 and t.merge(K.change(tags.limit(1))) and rows(t.read(), ["question_id", "tag"]) == rows(tags.limit(1), ["question_id", "tag"])


def test_last_change_of_a_key_counts_and_nothing_is_nothing(spark, tmp_path):
    table = K.BucketedTable(spark, f"file://{tmp_path}/x", n_buckets=4).create(spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id long, text string"))
    one, two = (spark.createDataFrame(r, "id long, text string") for r in ([(1, "c"), (3, "d")], [(3, "e"), (2, None)]))
    table.merge(K.change(one), K.change(two.filter("id = 3")), K.change(two.filter("id = 2"), K.DELETE))
    assert sorted(map(tuple, table.read().collect()), key=str) == sorted([(1, "c"), (3, "e"), (None, "n")], key=str)
    before = files(table)
    assert table.merge(K.change(one.filter("false"))) == [] and files(table) == before


def test_ten_questions_touch_ten_buckets_of_many(spark, tmp_path):
    n = 1_000_000
    base = spark.range(1, n + 1).select("id", F.lit("active").alias("status"), F.lit(None).cast("long").alias("derived_from"))
    table = K.BucketedTable(spark, f"file://{tmp_path}/many", n_buckets=200).create(base)
    before = files(table)
    batch = spark.createDataFrame([(i, f"問{i}。1つ選べ。", 3, "12345", "a", "active") for i in range(10)], "batch_key long, stem_html string, choice_set_id long, choice_order string, correct string, status string")
    puts, _, _ = K.register_changes(batch, table.top(), 0)
    assert len(table.merge(puts)) <= 10
    after = files(table)
    assert len(before) == 200 and sum(after.get(p) == at for p, at in before.items()) >= 190
    assert table.top() == n + 10 and table.read().count() == n + 10

"""Published values, boundaries and broken inputs."""

from __future__ import annotations

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from itemlake.functions import columns as C
from itemlake.operators import bank as M
from itemlake.operators import graph as G
from itemlake.operators import reports as R
from itemlake.operators import stats as S
from itemlake.operators import validate as V
from itemlake.sources import frequency, sinks, textruns


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(x, int) else 'double' if isinstance(x, float) else 'string'}" for k, x in values.items())).select(column.alias("x")).first().x


GOLDEN = {"b": 1, "ab": 7, "ac": 4, "ad": 112, "ae": 6, "bc": 3, "bd": 2, "cd": 1, "de": 3}


def golden(spark):
    counts = spark.createDataFrame([(1, 10, p, n) for p, n in GOLDEN.items()], "exam_id long, qversion_id long, pattern string, cnt long")
    items = spark.createDataFrame([(1, 10, "ad", "X2")], "exam_id long, qversion_id long, correct string, item_type string")
    return counts, items


def test_published_item(spark):
    counts, items = golden(spark)
    r = S.item_stats(counts, items).first()
    assert (r.n, r.n_correct, r.top_wrong_pattern, r.top_wrong_count) == (139, 112, "ab", 7)
    assert [round(r[f"sel_{x}"] * 139) for x in "abcde"] == [129, 13, 8, 118, 9]
    assert r.p == pytest.approx(112 / 139) and r.overselect_rate == pytest.approx(1 / 139)
    assert {x.hits: x.persons for x in S.partial_credit(counts, items).collect()} == {0: 4, 1: 23, 2: 112}
    assert one(spark, C.is_disc_on_grid(F.col("d"), F.col("n")), d=0.529, n=139) and not one(spark, C.is_disc_on_grid(F.col("d"), F.col("n")), d=0.51, n=139)
    assert not one(spark, C.is_disc_on_grid(F.col("d"), F.col("n")), d=0.5, n=3)


def test_empty_counts(spark):
    counts, items = golden(spark)
    assert S.item_stats(counts.filter("false"), items).count() == 0
    assert S.top_wrong_k(counts.filter("false"), items).count() == 0


@pytest.mark.parametrize(
    "stem, kind",
    [("どれか。1つ選べ。", "A"), ("２つ選べ。", "X2"), ("三つを選べ", "X3"), ("<strong>すべて</strong>選べ。1つ選べ", "XX"), ("5つ選べ", None), ("7つ選べ", None), ("選べ", None), ("", None), (None, None)],
)
def test_item_type(spark, stem, kind):
    assert spark.createDataFrame([(stem,)], "s string").select(C.item_type(F.col("s")).alias("x")).first().x == kind


def test_columns(spark):
    f = lambda c, s: spark.createDataFrame([(s,)], "s string").select(c(F.col("s")).alias("x")).first().x
    assert f(C.normalize_correct, "ＤＡa x") == "ad"
    assert f(C.strip_tags, "a<i>b</i> &lt;c&gt; &amp;lt;") == "ab <c> &lt;"
    assert f(C.clean_markup, '<p>x<I class="k">y</I><i>z</i><!-- n --><script></script></p>') == "x<i>yz</i>"
    assert f(C.normalize_choice, "横　紋") == "横紋" and f(C.render_choice, "横紋") == "横　紋"
    assert f(C.normalize_choice, "滑膜 A 型細胞") == "滑膜 A 型細胞"
    assert f(C.nfkc, "ｱ①Ａ") == "ア1A"
    assert f(lambda c: C.set_instruction(c, F.lit("X2")), "1つ選べ。または3つ選べ。続き") == "1つ選べ。または2つ選べ。続き"
    assert f(lambda c: C.set_instruction(c, F.lit("XX")), "どれか。") == "どれか。すべて選べ。"
    assert f(C.is_choice_order, "31524") and not f(C.is_choice_order, "31523")
    assert f(lambda c: C.encode_flags(C.decode_flags(c)), "b,a,,b") == "a,b"
    assert f(C.exam_year, "2025-08-25") == 2025 and f(C.exam_year, "x") is None
    assert spark.createDataFrame([(0.525, "X2", 0.529, True)], "p double, k string, d double, n boolean").select(C.candidate_label(F.col("p"), F.col("k"), F.col("d"), F.col("n")).alias("x")).first().x.startswith("正答率52%(X2) D=0.529")
    assert [(r.pattern, r.ord, r.size) for r in C.all_patterns(spark).orderBy("ord").collect()] == [("".join(p), i, len(p)) for i, p in enumerate(p for k in range(1, 6) for p in combinations("abcde", k))]


def test_nfkc_of_whole_texts(spark, sf_dir):
    import unicodedata

    odd = "①ﾊﾟＡｂ　ﬁ㍿e\u0301"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat("text", F.lit(odd)).alias("text"))
    rows = docs.select("text", C.nfkc(F.col("text")).alias("x")).collect()
    assert rows and all(r.x == (None if r.text is None else unicodedata.normalize("NFKC", r.text)) for r in rows)


def test_character_references(spark):
    import html

    said = ["a &lt;b&gt; &amp;lt; &amp;amp;", "&#233;&#xE9;&#Xe9;&#128;&#0;&#55296;&#1114112;&#39", "&copy &notit; &notin; &nosuch; &am &amp", "&&&#12;x&", "&Eacute;&hellip;&ndash;&nbsp;x", "no", "", "&#x1F600;&acE;&lt&gt"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").select("i", C.strip_tags(F.col("t")).alias("x")).collect()
    assert {r.i: r.x for r in got} == {i: html.unescape(t) for i, t in enumerate(said)}


def table(rows: dict[str, dict[str, float]], legacy: bool = True, keys: str = "b") -> str:
    names = [*C.PATTERNS, "空白"]
    lines = ["#試験名,x", "#試験日,2025-08-25", "#受験者数,10", "問題,正答肢,正答率,正答数,識別係数," + ",".join(names)] if legacy else ["問,配点,措置,正答,正答率(%),識別係数,点双列相関," + ",".join([*C.PATTERNS, "無解答", "その他"])]
    for pos, counts in rows.items():
        cells = [f"{counts.get(n if n != '空白' else '', 0):g}" for n in names]
        hit = counts.get(keys, 0)
        lines.append(f"{pos},{keys},{hit / 10},{hit:g},0.5," + ",".join(cells) if legacy else f"{pos},5,none,{keys},{hit * 10},0.5,0.1," + ",".join([*cells, "0"]))
    return "﻿" + "\r\n".join(lines) + "\r\n"


def scanned(spark, tmp_path, text: str):
    (tmp_path / "t.csv").write_bytes(text.encode())
    s = frequency.scan_item_stats(spark, str(tmp_path))
    exam = F.lit(1).cast("long").alias("exam_id")
    items = spark.createDataFrame([(1, 1, "b"), (1, 2, "b")], "exam_id long, position long, correct_asked string")
    return s, V.validate_stats(
        s.rows.select(exam, "*"), items, s.counts.select(exam, "*"), s.columns.select(exam, "*"), s.meta.select(exam, "n_examinees"), s.non_mcq.groupBy(exam).agg(F.count(F.lit(1)).alias("n_non_mcq"))
    )


GOOD = {"1": {"b": 7, "a": 3}, "2": {"b": 6, "ab": 3, "": 1}}


def test_clean_tables_have_no_blocking_issue(spark, tmp_path):
    s, issues = scanned(spark, tmp_path, table(GOOD))
    assert [r.code for r in issues.collect() if r.blocking] == []
    assert s.dialects.first().dialect == "legacy" and s.meta.first().n_examinees == 10 and s.examinees.first().effective_n == 10
    assert frequency.whole_counts(s.counts).count() == 5


def test_percent_dialect_with_free_responses(spark, tmp_path):
    text = table(GOOD, legacy=False) + "3,3,none,記述式,38.4,0.7,0.4," + ",".join("-" * 33) + "\r\n"
    s, issues = scanned(spark, tmp_path, text)
    assert s.dialects.first().dialect == "ssdb" and s.rows.count() == 2 and s.non_mcq.count() == 1
    assert s.rows.filter("position = 1").first().p_reported == pytest.approx(0.7)
    assert {r.code for r in issues.collect()} == {"n_not_declared", "non_mcq_skipped"}


@pytest.mark.parametrize(
    "change, code",
    [
        (lambda t: t.replace(",空白", "").replace(",0\r\n", "\r\n").replace(",1\r\n", "\r\n"), "pattern_columns_missing"),
        (lambda t: t.replace("\r\n1,b,", "\r\n1,a,"), "correct_mismatch"),
        (lambda t: t.replace("0.5,3,7,", "0.5,0.3,0.7,"), "count_not_integer"),
        (lambda t: t.replace("0.5,3,7,", "0.5,4,7,"), "total_mismatch"),
        (lambda t: t.replace("0.5,3,7,", "0.5,x,7,"), "count_unreadable"),
        (lambda t: t.replace("0.5,3,7,", "0.5,-3,7,"), "count_negative"),
        (lambda t: "\r\n".join(t.split("\r\n")[:-2]) + "\r\n", "row_count"),
        (lambda t: t.replace("#受験者数,10", "#受験者数,11"), "n_mismatch"),
        (lambda t: t.replace("空白", "空白2"), "pattern_columns_extra"),
        (lambda t: t.replace("1,b,0.7,", "1,b,0.9,"), "p_mismatch"),
    ],
)
def test_broken_tables_block(spark, tmp_path, change, code):
    _, issues = scanned(spark, tmp_path, change(table(GOOD)))
    assert code in {r.code for r in issues.collect() if r.blocking}
    assert V.gate(issues).first().blocked


def test_components_join_cycles_and_ignore_nulls(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8), (7, 7), (None, 4)] + [(i, i + 1) for i in range(20, 60)], "a long, b long")
    got = {r.node: r.component for r in G.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {i: 20 for i in range(20, 61)}
    assert G.connected_components(edges.filter("false")).count() == 0


def test_choice_order_with_equal_texts(spark):
    items = spark.createDataFrame([(1, n, t) for n, t in enumerate(["x", "y", "x", "z", "w"], 1)], "choice_set_id long, item_no long, text_html string")
    printed = spark.createDataFrame([(1, 1, ["x", "x", "w", "z", "y"]), (2, 1, ["x", "q", "w", "z", "y"])], "batch_key long, choice_set_id long, texts array<string>")
    assert {r.batch_key: r.choice_order for r in M.resolve_choice_order(printed, items).collect()} == {1: "13542", 2: None}


def bank(spark):
    q = spark.createDataFrame([(1, "active", None), (2, "draft", None)], "id long, status string, derived_from long")
    v = spark.createDataFrame([(1, 1, 1, 1, "12345", "a", "何か。1つ選べ。"), (2, 2, 1, 1, "12345", "ab", "別。2つ選べ。")], "id long, question_id long, version_no int, choice_set_id long, choice_order string, correct string, stem_html string")
    return q, v


def test_register_revise_derive(spark):
    q, v = bank(spark)
    batch = spark.createDataFrame([(1, "新。1つ選べ。", 1, "12345", "b", "active"), (2, "悪い。1つ選べ。", 1, "12345", "bc", "active"), (3, "下書き", 1, "12345", "", "draft")], "batch_key long, stem_html string, choice_set_id long, choice_order string, correct string, status string")
    q2, v2, report = M.register_questions(q, v, batch)
    assert {r.batch_key: (r.question_id, r.blocked) for r in report.collect()} == {1: (3, False), 2: (None, True), 3: (4, False)}
    assert q2.count() == 4 and v2.count() == 4
    revise = spark.createDataFrame([(1, "何か、正しく。1つ選べ。", 1, "12345", "a"), (2, "別。2つ選べ。", 1, "54321", "ab")], "question_id long, stem_html string, choice_set_id long, choice_order string, correct string")
    v3, said = M.revise_questions(v, q, revise)
    assert {r.question_id: (r.version_no, r.created_new_version) for r in said.collect()} == {1: (1, False), 2: (2, True)}
    assert v3.filter("id = 1").first().stem_html == "何か、正しく。1つ選べ。" and v3.count() == 3
    tags = spark.createDataFrame([(1, "t")], "question_id long, tag string")
    derived = M.derive_questions(q, v, tags, batch.filter("batch_key = 1").withColumn("derived_from", F.lit(1).cast("long")))
    assert {(r.question_id, r.tag) for r in derived[2].collect()} == {(1, "t"), (3, "t")}
    assert {r.question_id: r.family_id for r in G.derivation_family(derived[0], derived[1]).collect()} == {1: 1, 2: 2, 3: 1}


def test_exam_cycle(spark):
    q, v = bank(spark)
    exams = M.create_exams(spark.createDataFrame([], "id long, name string, exam_date string, status string"), spark.createDataFrame([("m", "2025-01-01")], "name string, exam_date string"))
    none = spark.createDataFrame([], "exam_id long, position long, qversion_id long, correct_asked string")
    items, issues = M.set_exam_items(none, exams, v, spark.createDataFrame([(1, 1, 1), (9, 1, 1)], "exam_id long, position long, qversion_id long"))
    assert [r.code for r in issues.collect()] == ["exam_locked"] and items.count() == 1
    done = M.finalize_exams(exams, issues.filter("exam_id = 1"))
    assert done.first().status == "finalized"
    counts = spark.createDataFrame([(1, 1, "a", 8.0), (1, 1, "b", 2.0), (1, 5, "a", 1.0)], "exam_id long, position long, pattern string, cnt double")
    disc = spark.createDataFrame([(1, 1, 0.5)], "exam_id long, qversion_id long, disc double")
    out, stats = M.apply_stats(done, items, v, counts, disc, issues.filter("exam_id = 1"))
    assert (out.first().status, out.first().n_examinees) == ("imported", 10) and stats.first().p == pytest.approx(0.8)


def test_import_exams(spark):
    q, v = bank(spark)
    empty = lambda s: spark.createDataFrame([], s)
    old = {
        "sets": empty("id long, signature string"), "set_items": empty("choice_set_id long, item_no long, text_html string"), "questions": q, "versions": v,
        "exam_items": empty("exam_id long, position long, qversion_id long, correct_asked string"), "exams": spark.createDataFrame([(1, "2024-01-01", "draft")], "id long, exam_date string, status string"),
    }
    parsed = spark.createDataFrame([(1, 1, "甲。1つ選べ。", list("pqrst")), (1, 2, "乙。1つ選べ。", list("tsrqp"))], "exam_id long, position long, stem_html string, texts array<string>")
    rows = spark.createDataFrame([(1, 1, "a", 4.0), (1, 2, "b", 4.0)], "exam_id long, position long, correct string, total double")
    counts = spark.createDataFrame([(1, 1, "a", 3.0), (1, 1, "c", 1.0), (1, 2, "b", 4.0)], "exam_id long, position long, pattern string, cnt double")
    new, issues = M.import_exams(old, parsed, rows, counts, empty("exam_id long, qversion_id long, disc double"))
    assert not [r for r in issues.collect() if r.blocking]
    assert new["sets"].count() == 1 and new["exams"].first().status == "imported" and new["stats"].count() == 2
    assert {r.choice_order for r in new["versions"].filter("id > 2").collect()} == {"12345", "54321"}


def test_sinks_round_trip(spark, tmp_path):
    items = spark.createDataFrame([(1, 2, "da"), (1, 1, "b"), (2, 1, "e")], "exam_id long, position long, correct_asked string")
    sinks.write_answer_key(items, f"{tmp_path}/key")
    got = frequency.read_answer_key(spark, [f"{tmp_path}/key/exam_id=1", f"{tmp_path}/key/exam_id=2"])
    assert sorted((r.position, r.correct) for r in got.collect()) == [(1, "b"), (1, "e"), (2, "ad")]
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "exam_id long, v string")
    sinks.replace_exams(rows, f"{tmp_path}/t")
    sinks.replace_exams(spark.createDataFrame([(2, "z")], "exam_id long, v string"), f"{tmp_path}/t")
    assert sorted((r.exam_id, r.v) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(1, "x"), (2, "z")]
    sinks.write_tables({"a": rows}, f"{tmp_path}/r", "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/r/a").count() == 2


def test_text_runs(spark):
    runs = spark.createDataFrame(
        [(1, 0, 0, "1 ", []), (1, 0, 1, "Strep", ["i"]), (1, 0, 2, "tococcus", ["i"]), (1, 0, 3, "は<何", ["sub", "i"]), (1, 1, 0, "続き", None), (1, 2, 0, "ａ．甲", []), (1, 3, 0, "12", []), (1, 4, 0, "迷子", []), (1, 5, 0, "", [])],
        "doc_id long, paragraph int, run_no int, text string, formats array<string>",
    )
    islands = textruns.merge_runs(runs)
    assert islands.filter("paragraph = 0").count() == 3
    assert textruns.fragment_html(islands).filter("paragraph = 0").first().html == "1 <i>Streptococcus</i><i><sub>は&lt;何</sub></i>".replace("</i><i>", "")
    kept, skipped = textruns.drop_noise(textruns.paragraphs_of(runs))
    assert [r.text for r in skipped.collect()] == ["12"]
    got = {r.paragraph: (r.number, r.kind, r.label) for r in textruns.segment_questions(kept).collect()}
    assert got == {0: (1, "stem", None), 1: (1, "continuation", None), 2: (1, "choice", "a"), 4: (1, "stray", None)}


def test_strata_and_matrix_need_no_rows(spark, sf_dir):
    from itemlake.plans.queries import Views

    v = Views(spark, sf_dir)
    assert R.strata(v.report.filter("false")).count() <= 1
    assert R.set_item_matrix(v.dated.filter("false")).count() == 0

"""Validation as queries: every check yields issue rows, and a gate per exam decides."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itemlake.functions import columns as C
from itemlake.plans.scratch import materialise

ISSUE = ["exam_id", "position", "code", "blocking", "message"]
P_TOLERANCE = 1e-3


@dataclass(frozen=True)
class ExamLimits:
    max_per_set_group: int = 2
    max_negative: int | None = None
    max_negative_ratio: float | None = None
    type_distribution: dict = field(default_factory=dict)


def _issues(df: DataFrame, code: str, blocking: bool, message: Column | str, position: Column | None = None) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return df.select("exam_id", (F.col("position") if position is None else position).cast("long").alias("position"), F.lit(code).alias("code"), F.lit(blocking).alias("blocking"), text.alias("message"))


def union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _whole(df: DataFrame, code: str, blocking: bool, message: Column | str) -> DataFrame:
    return _issues(df, code, blocking, message, F.lit(None))


def _by_rules(df: DataFrame, rules: list[tuple]) -> DataFrame:
    """Issues of several rules (condition, code, blocking, message) in one pass over df."""
    found = [F.when(rule, F.struct(F.lit(code).alias("code"), F.lit(blocking).alias("blocking"), (F.lit(text) if isinstance(text, str) else text).alias("message"))) for rule, code, blocking, text in rules]
    return df.select("exam_id", F.col("position").cast("long").alias("position"), F.explode(F.array_compact(F.array(*found))).alias("i")).select("exam_id", "position", "i.*")


def header_issues(columns: DataFrame, required: Iterable[str] = ("position", "correct", "p", "disc")) -> DataFrame:
    """From columns (exam_id, role, key, n): missing fixed columns, and pattern columns missing, unknown or doubled. key is the pattern of a count column."""
    exams = columns.select("exam_id").distinct()
    spark = columns.sparkSession
    fixed = spark.createDataFrame([(r,) for r in required], "role string")
    have = columns.select("exam_id", "role").distinct()
    lost = exams.join(F.broadcast(fixed)).join(have, ["exam_id", "role"], "left_anti").groupBy("exam_id").agg(F.array_join(F.array_sort(F.collect_list("role")), ", ").alias("t"))
    known = spark.createDataFrame([(p,) for p in [*C.PATTERNS, C.BLANK]], "key string")
    counts = columns.filter("role = 'count'").select("exam_id", "key")
    told = F.array_join(F.array_sort(F.collect_list(F.when(F.col("key") == "", "blank").otherwise(F.col("key")))), ", ").alias("t")
    missing = counts.select("exam_id").distinct().join(F.broadcast(known)).join(counts, ["exam_id", "key"], "left_anti").groupBy("exam_id").agg(told)
    extra = counts.filter(~F.col("key").isin(*C.PATTERNS, C.BLANK, C.OTHER)).distinct().groupBy("exam_id").agg(told)
    doubled = counts.groupBy("exam_id", "key").count().filter("count > 1").groupBy("exam_id").agg(told)
    return union([
        _whole(lost, "csv_missing_columns", True, _text("missing columns: ", F.col("t"))), _whole(missing, "pattern_columns_missing", True, _text("missing count columns: ", F.col("t"))),
        _whole(extra, "pattern_columns_extra", True, _text("unknown count columns: ", F.col("t"))), _whole(doubled, "pattern_columns_duplicate", True, _text("count columns for the same answers: ", F.col("t"))),
    ])


def count_issues(counts: DataFrame) -> DataFrame:
    """From raw counts (exam_id, position, pattern, cnt double, unreadable): cells that can't be read, are negative or no whole numbers."""
    per = counts.groupBy("exam_id", "position").agg(
        F.bool_or("unreadable").alias("bad"), F.bool_or(F.col("cnt") < 0).alias("neg"), F.bool_or(F.col("cnt") != F.floor("cnt")).alias("part"),
    )
    return union([
        _issues(per.filter("bad"), "count_unreadable", True, "a count can't be read"), _issues(per.filter("neg"), "count_negative", True, "a count is negative"),
        _issues(per.filter("part"), "count_not_integer", True, "a count isn't a whole number; shares instead of persons?"),
    ])


def validate_stats(rows: DataFrame, exam_items: DataFrame, counts: DataFrame | None = None, columns: DataFrame | None = None, declared: DataFrame | None = None, non_mcq: DataFrame | None = None) -> DataFrame:
    """Issues of imported frequency rows against the exam's items.

    rows: exam_id, position, correct, total, and where known p_reported, n_correct_reported, counted (of
    the key's pattern), disc, adjustment. declared: exam_id, n_examinees. non_mcq: exam_id, n_non_mcq.
    """
    from itemlake.operators.stats import modal_total

    for name, kind in (("p_reported", "double"), ("n_correct_reported", "long"), ("counted", "double"), ("disc", "double"), ("adjustment", "string")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    parts = []
    if columns is not None:
        parts.append(header_issues(columns))
    if non_mcq is not None:
        parts.append(_whole(non_mcq.filter("n_non_mcq > 0"), "non_mcq_skipped", False, _text(F.col("n_non_mcq"), " items without options are skipped")))
    if counts is not None:
        parts.append(count_issues(counts))
    sizes = rows.groupBy("exam_id").agg(F.count(F.lit(1)).alias("n_rows"))
    asked = exam_items.groupBy("exam_id").agg(F.count(F.lit(1)).alias("n_items"))
    uneven = sizes.join(asked, "exam_id", "full").filter("coalesce(n_rows, 0) <> coalesce(n_items, 0)")
    parts.append(_whole(uneven, "row_count", True, _text(F.coalesce("n_rows", F.lit(0)), " rows for ", F.coalesce("n_items", F.lit(0)), " items")))
    totals = rows.groupBy("exam_id").agg(F.countDistinct("total").alias("kinds"), F.max("total").alias("n"))
    odd = rows.join(modal_total(rows), "exam_id").filter("total <> modal_total")
    odd = odd.groupBy("exam_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("position")), lambda x: x.cast("string")), ",").alias("t"))
    parts.append(_whole(odd, "total_mismatch", True, _text("totals differ at positions ", F.col("t"))))
    told = totals if declared is None else totals.join(declared, "exam_id", "left")
    if declared is None:
        told = told.withColumn("n_examinees", F.lit(None).cast("long"))
    guess = F.when(F.col("kinds") == 1, _text("number of examinees not declared; taken as ", F.col("n").cast("long"))).otherwise("number of examinees not declared, and totals differ")
    parts.append(_whole(told.filter("n_examinees is null"), "n_not_declared", False, guess))
    parts.append(_whole(told.filter("kinds = 1 and cast(n as bigint) <> n_examinees"), "n_mismatch", True, _text("total ", F.col("n").cast("long"), " against ", F.col("n_examinees"), " declared")))
    parts.append(_issues(rows.filter("coalesce(adjustment, '') not in ('', 'none')"), "adjusted_item", False, _text("scored with an adjustment: ", F.col("adjustment"))))
    both = rows.join(exam_items.select("exam_id", "position", "correct_asked"), ["exam_id", "position"], "left")
    parts.append(_issues(both.filter("correct_asked is null"), "position_unknown", True, "no such position in the exam"))
    keys = both.filter("correct_asked is not null").filter(C.normalize_correct(F.coalesce("correct", F.lit(""))) != C.normalize_correct(F.col("correct_asked")))
    parts.append(_issues(keys, "correct_mismatch", True, _text("key ", F.coalesce("correct", F.lit("")), " where ", F.col("correct_asked"), " was asked")))
    parts.append(_issues(rows.filter("n_correct_reported is not null and counted <> n_correct_reported"), "n_correct_mismatch", True, _text(F.col("counted"), " chose the key, ", F.col("n_correct_reported"), " reported")))
    parts.append(_issues(rows.filter(F.col("p_reported").isNotNull() & (F.col("total") > 0) & (F.abs(F.col("counted") / F.col("total") - F.col("p_reported")) > P_TOLERANCE)), "p_mismatch", True, _text("reported rate ", F.col("p_reported"), " isn't the share of the key")))
    parts.append(_issues(rows.filter(F.col("disc").isNotNull() & (F.col("total") > 0) & ~C.is_disc_on_grid(F.col("disc"), F.col("total").cast("long"))), "disc_off_grid", False, _text("index ", F.col("disc"), " isn't a multiple of the step")))
    return union(parts)


def emphasis_issues(items: DataFrame, choices: DataFrame | None = None) -> DataFrame:
    """Warnings where stem emphasis and negative words don't go together, and where a choice (exam_id, position, text_html) is emphasised."""
    strong, words = C.is_negative(F.col("stem_html")), C.contains_any(F.col("stem_html"))
    parts = [
        _issues(items.filter(words & ~strong), "emphasis_missing", False, "a negative word without emphasis"),
        _issues(items.filter(strong & ~words), "emphasis_unexpected", False, "emphasis without a negative word"),
    ]
    if choices is not None:
        parts.append(_issues(choices.filter(C.has_tag(F.col("text_html"), "strong")), "emphasis_in_choice", False, "a choice is emphasised"))
    return union(parts)


def cross_validate(questions: DataFrame, rows: DataFrame, choices: DataFrame | None = None) -> DataFrame:
    """Parsed questions (exam_id, number, stem_html) against frequency rows (exam_id, position, correct): one full outer join."""
    sizes = questions.groupBy("exam_id").agg(F.count(F.lit(1)).alias("nq")).join(rows.groupBy("exam_id").agg(F.count(F.lit(1)).alias("nr")), "exam_id", "full")
    q = questions.select("exam_id", F.col("number").alias("position"), "stem_html", F.lit(True).alias("in_q"))
    both = q.join(rows.select("exam_id", "position", "correct", F.lit(True).alias("in_r")), ["exam_id", "position"], "full")
    met = both.filter("in_q and in_r").withColumn("type", C.item_type(F.col("stem_html"))).withColumn("n", F.length(C.normalize_correct(F.coalesce("correct", F.lit("")))))
    wrong = met.filter(F.col("type").isNotNull() & F.coalesce(C.required_count(F.col("type")) != F.col("n"), ~F.col("n").between(1, 5)))
    paired = met.select("exam_id", "position", "stem_html")
    return union([
        _whole(sizes.filter("coalesce(nq, 0) <> coalesce(nr, 0)"), "question_count_mismatch", True, _text(F.coalesce("nq", F.lit(0)), " questions, ", F.coalesce("nr", F.lit(0)), " rows")),
        _issues(both.filter("in_r is null"), "no_stats_row", True, "no frequency row for the question"), _issues(both.filter("in_q is null"), "no_question", True, "no question for the frequency row"),
        _issues(met.filter("type is null"), "type_underivable", True, _text("type can't be derived: ", C.type_problem(F.col("stem_html")))),
        _issues(wrong, "type_correct_mismatch", True, _text("type ", F.col("type"), " with ", F.col("n"), " keys")),
        emphasis_issues(paired, None if choices is None else choices.join(paired.select("exam_id", "position"), ["exam_id", "position"], "left_semi")),
    ])


def correct_issues(rows: DataFrame) -> DataFrame:
    """Keys that don't fit: rows (exam_id, position, correct, item_type)."""
    raw = C.trim_all(F.lower(C.narrow(F.coalesce("correct", F.lit("")))))
    r = rows.withColumn("raw", raw).withColumn("norm", C.normalize_correct(F.coalesce("correct", F.lit(""))))
    letters = F.filter(F.split("raw", ""), lambda c: c != "")
    known, need = F.col("item_type").isin(*C.ITEM_TYPES), C.required_count(F.col("item_type"))
    full = r.filter("norm <> ''")
    return union([
        _issues(r.filter(F.exists(letters, lambda c: ~c.isin(*C.LABELS))), "correct_bad_label", True, "letters other than a-e"),
        _issues(r.filter(F.size(letters) != F.size(F.array_distinct(letters))), "correct_duplicate", True, "a letter twice"),
        _issues(r.filter("norm = ''"), "correct_empty", True, "no key"), _issues(full.filter(~F.coalesce(known, F.lit(False))), "type_unknown", True, "the type isn't known"),
        _issues(full.filter(known & (F.length("norm") != need)), "correct_count", True, _text(F.col("item_type"), " with ", F.length("norm"), " keys")),
    ])


def validate_draft(rows: DataFrame, choices: DataFrame | None = None) -> DataFrame:
    """What saving a question checks: rows (exam_id, position, stem_html, correct, status); for drafts nothing blocks."""
    typed = rows.withColumn("item_type", C.item_type(F.col("stem_html")))
    found = union([
        _issues(typed.filter("item_type is null"), "type_underivable", True, _text("type can't be derived: ", C.type_problem(F.col("stem_html")))), correct_issues(typed), emphasis_issues(rows, choices),
    ])
    drafts = rows.filter("status = 'draft'").select("exam_id", "position", F.lit(True).alias("draft")).distinct()
    return found.join(drafts, ["exam_id", "position"], "left").withColumn("blocking", F.col("blocking") & F.col("draft").isNull()).select(*ISSUE)


def validate_items(items: DataFrame) -> DataFrame:
    """choice_set_id, code of sets that aren't five different non-empty texts (choice_set_id, item_no, text_html)."""
    t = C.trim_all(F.col("text_html"))
    per = items.groupBy("choice_set_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(t, F.lit("")) == "").alias("empty"), F.countDistinct("text_html").alias("kinds"), F.count("text_html").alias("texts"))
    one = lambda cond, code: per.filter(cond).select("choice_set_id", F.lit(code).alias("code"))
    return union([one("n <> 5", "not_five"), one("empty > 0", "empty"), one("kinds < texts", "duplicate")])


def parsed_issues(questions: DataFrame, choices: DataFrame) -> DataFrame:
    """Parsed questions (exam_id, position, stem_html) and their choices (exam_id, position, label, text_html)."""
    per = choices.groupBy("exam_id", "position").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("label")), "").alias("labels"))
    q = questions.join(per, ["exam_id", "position"], "left")
    return union([
        _issues(q.filter("coalesce(n, 0) <> 5"), "choice_count", True, _text(F.coalesce("n", F.lit(0)), " choices")),
        _issues(q.filter("n = 5 and labels <> 'abcde'"), "choice_labels", True, _text("labels ", F.col("labels"))),
        _issues(q.filter(C.item_type(F.col("stem_html")).isNull()), "type_underivable", True, _text("type can't be derived: ", C.type_problem(F.col("stem_html")))),
        emphasis_issues(questions, choices),
    ])


def finalize_checks(items: DataFrame, exams: DataFrame, status: DataFrame, families: DataFrame, groups: DataFrame, group_links: DataFrame, limits: ExamLimits = ExamLimits(), expected_positions: int | None = None) -> DataFrame:
    """Issues that decide whether an exam can be finalized.

    items: exam_id, position, qversion_id, question_id, correct, stem_html, item_type, choice_set_id.
    status: question_id, status. families: question_id, family_id. groups (choice_set_id, group_key) and
    group_links (group_key, linked_key, each linked to itself) as graph.set_groups and graph.group_links
    give them. Pair checks join within (exam, family); sets near one another are counted by group.
    """
    it = materialise(items.join(status, "question_id", "left"), "exam-items")  # read by every check
    e = exams.select(F.col("id").alias("exam_id"))
    places = it.groupBy("exam_id", F.col("position").cast("long").alias("position")).agg(F.count(F.lit(1)).alias("n"), F.count_if(C.is_negative(F.col("stem_html"))).alias("neg"))
    per = places.groupBy("exam_id").agg(  # an exam's positions
        F.sum("n").alias("n"), F.sum("neg").alias("neg"), F.array_sort(F.collect_list("position")).alias("at"), F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("position")))).alias("twice"),
    )
    total = F.lit(expected_positions).cast("long") if expected_positions is not None else F.col("n")
    gaps = F.array_except(F.when(total > 0, F.sequence(F.lit(1).cast("long"), total)), "at")
    told = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    exam_rules = [
        (F.size(gaps) > 0, "position_gap", True, _text("no item at ", told(gaps))), (F.size("twice") > 0, "position_duplicate", True, _text("positions used twice: ", told("twice"))),
    ]
    if limits.max_negative is not None:
        exam_rules.append((F.col("neg") > limits.max_negative, "negative_over_limit", False, _text(F.col("neg"), " negative items")))
    if limits.max_negative_ratio is not None:
        exam_rules.append((F.col("neg") / F.col("n") > limits.max_negative_ratio, "negative_over_ratio", False, _text(F.col("neg"), " negative items of ", F.col("n"))))
    same = Window.partitionBy("exam_id", "question_id").orderBy("position")
    again = it.withColumn("first", F.first("position").over(same)).withColumn("r", F.row_number().over(same))
    keyed, need = F.coalesce("correct", F.lit("")) != "", C.required_count(F.col("item_type"))
    item_rules = [
        (F.col("status") == "draft", "draft_included", True, "a draft can't be asked"), (F.col("status") == "retired", "retired_included", False, "a retired question"), (~keyed, "no_correct", True, "no key"),
        (keyed & F.col("item_type").isNull(), "type_underivable", True, _text("type can't be derived: ", C.type_problem(F.col("stem_html")))),
        (keyed & (F.length("correct") != need), "correct_count", True, _text(F.col("item_type"), " with ", F.length("correct"), " keys")),
        (F.col("r") > 1, "duplicate_question", True, _text("same question as position ", F.col("first"))),
    ]
    parts = [_whole(e.join(per, "exam_id", "left_anti"), "empty_exam", True, "no items"), _by_rules(per.withColumn("position", F.lit(None)), exam_rules), _by_rules(again, item_rules)]
    fam = it.select("exam_id", "position", "question_id").join(families, "question_id")
    a, b = fam.select("exam_id", "family_id", F.col("position").alias("pa"), F.col("question_id").alias("qa")), fam.select("exam_id", "family_id", "position", "question_id")
    related = a.join(b, ["exam_id", "family_id"]).filter("position > pa and question_id <> qa")
    parts.append(_issues(related, "derived_together", True, _text("derived from the same question as position ", F.col("pa"))))
    if limits.max_per_set_group:
        sets = it.groupBy("exam_id", "choice_set_id").agg(F.count(F.lit(1)).alias("n")).join(groups, "choice_set_id")
        asked = sets.groupBy("exam_id", F.col("group_key").alias("linked_key")).agg(F.sum("n").alias("n"))
        near = asked.join(group_links, "linked_key").groupBy("exam_id", "group_key").agg(F.sum("n").alias("n")).filter(F.col("n") > limits.max_per_set_group)
        over = sets.select("exam_id", "choice_set_id", "group_key").join(near, ["exam_id", "group_key"])
        parts.append(_whole(over, "set_group_over_limit", False, _text(F.col("n"), " items of set ", F.col("choice_set_id"), " and those near it")))
    if limits.type_distribution:
        want = items.sparkSession.createDataFrame(list(limits.type_distribution.items()), "item_type string, want int")
        got = it.groupBy("exam_id", F.coalesce("item_type", F.lit("?")).alias("item_type")).agg(F.count(F.lit(1)).alias("got"))
        off = per.select("exam_id").join(F.broadcast(want)).join(got, ["exam_id", "item_type"], "left").filter("coalesce(got, 0) <> want")
        parts.append(_whole(off, "type_distribution", False, _text(F.col("item_type"), ": ", F.coalesce("got", F.lit(0)), " of ", F.col("want"))))
    return union(parts)


def gate(issues: DataFrame) -> DataFrame:
    """exam_id, blocked, n_blockers, n_warnings."""
    return issues.groupBy("exam_id").agg(F.bool_or("blocking").alias("blocked"), F.count_if("blocking").alias("n_blockers"), F.count_if(~F.col("blocking")).alias("n_warnings"))

"""Item and exam statistics from answer-pattern counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itemlake.functions import columns as C
from itemlake.plans.carry import in_order, last_before

ITEM = ["exam_id", "qversion_id"]


@dataclass(frozen=True)
class FlagThresholds:
    """Limits of the automatic flags; comparisons are strict."""

    dead_distractor_rate: float = 0.05
    overselect_rate: float = 0.10
    low_disc: float = 0.10
    persistent_min_exams: int = 2


def pattern_counts(responses: DataFrame, pattern: str = "pattern") -> DataFrame:
    """exam_id, qversion_id, pattern, cnt from one row per answer; keys may be hot, counts combine map-side."""
    return responses.groupBy(*ITEM, F.col(pattern).alias("pattern")).agg(F.count(F.lit(1)).alias("cnt"))


def keyed_items(exam_items: DataFrame, versions: DataFrame) -> DataFrame:
    """exam_id, qversion_id, position, correct, item_type, question_id, stem_html and set of each item asked."""
    v = versions.select(F.col("id").alias("qversion_id"), "question_id", "version_no", "choice_set_id", "choice_order", "stem_html")
    return exam_items.join(v, "qversion_id").select(
        "exam_id", "qversion_id", "position", C.normalize_correct(F.col("correct_asked")).alias("correct"), C.item_type(F.col("stem_html")).alias("item_type"),
        "question_id", "version_no", "choice_set_id", "choice_order", "stem_html",
    )


def item_stats(counts: DataFrame, items: DataFrame, include_blank_in_overselect: bool = False) -> DataFrame:
    """Per (exam_id, qversion_id): n, n_correct, p, sel_a..sel_e, blank_rate, other_rate, overselect_rate, top_wrong_pattern, top_wrong_count.

    n counts blank and unclassifiable answers; marginal and over-select rates are over n; a wrong
    pattern leads by count, then by column order, and is null with count 0 where nobody was wrong.
    The over-select rate, of patterns with another number of options than asked, is null for types XX and unknown. One partial and one final aggregation.
    """
    c = counts.join(items.select(*ITEM, "correct", "item_type"), ITEM)
    cnt, pattern = F.col("cnt"), F.col("pattern")
    real = ~pattern.isin(C.BLANK, C.OTHER)
    need = C.required_count(F.col("item_type"))
    over = (real if not include_blank_in_overselect else pattern != C.OTHER) & (F.length(pattern) != need)
    wrong = real & (pattern != F.col("correct")) & (cnt > 0)
    rank = F.struct(cnt, -C.pattern_order(pattern))
    sums = c.groupBy(*ITEM, "correct", "item_type").agg(
        F.sum(cnt).alias("n"),
        F.sum(F.when(pattern == F.col("correct"), cnt).otherwise(0)).alias("n_correct"),
        *[F.sum(F.when(real & F.contains(pattern, F.lit(x)), cnt).otherwise(0)).alias(f"n_{x}") for x in C.LABELS],
        F.sum(F.when(pattern == C.BLANK, cnt).otherwise(0)).alias("n_blank"),
        F.sum(F.when(pattern == C.OTHER, cnt).otherwise(0)).alias("n_other"),
        F.sum(F.when(over, cnt).otherwise(0)).alias("n_over"),
        F.max_by(F.when(wrong, pattern), F.when(wrong, rank)).alias("top_wrong_pattern"),
        F.max(F.when(wrong, cnt)).alias("top_wrong_count"),
    )
    rate = lambda k: F.try_divide(F.col(k), F.col("n"))
    return sums.select(
        *ITEM, "n", "n_correct", rate("n_correct").alias("p"), *[rate(f"n_{x}").alias(f"sel_{x}") for x in C.LABELS],
        rate("n_blank").alias("blank_rate"), rate("n_other").alias("other_rate"),
        F.when(need.isNotNull(), rate("n_over")).alias("overselect_rate"),
        "top_wrong_pattern", F.coalesce("top_wrong_count", F.lit(0)).alias("top_wrong_count"), "correct", "item_type",
    )


def partial_credit(counts: DataFrame, items: DataFrame) -> DataFrame:
    """exam_id, qversion_id, hits, persons: how many marked so many of the correct options; blank and other count as 0 hits."""
    c = counts.filter("cnt > 0").join(items.select(*ITEM, "correct"), ITEM)
    hits = F.size(F.array_intersect(F.filter(F.split("pattern", ""), lambda x: x.isin(*C.LABELS)), F.split("correct", "")))
    return c.groupBy(*ITEM, hits.alias("hits")).agg(F.sum("cnt").alias("persons"))


def top_wrong_k(counts: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """exam_id, qversion_id, rank, pattern, cnt, share of the k most frequent wrong patterns, ties by column order."""
    n = Window.partitionBy(*ITEM)
    c = counts.join(items.select(*ITEM, "correct"), ITEM).withColumn("n", F.sum("cnt").over(n))
    c = c.filter(~F.col("pattern").isin(C.BLANK, C.OTHER) & (F.col("pattern") != F.col("correct")) & (F.col("cnt") > 0))
    rank = F.row_number().over(n.orderBy(F.desc("cnt"), C.pattern_order(F.col("pattern"))))
    return c.withColumn("rank", rank).filter(F.col("rank") <= k).select(*ITEM, "rank", "pattern", "cnt", F.try_divide("cnt", "n").alias("share"))


def exam_score_stats(scores: DataFrame) -> DataFrame:
    """exam_id, n, mean, sd (population), median of one score per examinee."""
    return scores.groupBy("exam_id").agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"), F.median("score").alias("median"))


def persistent_low_disc(stats: DataFrame, low: float = 0.10, min_exams: int = 2, scope: str = "other") -> DataFrame:
    """exam_id, qversion_id, persistent_low_disc from stats (exam_id, qversion_id, question_id, disc, exam_date).

    True where this exam's index and all those of the question's other exams are below low, with at
    least min_exams in all. scope 'earlier' looks at this and strictly earlier exams only.
    """
    low_or_null = F.when(F.col("disc").isNotNull(), (F.col("disc") < low).cast("int"))
    if scope == "other":
        w = Window.partitionBy("question_id")
    elif scope == "earlier":
        w = Window.partitionBy("question_id").orderBy(F.coalesce("exam_date", F.lit("")), "exam_id").rowsBetween(Window.unboundedPreceding, 0)
    else:
        raise ValueError(f"unknown scope: {scope}")
    seen, lows = F.count("disc").over(w), F.sum(low_or_null).over(w)
    flag = F.col("disc").isNotNull() & (seen >= min_exams) & (lows == seen)
    return stats.select(*ITEM, F.coalesce(flag, F.lit(False)).alias("persistent_low_disc"))


def emphasis_violation(stem: Column) -> Column:
    """A negative word without emphasis, or emphasis without one."""
    return C.is_negative(stem) != C.contains_any(stem)


def item_flags(stats: DataFrame, thresholds: FlagThresholds = FlagThresholds()) -> DataFrame:
    """exam_id, qversion_id, flags from item_stats with disc, question_id, exam_date and, if there, emphasis_violation."""
    persistent = persistent_low_disc(stats, thresholds.low_disc, thresholds.persistent_min_exams).withColumnRenamed("persistent_low_disc", "low")
    s = stats.join(persistent, ITEM)
    dead = F.lit(False)
    for x in C.LABELS:
        dead = dead | (~F.contains(F.col("correct"), F.lit(x)) & (F.col(f"sel_{x}") < thresholds.dead_distractor_rate))
    rules = [
        ("negative_disc", F.col("disc") < 0), ("persistent_low_disc", F.col("low")), ("dominant_wrong", F.col("top_wrong_count") > F.col("n_correct")),
        ("dead_distractor", dead), ("overselect", F.col("overselect_rate") > thresholds.overselect_rate),
        ("emphasis_rule", F.col("emphasis_violation") if "emphasis_violation" in stats.columns else F.lit(False)),
    ]
    return s.select(*ITEM, F.array_sort(F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules]))).alias("flags"))


def dated(stats: DataFrame, items: DataFrame, disc: DataFrame, exams: DataFrame) -> DataFrame:
    """item_stats with question_id, disc, exam_date and emphasis_violation: the input of flags, history and reports."""
    about = items.select(*ITEM, "position", "question_id", "version_no", "choice_set_id", "choice_order", "stem_html")
    e = exams.select(F.col("id").alias("exam_id"), "exam_date", F.col("status").alias("exam_status"))
    return (
        stats.join(about, ITEM).join(disc, ITEM, "left").join(e, "exam_id")
        .withColumn("negative", C.is_negative(F.col("stem_html"))).withColumn("emphasis_violation", emphasis_violation(F.col("stem_html")))
    )


def modal_total(rows: DataFrame) -> DataFrame:
    """exam_id, modal_total: the most common total of (exam_id, position, total), ties by the first position."""
    per = rows.groupBy("exam_id", "total").agg(F.count(F.lit(1)).alias("times"), F.min("position").alias("first"))
    return per.groupBy("exam_id").agg(F.max_by("total", F.struct("times", -F.col("first"))).alias("modal_total"))


def previous_stats(stats: DataFrame) -> DataFrame:
    """exam_id, qversion_id, prev_p, prev_disc: the question's strictly earlier exam with the latest date (then the largest id, then version).

    A null date on another exam sorts first; where this exam's date is null every other exam counts as earlier.
    Rows are sorted over range partitions by question and date, and what comes before a date is carried
    along (see plans.carry), so a question that holds half of all rows is as many tasks. Of the questions
    with an undated exam the two latest exams are aggregated.
    """
    cur = stats.select("question_id", F.coalesce("exam_date", F.lit("")).alias("date"), "exam_id", "qversion_id", "p", "disc")
    rows = in_order(cur, ["question_id", "date", "exam_id", "qversion_id"])
    found = last_before(rows, ["question_id"], ["date"], ["p", "disc"], "prev").filter("date <> ''").select(*ITEM, F.col("prev.p").alias("prev_p"), F.col("prev.disc").alias("prev_disc"))
    undated = rows.filter("date = ''").select("question_id", *ITEM)
    asked = rows.join(undated.select("question_id").distinct(), "question_id", "left_semi")
    exams = asked.groupBy("question_id", "exam_id").agg(F.max(F.struct("date", "exam_id", "qversion_id", "p", "disc")).alias("x"))
    top = exams.groupBy("question_id").agg(F.max("x").alias("top"))
    second = exams.join(top, "question_id").filter(F.col("exam_id") != F.col("top.exam_id")).groupBy("question_id").agg(F.max("x").alias("second"))
    other = undated.join(top, "question_id").join(second, "question_id", "left")
    prev = F.when(F.col("exam_id") != F.col("top.exam_id"), F.col("top")).otherwise(F.col("second"))
    return found.unionByName(other.select(*ITEM, prev["p"].alias("prev_p"), prev["disc"].alias("prev_disc")))

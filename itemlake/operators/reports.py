"""Read models: crosswalk, reports, strata, histories, choice sets and terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itemlake.functions import columns as C
from itemlake.operators.select import tags_of
from itemlake.operators.stats import ITEM, previous_stats, top_wrong_k
from itemlake.plans.heavy import most_frequent
from itemlake.plans.medians import medians
from itemlake.plans.scratch import materialise


def crosswalk(items: DataFrame, dated: DataFrame, exams: DataFrame, questions: DataFrame, tags: DataFrame) -> DataFrame:
    """What a teacher checks an exam against: position, ids, type, key, tags, last year and previous rate of the question.

    last_exam_year is the latest year of all other exams of the question, later ones included.
    """
    e = exams.select(F.col("id").alias("exam_id"), C.exam_year(F.col("exam_date")).alias("year"))
    every = Window.partitionBy("question_id")
    asked = items.select(*ITEM, "question_id").join(e, "exam_id").withColumn("at", F.struct("year", "exam_id")).withColumn("top", F.max("at").over(every))
    next_ = F.max(F.when(F.col("exam_id") != F.col("top.exam_id"), F.col("at"))).over(every)
    last = asked.select(*ITEM, F.when(F.col("exam_id") != F.col("top.exam_id"), F.col("top.year")).otherwise(next_["year"]).alias("last_exam_year"))
    return (
        items.join(last, ITEM, "left").join(previous_stats(dated), ITEM, "left").join(tags_of(questions, tags), "question_id", "left")
        .select("exam_id", "position", "question_id", "version_no", "item_type", C.is_negative(F.col("stem_html")).alias("negative"),
                F.col("prev_p").isNull().alias("is_new"), "correct", "tags", "last_exam_year", F.col("prev_p").alias("last_p"), "choice_set_id")
    )


def report_rows(dated: DataFrame, counts: DataFrame, items: DataFrame, flags: DataFrame, k: int = 5) -> DataFrame:
    """All statistics of an item with the previous rate and index, the change, flags, and the k leading wrong patterns as text."""
    lead = top_wrong_k(counts, items, k).groupBy(*ITEM).agg(F.array_sort(F.collect_list(F.struct("rank", "pattern", "cnt"))).alias("t"))
    lead = lead.select(*ITEM, F.array_join(F.transform("t", lambda x: F.concat(x["pattern"], F.lit(":"), x["cnt"].cast("string"))), " ").alias("top_wrong"))
    return (
        dated.join(previous_stats(dated), ITEM, "left").join(lead, ITEM, "left").join(flags, ITEM, "left")
        .withColumn("delta_p", F.col("p") - F.col("prev_p")).withColumn("top_wrong", F.coalesce("top_wrong", F.lit("")))
        .withColumn("type_rank", C.type_rank(F.col("item_type")))
    )


def report_order() -> list:
    return [F.col("exam_id"), F.col("type_rank"), F.col("position")]


def strata(rows: DataFrame) -> DataFrame:
    """stratum_kind, stratum, n_items, mean_p, median_p, mean_disc by negativity, by type and in all.

    Rates are counted per stratum and value first, on the map side; the median is read off a running sum of those counts.
    """
    kinds = F.array(
        F.struct(F.lit("negative").alias("kind"), F.when(F.col("negative"), "negative").otherwise("positive").alias("name")),
        F.struct(F.lit("item_type").alias("kind"), F.coalesce("item_type", F.lit("?")).alias("name")), F.struct(F.lit("total").alias("kind"), F.lit("total").alias("name")),
    )
    each = rows.select(F.explode(kinds).alias("s"), "p", "disc")
    per = each.groupBy("s", "p").agg(F.count(F.lit(1)).alias("n"), F.sum("disc").alias("sum_disc"), F.count("disc").alias("n_disc"))
    upto = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.when(F.col("p").isNotNull(), F.col("n")).otherwise(0)
    per = per.withColumn("upto", F.sum(known).over(upto)).withColumn("known", F.sum(known).over(Window.partitionBy("s")))
    at = lambda k: F.min(F.when(F.col("p").isNotNull() & (F.col("upto") > k), F.col("p")))
    middle = (at(F.expr("(known - 1) div 2")) + at(F.expr("known div 2"))) / 2
    return per.groupBy("s").agg(
        F.sum("n").alias("n_items"), F.try_divide(F.sum(F.col("p") * F.col("n")), F.sum(known)).alias("mean_p"), middle.alias("median_p"), F.try_divide(F.sum("sum_disc"), F.sum("n_disc")).alias("mean_disc")
    ).select(F.col("s.kind").alias("stratum_kind"), F.col("s.name").alias("stratum"), "n_items", "mean_p", "median_p", "mean_disc")


def pattern_report(counts: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    return top_wrong_k(counts, items, k).join(items.select(*ITEM, "position", "item_type", "correct"), ITEM)


def comparison_report(rows: DataFrame) -> DataFrame:
    """Items with a previous exam."""
    return rows.filter("prev_p is not null").select(*ITEM, "position", "question_id", "p", "prev_p", "delta_p", "disc", "prev_disc")


def flag_report(rows: DataFrame) -> DataFrame:
    """Items with any flag."""
    return rows.filter(F.size("flags") > 0).select(*ITEM, "position", "question_id", C.encode_flags(F.col("flags")).alias("flags"), "p", "disc")


def trend(dated: DataFrame) -> DataFrame:
    """question_id, seq, exam_date, version_no, p, disc, version_break: appearances by date, marked where the version changes."""
    w = Window.partitionBy("question_id").orderBy(F.coalesce("exam_date", F.lit("")), "exam_id", "version_no")
    before = F.lag("version_no").over(w)
    return dated.select(
        "question_id", F.row_number().over(w).alias("seq"), "exam_id", "exam_date", "version_no", "p", "disc",
        (before.isNotNull() & (before != F.col("version_no"))).alias("version_break"),
    )


def question_history(dated: DataFrame, lineage: DataFrame) -> DataFrame:
    """trend with the parent question and the number of derived questions."""
    children = lineage.groupBy(F.col("parent_id").alias("question_id")).agg(F.count(F.lit(1)).alias("n_children"))
    return trend(dated).join(lineage.select("question_id", "parent_id"), "question_id", "left").join(children, "question_id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def latest_appearance(dated: DataFrame) -> DataFrame:
    """Per version, its newest exam by date, then id."""
    w = Window.partitionBy("qversion_id").orderBy(F.coalesce("exam_date", F.lit("")).desc(), F.desc("exam_id"))
    return dated.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


# --- terms ------------------------------------------------------------------------------------


def item_appearances(dated: DataFrame, set_items: DataFrame) -> DataFrame:
    """exam_id, qversion_id, item_no, text_html, mark_rate, was_correct, question_p: five rows an asked item, one a choice."""
    long = dated.select(*ITEM, "choice_set_id", "choice_order", "correct", F.col("p").alias("question_p"), F.posexplode(F.array(*[F.col(f"sel_{x}") for x in C.LABELS])).alias("i", "mark_rate"))
    label = F.substring(F.lit(C.LABELS), F.col("i") + 1, F.lit(1))
    long = long.select(*ITEM, "choice_set_id", F.substring("choice_order", F.col("i") + 1, F.lit(1)).cast("long").alias("item_no"), "mark_rate", "question_p", F.contains("correct", label).alias("was_correct"))
    return long.join(set_items.select("choice_set_id", F.col("item_no").cast("long").alias("item_no"), "text_html"), ["choice_set_id", "item_no"])


def confusion_partner(appearances: DataFrame) -> DataFrame:
    """text_html, top_confused_with, top_confused_count, co_occurrences.

    For each appearance of a term as a key, the wrong choice with the largest mark rate (ties by
    text) leads; the partner is the most frequent leader (ties by text; see plans.heavy), and co_occurrences
    counts the key appearances in which it stood beside the term as a wrong choice, for that partner alone.
    """
    keys = appearances.filter("was_correct").select(*ITEM, "text_html", "item_no")
    wrong = appearances.filter("not was_correct").select(*ITEM, F.col("text_html").alias("other"), "mark_rate")
    wrong = wrong.groupBy(*ITEM, "other").agg(F.max("mark_rate").alias("mark_rate"))
    pairs = keys.join(wrong, ITEM).filter("other <> text_html")
    lead = pairs.groupBy(*ITEM, "text_html", "item_no").agg(F.min_by("other", F.struct(-F.col("mark_rate"), F.col("other"))).alias("other"))
    top = materialise(most_frequent(lead, "text_html", "other"), "partners")
    seen = pairs.join(top.select("text_html", "other"), ["text_html", "other"], "left_semi").groupBy("text_html", "other").agg(F.count(F.lit(1)).alias("co_occurrences"))
    return top.join(seen, ["text_html", "other"]).select("text_html", F.col("other").alias("top_confused_with"), F.col("n").alias("top_confused_count"), "co_occurrences")


def item_performance(appearances: DataFrame) -> DataFrame:
    """One row a term over all exams: appearances by role, two medians (see plans.medians) and the partner it is most confused with."""
    appearances = materialise(appearances.select(*ITEM, "item_no", "text_html", "mark_rate", "question_p", "was_correct"), "appearances")  # read for medians, counts and partners
    value = F.when(F.col("was_correct"), F.col("question_p")).otherwise(F.col("mark_rate"))
    role = materialise(medians(appearances, ["text_html", "was_correct"], value), "medians")
    of = lambda correct: F.max(F.when(F.col("was_correct") == correct, F.col("median")))
    middle = role.groupBy("text_html").agg(of(True).alias("median_p_when_correct"), of(False).alias("median_mark_rate_when_distractor"))
    counts = appearances.groupBy("text_html").agg(F.count(F.lit(1)).alias("appearances"), F.count_if("was_correct").alias("as_correct"), F.count_if(~F.col("was_correct")).alias("as_distractor"))
    per = counts.join(middle, "text_html")
    full = per.join(confusion_partner(appearances), "text_html", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return full.select(
        "text_html", "appearances", "as_correct", "as_distractor", "median_p_when_correct", "median_mark_rate_when_distractor", "top_confused_with",
        zero("top_confused_count"), zero("co_occurrences"),
    )


def term_order() -> list:
    return [F.desc("appearances"), F.col("text_html")]


def term_filter(performance: DataFrame, keyword: str = "", only_distractors: bool = False) -> DataFrame:
    """Terms whose stripped text has the keyword; if asked, only those never a key."""
    if keyword:
        performance = performance.filter(F.contains(C.strip_tags(F.col("text_html")), F.lit(keyword)))
    return performance.filter("as_correct = 0") if only_distractors else performance


# --- bank -------------------------------------------------------------------------------------


def tag_usage(questions: DataFrame, tags: DataFrame, all_tags: DataFrame | None = None) -> DataFrame:
    """tag, n_questions; tags of all_tags without a question count 0."""
    used = tags.join(questions.select(F.col("id").alias("question_id")), "question_id", "left_semi").groupBy("tag").agg(F.countDistinct("question_id").alias("n_questions"))
    if all_tags is None:
        return used
    return all_tags.select("tag").distinct().join(used, "tag", "left").select("tag", F.coalesce("n_questions", F.lit(0)).alias("n_questions"))


def exam_summary(exams: DataFrame, exam_items: DataFrame) -> DataFrame:
    n = exam_items.groupBy("exam_id").agg(F.count(F.lit(1)).alias("n_items"))
    return exams.join(n, exams["id"] == n["exam_id"], "left").select(exams["id"].alias("exam_id"), "exam_date", "status", F.coalesce("n_items", F.lit(0)).alias("n_items"))


def choice_set_summaries(set_items: DataFrame, versions: DataFrame, linked: DataFrame) -> DataFrame:
    """choice_set_id, n_versions, items (joined by ' / '), preview of four, linked sets (linked: choice_set_id, linked, the array of them)."""
    items = set_items.groupBy("choice_set_id").agg(F.array_sort(F.collect_list(F.struct("item_no", "text_html"))).alias("i"))
    n = versions.groupBy("choice_set_id").agg(F.count(F.lit(1)).alias("n_versions"))
    texts = F.transform("i", lambda x: x["text_html"])
    return items.join(n, "choice_set_id", "left").join(linked, "choice_set_id", "left").select(
        "choice_set_id", F.coalesce("n_versions", F.lit(0)).alias("n_versions"), F.array_join(texts, " / ").alias("items"),
        F.array_join(F.slice(texts, 1, 4), " / ").alias("preview"), F.coalesce(F.array_join(F.col("linked").cast("array<string>"), ","), F.lit("")).alias("linked"),
    )


def tagless_duplicates(items: DataFrame) -> DataFrame:
    """plain, set_ids: texts that are the same without markup but not with it."""
    s = items.withColumn("plain", C.strip_tags(F.col("text_html")))
    return s.groupBy("plain").agg(F.countDistinct("text_html").alias("n"), F.array_sort(F.collect_set("choice_set_id")).alias("set_ids")).filter("n > 1").select("plain", "set_ids")


def set_item_matrix(dated: DataFrame) -> DataFrame:
    """Per version of a set, the mark rate of each stable item at its latest appearance, and the item numbers of the key."""
    rate = lambda n: F.element_at(F.array(*[F.col(f"sel_{x}") for x in C.LABELS]), F.instr("choice_order", F.lit(str(n)))).alias(f"item_{n}")
    nos = F.array_join(F.transform(C.correct_to_item_nos(F.col("correct"), F.col("choice_order")), lambda x: x.cast("string")), "")
    return latest_appearance(dated).select("choice_set_id", "question_id", "qversion_id", "version_no", "exam_id", *[rate(n) for n in range(1, 6)], nos.alias("correct_item_nos"))


def unused_correct_items(set_items: DataFrame, versions: DataFrame) -> DataFrame:
    """choice_set_id, item_no of items that are no key in the latest version, within the set, of any question using it."""
    w = Window.partitionBy("choice_set_id", "question_id").orderBy(F.desc("version_no"))
    latest = versions.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    nos = latest.select("choice_set_id", C.correct_to_item_nos(F.col("correct"), F.col("choice_order")).cast("array<long>").alias("nos"))
    used = nos.select("choice_set_id", F.explode("nos").alias("item_no")).distinct()
    return set_items.select("choice_set_id", F.col("item_no").cast("long").alias("item_no")).distinct().join(used, ["choice_set_id", "item_no"], "left_anti")


def booklet_rows(items: DataFrame, set_items: DataFrame) -> DataFrame:
    """exam_id, position, label, item_no, text_html, rendered: the choices of an exam as printed."""
    long = items.select("exam_id", "position", "choice_set_id", F.posexplode(F.split("choice_order", "")).alias("i", "no")).filter("no <> ''")
    long = long.select("exam_id", "position", "choice_set_id", F.substring(F.lit(C.LABELS), F.col("i") + 1, F.lit(1)).alias("label"), F.col("no").cast("long").alias("item_no"))
    override = F.col("render_override") if "render_override" in set_items.columns else F.lit(None).cast("string")
    s = set_items.select("choice_set_id", F.col("item_no").cast("long").alias("item_no"), "text_html", override.alias("render_override"))
    return long.join(s, ["choice_set_id", "item_no"]).select("exam_id", "position", "label", "item_no", "text_html", C.render_choice(F.col("text_html"), F.col("render_override")).alias("rendered"))


def bank_list(candidates: DataFrame, item_type: str | None = None) -> DataFrame:
    return candidates.filter(F.col("item_type") == item_type) if item_type else candidates

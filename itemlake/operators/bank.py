"""State changes of the bank as snapshot in, snapshot out; ids are assigned in a stable order, so that a re-run gives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itemlake.functions import columns as C
from itemlake.operators import stats as S
from itemlake.operators import validate as V
from itemlake.operators.graph import near_set_links
from itemlake.operators.select import latest_version
from itemlake.plans.numbering import number_rows
from itemlake.plans.scratch import materialise


def _after(df: DataFrame, existing: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """df with ids that follow the largest in existing."""
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_top"))
    return number_rows(df, order, "_n").join(F.broadcast(top)).withColumn(name, F.col("_top") + F.col("_n")).drop("_top", "_n")  # one row


def set_signatures(items: DataFrame) -> DataFrame:
    """choice_set_id, signature of (choice_set_id, item_no, text_html)."""
    return items.groupBy("choice_set_id").agg(C.choice_signature(F.collect_list("text_html")).alias("signature"))


def upsert_choice_sets(sets: DataFrame, items: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sets (id, signature), items and a batch (batch_key, texts) to new sets, items and a report (batch_key, choice_set_id, created).

    A set whose signature is there is reused; a new one is made once however often the batch has it,
    with items numbered in the order of its first batch_key.
    """
    keyed = batch.withColumn("signature", C.choice_signature(F.col("texts")))
    first = keyed.join(sets, "signature", "left_anti").groupBy("signature").agg(F.min("batch_key").alias("batch_key"), F.min_by("texts", "batch_key").alias("texts"))
    new = _after(first, sets, ["batch_key", "signature"])
    sets2 = sets.select("id", "signature").unionByName(new.select("id", "signature"))
    added = new.select(F.col("id").alias("choice_set_id"), F.posexplode("texts").alias("i", "text_html")).select("choice_set_id", (F.col("i") + 1).cast("long").alias("item_no"), "text_html")
    items2 = items.select("choice_set_id", F.col("item_no").cast("long").alias("item_no"), "text_html").unionByName(added)
    made = new.select("signature", F.lit(True).alias("created"))
    report = keyed.join(sets2, "signature").join(made, "signature", "left").select("batch_key", F.col("id").alias("choice_set_id"), F.coalesce("created", F.lit(False)).alias("created"))
    return sets2, items2, report


def resolve_choice_order(printed: DataFrame, items: DataFrame) -> DataFrame:
    """batch_key, choice_order from printed (batch_key, choice_set_id, texts): the k-th of equal texts is the k-th of equal items; null if one isn't in the set."""
    p = printed.select("batch_key", "choice_set_id", F.posexplode("texts").alias("i", "text_html"))
    p = p.withColumn("k", F.row_number().over(Window.partitionBy("batch_key", "text_html").orderBy("i")))
    s = items.withColumn("k", F.row_number().over(Window.partitionBy("choice_set_id", "text_html").orderBy("item_no"))).select("choice_set_id", "text_html", "k", "item_no")
    j = p.join(s, ["choice_set_id", "text_html", "k"], "left").groupBy("batch_key").agg(F.array_sort(F.collect_list(F.struct("i", "item_no"))).alias("o"))
    order = F.array_join(F.transform("o", lambda x: x["item_no"].cast("string")), "", "?")
    return j.select("batch_key", F.when(C.is_choice_order(order), order).alias("choice_order"))


def resolve_printed(sets: DataFrame, items: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Printed choices (batch_key, texts), normalised, to sets, items and (batch_key, choice_set_id, choice_order, created)."""
    clean = batch.withColumn("texts", F.transform("texts", lambda t: C.normalize_choice(t)))
    sets2, items2, report = upsert_choice_sets(sets, items, clean)
    order = resolve_choice_order(clean.join(report, "batch_key"), items2)
    return sets2, items2, report.join(order, "batch_key")


def find_duplicates(versions: DataFrame, batch: DataFrame) -> DataFrame:
    """batch_key, question_id of a question with the batch row's set and stripped stem (the smallest id)."""
    known = versions.select("choice_set_id", C.strip_tags(F.col("stem_html")).alias("plain"), "question_id")
    asked = batch.select("batch_key", "choice_set_id", C.strip_tags(C.normalize_stem(F.col("stem_html"))).alias("plain"))
    return asked.join(known, ["choice_set_id", "plain"]).groupBy("batch_key").agg(F.min("question_id").alias("question_id"))


def checked_batch(batch: DataFrame) -> DataFrame:
    """batch with stem_html and correct normalised and blocked: whether a draft check blocks it. Stored once normalised, as every check reads the stem."""
    b = materialise(batch.withColumn("stem_html", C.normalize_stem(F.col("stem_html"))).withColumn("correct", C.normalize_correct(F.coalesce("correct", F.lit("")))), "batch")
    rows = b.select(F.lit(0).cast("long").alias("exam_id"), F.col("batch_key").alias("position"), "stem_html", "correct", "status")
    bad = V.validate_draft(rows).filter("blocking").select(F.col("position").alias("batch_key")).distinct().withColumn("blocked", F.lit(True))
    order = C.is_choice_order(F.col("choice_order"))
    return b.join(bad, "batch_key", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)) | ~order)


def register_questions(questions: DataFrame, versions: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New questions with version 1 from batch (batch_key, stem_html, choice_set_id, choice_order, correct, status[, derived_from]); report: batch_key, question_id, blocked."""
    if "derived_from" not in batch.columns:
        batch = batch.withColumn("derived_from", F.lit(None).cast("long"))
    checked = materialise(checked_batch(batch), "checked")
    new = _after(checked.filter("not blocked"), questions, ["batch_key"], "question_id")
    new = materialise(_after(new, versions, ["batch_key"], "id"), "new-questions")
    q = questions.select("id", "status", "derived_from").unionByName(new.select(F.col("question_id").alias("id"), "status", F.col("derived_from").cast("long").alias("derived_from")))
    v = versions.unionByName(new.select("id", "question_id", F.lit(1).alias("version_no"), "choice_set_id", "choice_order", "correct", "stem_html"), allowMissingColumns=True)
    report = checked.select("batch_key", "blocked").join(new.select("batch_key", "question_id"), "batch_key", "left")
    return q, v, report


def derive_questions(questions: DataFrame, versions: DataFrame, tags: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """register_questions for batch rows with derived_from (a version id); the source question's tags are inherited."""
    q, v, report = register_questions(questions, versions, batch)
    made = report.filter("question_id is not null").join(batch.select("batch_key", "derived_from"), "batch_key")
    source = versions.select(F.col("id").alias("derived_from"), F.col("question_id").alias("source"))
    inherited = made.join(source, "derived_from").select("question_id", "source").join(tags.withColumnRenamed("question_id", "source"), "source").select("question_id", "tag")
    return q, v, tags.select("question_id", "tag").unionByName(inherited).distinct(), report


def requires_new_version() -> Column:
    """On a join of old_* and new columns: does more than the wording change?"""
    changed = (F.col("old_set") != F.col("choice_set_id")) | (F.col("old_order") != F.col("choice_order"))
    return changed | (C.normalize_correct(F.col("old_correct")) != F.col("correct")) | ~C.item_type(F.col("old_stem")).eqNullSafe(C.item_type(F.col("stem_html")))


def revision_rows(versions: DataFrame, questions: DataFrame, batch: DataFrame, allow_inplace: bool = True) -> DataFrame:
    """The batch checked and beside each question's latest version (old_*), with fresh: whether it makes the next version."""
    keyed = batch.join(questions.select(F.col("id").alias("question_id"), "status"), "question_id").withColumn("batch_key", F.col("question_id"))
    old = latest_version(versions).select(
        "question_id", F.col("id").alias("old_id"), F.col("version_no").alias("old_no"), F.col("choice_set_id").alias("old_set"),
        F.col("choice_order").alias("old_order"), F.col("correct").alias("old_correct"), F.col("stem_html").alias("old_stem"),
    )
    return checked_batch(keyed).join(old, "question_id").withColumn("fresh", requires_new_version() | F.lit(not allow_inplace))


def next_versions(rows: DataFrame) -> DataFrame:
    """Columns of the versions that revision_rows with an id make."""
    return rows.select("id", "question_id", (F.col("old_no") + 1).alias("version_no"), "choice_set_id", "choice_order", "correct", "stem_html")


def revision_report(rows: DataFrame) -> DataFrame:
    made = F.col("fresh") & ~F.col("blocked")
    return rows.select("question_id", F.when(made, F.col("old_no") + 1).otherwise(F.col("old_no")).alias("version_no"), made.alias("created_new_version"), "blocked")


def revise_questions(versions: DataFrame, questions: DataFrame, batch: DataFrame, allow_inplace: bool = True) -> tuple[DataFrame, DataFrame]:
    """versions and a report (question_id, version_no, created_new_version, blocked) after a batch (question_id, stem_html, choice_set_id, choice_order, correct), a row a question.

    A change of set, order, key or item type makes the next version; another stem alone is corrected in place.
    """
    rows = materialise(revision_rows(versions, questions, batch, allow_inplace), "revisions")
    go = rows.filter("not blocked")
    new = next_versions(_after(go.filter("fresh"), versions, ["question_id"], "id"))
    fixed = go.filter("not fresh").select(F.col("old_id").alias("id"), F.col("stem_html").alias("new_stem"))
    kept = versions.join(fixed, "id", "left").withColumn("stem_html", F.coalesce("new_stem", "stem_html")).drop("new_stem")
    return kept.unionByName(new, allowMissingColumns=True), revision_report(rows)


def retire_questions(questions: DataFrame, ids: DataFrame) -> DataFrame:
    """Questions in ids (question_id) become retired."""
    out = ids.select(F.col("question_id").alias("id"), F.lit("retired").alias("new")).distinct()
    return questions.join(out, "id", "left").withColumn("status", F.coalesce("new", "status")).drop("new")


def merge_choice_sets(pairs: DataFrame, items: DataFrame, versions: DataFrame, links: DataFrame, min_shared: int = 3) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """items, versions, links and a report (source, target, moved, error) after merging pairs (source, target).

    Items correspond by stripped text and must do so one to one, else nothing of the pair changes.
    Printed orders are rewritten to the target's numbers, so keys and statistics keep their meaning;
    the source set and its links go, and links are made anew. A set is the source of one pair at most.
    """
    plain = items.select("choice_set_id", F.col("item_no").cast("long").alias("item_no"), C.strip_tags(F.col("text_html")).alias("plain"))
    s = pairs.join(plain.withColumnsRenamed({"choice_set_id": "source", "item_no": "from_no"}), "source")
    t = plain.groupBy(F.col("choice_set_id").alias("target"), "plain").agg(F.count(F.lit(1)).alias("n"), F.min("item_no").alias("to_no"))
    m = s.join(t, ["target", "plain"], "left")
    fit = m.groupBy("source", "target").agg(F.bool_and(F.coalesce(F.col("n") == 1, F.lit(False))).alias("each"), (F.countDistinct("to_no") == F.count(F.lit(1))).alias("apart"))
    fit = pairs.join(fit, ["source", "target"], "left")
    error = F.when(F.col("source") == F.col("target"), "same_set").when(~F.coalesce("each", F.lit(False)), "not_one_to_one").when(~F.col("apart"), "items_collide")
    fit = fit.select("source", "target", error.alias("error"))
    good = fit.filter("error is null").select("source", "target")
    digits = m.join(good, ["source", "target"]).groupBy("source", "target").agg(F.map_from_entries(F.collect_list(F.struct(F.col("from_no").cast("string"), F.col("to_no").cast("string")))).alias("map"))
    v = versions.join(digits.withColumnRenamed("source", "choice_set_id"), "choice_set_id", "left")
    order = F.array_join(F.transform(F.filter(F.split("choice_order", ""), lambda c: c != ""), lambda c: F.try_element_at("map", c)), "")
    moved = v.filter("target is not null").groupBy(F.col("choice_set_id").alias("source")).agg(F.count(F.lit(1)).alias("moved"))
    v2 = v.withColumn("choice_order", F.when(F.col("target").isNotNull(), order).otherwise(F.col("choice_order"))).withColumn("choice_set_id", F.coalesce("target", "choice_set_id")).drop("target", "map")
    gone = good.select(F.col("source").alias("choice_set_id"))
    items2 = items.join(gone, "choice_set_id", "left_anti")
    kept = links.join(gone.withColumnRenamed("choice_set_id", "set_a"), "set_a", "left_anti").join(gone.withColumnRenamed("choice_set_id", "set_b"), "set_b", "left_anti").select("set_a", "set_b", "shared", "relation")
    touched = good.select("target").distinct()
    fresh = near_set_links(items2, min_shared).filter("shared <= 4")
    met = [fresh.join(touched.withColumnRenamed("target", side), side, "left_semi").select(*fresh.columns) for side in ("set_a", "set_b")]
    fresh = met[0].unionByName(met[1]).distinct().join(kept.select("set_a", "set_b"), ["set_a", "set_b"], "left_anti").select(*fresh.columns)
    report = fit.join(moved, "source", "left").select("source", "target", F.coalesce("moved", F.lit(0)).alias("moved"), "error")
    return items2, v2.select(*versions.columns), kept.unionByName(fresh), report


# --- tags -------------------------------------------------------------------------------------


def set_tags(tags: DataFrame, batch: DataFrame) -> DataFrame:
    """Tags (question_id, tag) with those of the batch's questions (question_id, tags) replaced; blank names are dropped."""
    new = batch.select("question_id", F.explode("tags").alias("tag")).withColumn("tag", C.trim_all(F.col("tag"))).filter("tag <> ''")
    return tags.select("question_id", "tag").join(batch.select("question_id"), "question_id", "left_anti").unionByName(new.distinct())


def rename_tags(tags: DataFrame, renames: DataFrame) -> DataFrame:
    """Tags after renames (tag, new_tag); a name that is there already takes the questions over, without doubles."""
    return tags.join(renames, "tag", "left").select("question_id", F.coalesce("new_tag", "tag").alias("tag")).distinct()


def delete_tags(tags: DataFrame, names: DataFrame) -> DataFrame:
    return tags.join(names.select("tag"), "tag", "left_anti").select("question_id", "tag")


def ensure_tags(all_tags: DataFrame, names: DataFrame) -> DataFrame:
    """all_tags (id, tag) with ids for names that are new."""
    new = names.select(C.trim_all(F.col("tag")).alias("tag")).filter("tag <> ''").distinct().join(all_tags, "tag", "left_anti")
    return all_tags.select("id", "tag").unionByName(_after(new, all_tags, ["tag"]).select("id", "tag"))


# --- exams ------------------------------------------------------------------------------------


def create_exams(exams: DataFrame, batch: DataFrame) -> DataFrame:
    """New draft exams (name, exam_date) with ids in the order of date and name."""
    new = _after(batch.select("name", "exam_date"), exams, ["exam_date", "name"])
    return exams.unionByName(new.withColumn("status", F.lit("draft")), allowMissingColumns=True)


def set_exam_items(exam_items: DataFrame, exams: DataFrame, versions: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of draft exams replaced by batch (exam_id, position, qversion_id), the key copied; issues for exams that are locked or versions that don't exist."""
    state = exams.select(F.col("id").alias("exam_id"), "status")
    b = batch.join(state, "exam_id", "left").join(versions.select(F.col("id").alias("qversion_id"), C.normalize_correct(F.col("correct")).alias("correct_asked")), "qversion_id", "left")
    free = b.filter("status = 'draft' and correct_asked is not null").select("exam_id", "position", "qversion_id", "correct_asked")
    issue = F.when(F.coalesce(F.col("status"), F.lit("")) != "draft", "exam_locked").when(F.col("correct_asked").isNull(), "version_unknown")
    issues = b.withColumn("code", issue).filter("code is not null").select("exam_id", F.col("position").cast("long").alias("position"), "code", F.lit(True).alias("blocking"), F.lit("not assigned").alias("message"))
    changed = batch.select("exam_id").distinct().join(state.filter("status = 'draft'"), "exam_id", "left_semi")
    return exam_items.select("exam_id", "position", "qversion_id", "correct_asked").join(changed, "exam_id", "left_anti").unionByName(free), issues


def finalize_exams(exams: DataFrame, issues: DataFrame, strict: bool = False) -> DataFrame:
    """Draft exams without blocking issues (if strict, without any) become finalized."""
    g = V.gate(issues).select(F.col("exam_id").alias("id"), (F.col("blocked") | (F.lit(strict) & (F.col("n_warnings") > 0))).alias("stop"))
    ok = (F.col("status") == "draft") & ~F.coalesce("stop", F.lit(False))
    return exams.join(g, "id", "left").withColumn("status", F.when(ok, "finalized").otherwise(F.col("status"))).drop("stop")


def apply_stats(exams: DataFrame, exam_items: DataFrame, versions: DataFrame, counts: DataFrame, disc: DataFrame, issues: DataFrame, thresholds: S.FlagThresholds = S.FlagThresholds()) -> tuple[DataFrame, DataFrame]:
    """(exams', item_stats with flags) for exams whose issues don't block: counts (exam_id, position, pattern, cnt) of known positions become statistics and the exam imported, with its number of examinees."""
    blocked = V.gate(issues).filter("blocked").select("exam_id")
    state = exams.filter("status in ('finalized', 'imported')").select(F.col("id").alias("exam_id")).join(blocked, "exam_id", "left_anti")
    c = counts.join(state, "exam_id", "left_semi").join(exam_items.select("exam_id", "position", "qversion_id"), ["exam_id", "position"]).select("exam_id", "qversion_id", "pattern", F.col("cnt").cast("long").alias("cnt"))
    items = S.keyed_items(exam_items, versions)
    dated = S.dated(S.item_stats(c, items), items, disc, exams)
    stats = dated.join(S.item_flags(dated, thresholds), S.ITEM)
    n = stats.groupBy(F.col("exam_id").alias("id")).agg(F.max("n").alias("n_examinees"))
    done = exams.drop("n_examinees").join(n, "id", "left").withColumn("status", F.when(F.col("n_examinees").isNotNull(), "imported").otherwise(F.col("status")))
    return done, stats


def import_exams(bank: dict[str, DataFrame], parsed: DataFrame, rows: DataFrame, counts: DataFrame, disc: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Past exams in one go: parsed (exam_id, position, stem_html, texts), rows (exam_id, position, correct, total, ...), counts (exam_id, position, pattern, cnt).

    bank has sets, set_items, questions, versions, exam_items and exams (drafts to fill). Sets are
    resolved, questions registered (as drafts with key a where no row gives one), items assigned,
    exams finalized where nothing blocks, and statistics applied where validation passes. Returns the new
    bank, with stats, and all issues, duplicates of known questions as warnings.
    """
    rowed = parsed.join(rows.select("exam_id", "position", "correct"), ["exam_id", "position"], "left")
    keyed = number_rows(rowed, ["exam_id", "position"], "batch_key")
    sets, set_items, printed = resolve_printed(bank["sets"], bank["set_items"], keyed.select("batch_key", "texts"))
    printed = materialise(printed, "printed")
    known = F.coalesce("correct", F.lit("")) != ""
    batch = keyed.join(printed, "batch_key").withColumn("status", F.when(known, "active").otherwise("draft")).withColumn("correct", F.when(known, F.col("correct")).otherwise("a"))
    batch = materialise(batch, "batch")
    twice = find_duplicates(bank["versions"], batch).join(keyed.select("batch_key", "exam_id", "position"), "batch_key")
    warnings = twice.select("exam_id", F.col("position").cast("long").alias("position"), F.lit("duplicate_of_bank").alias("code"), F.lit(False).alias("blocking"), F.concat(F.lit("same as question "), F.col("question_id").cast("string")).alias("message"))
    questions, versions, report = register_questions(bank["questions"], bank["versions"], batch)
    refused = report.filter("blocked").join(keyed.select("batch_key", "exam_id", "position"), "batch_key")
    issues = [warnings, refused.select("exam_id", F.col("position").cast("long").alias("position"), F.lit("question_refused").alias("code"), F.lit(True).alias("blocking"), F.lit("the question can't be saved").alias("message"))]
    made = report.filter("question_id is not null").join(keyed.select("batch_key", "exam_id", "position"), "batch_key").join(versions.select("question_id", F.col("id").alias("qversion_id")), "question_id")
    exam_items, locked = set_exam_items(bank["exam_items"], bank["exams"], versions, made.select("exam_id", "position", "qversion_id"))
    exam_items = materialise(exam_items, "exam-items")
    issues += [locked, V.validate_stats(rows, exam_items)]
    found = materialise(V.union(issues), "issues")
    exams = finalize_exams(bank["exams"], found)
    exams, stats = apply_stats(exams, exam_items, versions, counts, disc, found)
    return {"sets": sets, "set_items": set_items, "questions": questions, "versions": versions, "exam_items": exam_items, "exams": exams, "stats": stats}, found

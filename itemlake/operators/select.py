"""Candidates for new exams: filters, order, quotas and the greedy selection for many requests at once."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itemlake.functions import columns as C
from itemlake.plans.scratch import materialise
from itemlake.operators.stats import emphasis_violation


@dataclass(frozen=True)
class Conditions:
    """What rules out a candidate; None switches a rule off."""

    exclude_negative_disc: bool = True
    min_disc: float | None = None
    p_range: tuple[float, float] | None = None
    exclude_recent_years: int | None = None
    current_year: int | None = None


def latest_version(versions: DataFrame) -> DataFrame:
    """The version with the largest version_no (then id) of each question."""
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("version_no"), F.desc("id")))
    return versions.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def tags_of(questions: DataFrame, tags: DataFrame) -> DataFrame:
    """question_id, tags: sorted, empty for a question without any."""
    per = tags.groupBy("question_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return questions.select(F.col("id").alias("question_id")).join(per, "question_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def history_summary(exam_items: DataFrame, versions: DataFrame, exams: DataFrame) -> DataFrame:
    """question_id, times_used, last_exam_year over exams of any status."""
    v = versions.select(F.col("id").alias("qversion_id"), "question_id")
    e = exams.select(F.col("id").alias("exam_id"), C.exam_year(F.col("exam_date")).alias("year"))
    return exam_items.join(v, "qversion_id").join(e, "exam_id").groupBy("question_id").agg(F.count(F.lit(1)).alias("times_used"), F.max("year").alias("last_exam_year"))


def latest_with_stats(dated: DataFrame) -> DataFrame:
    """question_id, p, disc, flags of the latest exam that has a rate; null dates are oldest, then the largest exam id."""
    last = F.struct(F.coalesce("exam_date", F.lit("")), "exam_id")
    known = dated.filter("p is not null")
    return known.groupBy("question_id").agg(F.max_by("p", last).alias("p"), F.max_by("disc", last).alias("disc"), F.max_by("flags", last).alias("flags"))


def candidates(questions: DataFrame, versions: DataFrame, tags: DataFrame, exam_items: DataFrame, exams: DataFrame, dated: DataFrame, exclude_exam_ids: Iterable[int] = ()) -> DataFrame:
    """One row a question: its latest version with tags, history, latest statistics and flags.

    dated has exam_id, question_id, exam_date, p, disc and flags. Flags get no_stats where no exam has
    a rate, and emphasis_rule where the stem breaks it.
    """
    out = list(exclude_exam_ids)
    if out:
        exam_items, dated = exam_items.filter(~F.col("exam_id").isin(out)), dated.filter(~F.col("exam_id").isin(out))
    q = questions.select(F.col("id").alias("question_id"), "status")
    v = latest_version(versions).select("question_id", F.col("id").alias("qversion_id"), "stem_html", "correct", "choice_set_id")
    stem = F.col("stem_html")
    rows = q.join(v, "question_id").join(tags_of(questions, tags), "question_id").join(history_summary(exam_items, versions, exams), "question_id", "left")
    rows = rows.join(latest_with_stats(dated), "question_id", "left")
    extra = F.array_compact(F.array(F.when(F.col("p").isNull(), "no_stats"), F.when(emphasis_violation(stem), "emphasis_rule")))
    return rows.select(
        "question_id", "qversion_id", "stem_html", "correct", "choice_set_id", "status", C.item_type(stem).alias("item_type"), C.is_negative(stem).alias("negative"),
        "tags", "last_exam_year", F.coalesce("times_used", F.lit(0)).alias("times_used"), "p", "disc",
        F.array_sort(F.array_union(F.coalesce("flags", F.array().cast("array<string>")), extra)).alias("flags"),
    )


UNUSED = -1


def bank_filter(c: DataFrame, keyword: str = "", tag: str | None = None, item_type: str | None = None, negative: bool | None = None, p_min: float | None = None, p_max: float | None = None, min_disc: float | None = None, flag: str | None = None, last_exam_year: int | None = None, choice_set_id: int | None = None, include_draft: bool = True, include_retired: bool = False) -> DataFrame:
    """Candidates that meet every condition given; UNUSED as the year asks for those never asked. A rate or index condition drops rows without one."""
    rules: list[Column] = []
    if not include_draft:
        rules.append(F.col("status") != "draft")
    if not include_retired:
        rules.append(F.col("status") != "retired")
    if keyword:
        rules.append(F.contains(C.strip_tags(F.col("stem_html")), F.lit(keyword)))
    if tag:
        rules.append(F.array_contains("tags", tag))
    if item_type:
        rules.append(F.col("item_type") == item_type)
    if negative is not None:
        rules.append(F.col("negative") == negative)
    if flag:
        rules.append(F.array_contains("flags", flag))
    if choice_set_id is not None:
        rules.append(F.col("choice_set_id") == choice_set_id)
    if last_exam_year is not None:
        rules.append(F.col("last_exam_year").isNull() if last_exam_year == UNUSED else F.col("last_exam_year") == last_exam_year)
    rules += [F.col("p") >= p_min] if p_min is not None else []
    rules += [F.col("p") <= p_max] if p_max is not None else []
    rules += [F.col("disc") >= min_disc] if min_disc is not None else []
    for rule in rules:
        c = c.filter(rule)
    return c


def eligible(c: DataFrame, conds: Conditions = Conditions()) -> DataFrame:
    """Candidates with excluded_reason: the first rule that rules one out, or null. Missing statistics rule nobody out."""
    no = F.lit(False)
    low, high = conds.p_range or (None, None)
    recent = no
    if conds.exclude_recent_years is not None and conds.current_year is not None:
        recent = F.col("last_exam_year") > conds.current_year - conds.exclude_recent_years
    reason = (
        F.when(F.col("status") != "active", F.concat(F.lit("status="), F.col("status")))
        .when(F.col("item_type").isNull(), "no_type")
        .when(F.array_contains("flags", "negative_disc") if conds.exclude_negative_disc else no, "negative_disc")
        .when(F.col("disc") < conds.min_disc if conds.min_disc is not None else no, "low_disc")
        .when(~F.col("p").between(low, high) if conds.p_range else no, "p_out_of_range")
        .when(recent, "recent")
    )
    return c.withColumn("excluded_reason", reason)


def preference_order() -> list[Column]:
    """Least used, longest unused, then id."""
    return [F.col("times_used"), F.coalesce("last_exam_year", F.lit(-1)), F.col("question_id")]


def assign_positions(selected: DataFrame) -> DataFrame:
    """position 1..n per request, by type order and then preference."""
    w = Window.partitionBy("request_id").orderBy(C.type_rank(F.col("item_type")), *preference_order())
    return selected.withColumn("position", F.row_number().over(w))


def replacement_pool(c: DataFrame, selected: DataFrame) -> DataFrame:
    """request_id and the eligible candidates it didn't choose: a row for each request and candidate is what is asked for.

    The requests, one row for all, are put beside every candidate; candidates stay where they are.
    """
    requests = selected.agg(F.array_sort(F.collect_set("request_id")).alias("requests"))
    each = c.crossJoin(F.broadcast(requests)).withColumn("request_id", F.explode("requests")).drop("requests")
    return each.join(selected.select("request_id", "question_id"), ["request_id", "question_id"], "left_anti")


def selected_by_type(selected: DataFrame) -> DataFrame:
    w = F.array_sort(F.collect_list(F.struct("seq", "question_id")))
    return selected.groupBy("request_id", F.coalesce("item_type", F.lit("?")).alias("item_type")).agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.transform(w, lambda x: x["question_id"].cast("string")), ",").alias("question_ids"))


def select_by_quota(requests: DataFrame, quotas: DataFrame, pool: DataFrame) -> DataFrame:
    """request_id, seq, question_id, qversion_id, item_type, for requests with type quotas, a share of new items and a total only.

    requests (request_id, total, new_target: null for no share), quotas (request_id, item_type, quota).
    Exactly the greedy order, by windows: first new items up to quota, share and total, then the
    rest up to what quota and total leave (all items again where no share is set). Candidates are joined
    once and stored; whether requests and quotas are broadcast is left to their size.
    """
    order = preference_order()
    rows = pool.withColumn("is_new", F.col("p").isNull()).join(quotas, "item_type").join(requests, "request_id")
    rows = materialise(rows.select("request_id", "total", "new_target", "quota", "question_id", "qversion_id", "item_type", "is_new", "times_used", "last_exam_year"), "asked")  # ranked four times
    w = lambda *k: Window.partitionBy("request_id", *k).orderBy(*order)
    share = F.col("new_target")
    first = rows.filter("is_new and new_target > 0").withColumn("r", F.row_number().over(w("item_type"))).filter("r <= quota")
    first = first.withColumn("seq", F.row_number().over(w())).filter(F.col("seq") <= F.least("total", share))
    took = first.groupBy("request_id", "item_type").agg(F.count(F.lit(1)).alias("took"))
    sums = first.groupBy("request_id").agg(F.count(F.lit(1)).alias("took_all"))
    rest = rows.filter(F.col("new_target").isNull() | ~F.col("is_new")).join(took, ["request_id", "item_type"], "left").join(sums, "request_id", "left")
    rest = rest.withColumn("r", F.row_number().over(w("item_type"))).filter("r <= quota - coalesce(took, 0)")
    rest = rest.withColumn("s", F.row_number().over(w())).filter("s <= total - coalesce(took_all, 0)").withColumn("seq", F.expr("cast(s + coalesce(took_all, 0) as int)"))
    keep = ["request_id", "seq", "question_id", "qversion_id", "item_type"]
    return first.select(*keep).unionByName(rest.select(*keep))


@dataclass(frozen=True)
class Request:
    """One exam to fill; quotas as dicts, None for no limit."""

    request_id: int
    total: int
    types: dict | None = None
    tags: dict | None = None
    new_ratio: float | None = None
    max_per_set_group: int = 2
    max_negative: int | None = None
    max_negative_ratio: float | None = None

    @property
    def new_target(self) -> int | None:
        return None if self.new_ratio is None else round(self.total * self.new_ratio)


def _pick(request: Request, pool: pd.DataFrame) -> list[int]:
    """Row numbers in the order taken: a pass for the share of new items, then one for the rest."""
    types, tags = dict(request.types or {}), dict(request.tags or {})
    groups: dict[str, int] = {}
    families: set[int] = set()
    negatives = fresh = 0
    most_negative = [x for x in (request.max_negative, None if request.max_negative_ratio is None else int(request.total * request.max_negative_ratio)) if x is not None]
    taken: list[int] = []
    rows = list(pool.itertuples(index=False))
    for only_new in (True, False) if request.new_target else (False,):
        for i, r in enumerate(rows):
            if len(taken) >= request.total:
                return taken
            open_tags = [t for t in r.tags if tags.get(t, 0) > 0]
            if (
                (only_new and not r.is_new)
                or r.family_id in families
                or (r.is_new and request.new_target is not None and fresh >= request.new_target)
                or (r.negative and any(negatives >= m for m in most_negative))
                or (request.max_per_set_group and groups.get(r.group_key, 0) >= request.max_per_set_group)
                or (request.types and types.get(r.item_type, 0) <= 0)
                or (request.tags and not open_tags)
            ):
                continue
            taken.append(i)
            families.add(r.family_id)
            groups[r.group_key] = groups.get(r.group_key, 0) + 1
            negatives += bool(r.negative)
            fresh += bool(r.is_new)
            if request.types:
                types[r.item_type] -= 1
            if open_tags:
                tags[min(open_tags)] -= 1
    return taken


def select_candidates(requests: list[Request], pool: DataFrame, families: DataFrame, neighbourhoods: DataFrame, prune: bool = True) -> DataFrame:
    """request_id, seq, question_id, qversion_id, item_type of the greedy selection under all limits.

    Every limit depends only on a candidate's profile (type, tags, new, negative), its set group and its
    family, and none opens again. A request takes total items, so it closes at most total families,
    and total / max_per_set_group groups (G). Hence, in order of preference, without loss: of a family only
    the first of each profile and group can be taken, and of those in one profile only the first
    G + 1; of a profile and group only the first cap + total; of a profile only the first total +
    total (G + 1) + G (cap + total). So a group's size depends on the request and the number of
    profiles, not on the bank; requests run in parallel. prune=False keeps all rows, for comparison.
    """
    spark = pool.sparkSession
    rows = pool.join(families, "question_id").join(neighbourhoods, "choice_set_id").withColumn("is_new", F.col("p").isNull())
    limits = []
    for r in requests:
        groups = r.total // r.max_per_set_group if r.max_per_set_group else 0
        for k in C.ITEM_TYPES:
            cap = min(x for x in (r.total, (r.types or {k: r.total}).get(k, 0), r.max_per_set_group or r.total) if x is not None)
            if (r.types or {k: 1}).get(k, 0) > 0:
                limits.append((r.request_id, k, cap + r.total, groups + 1, r.total + r.total * (groups + 1) + groups * (cap + r.total)))
    limited = spark.createDataFrame(limits, "request_id long, item_type string, in_group int, in_family int, in_profile int")
    rows = rows.join(F.broadcast(limited), "item_type")  # a row a request and type
    profile = ["request_id", "item_type", "tags", "is_new", "negative"]
    if prune and limits:
        steps = [(["group_key", "family_id"], F.lit(1), 1), (["group_key"], F.col("in_group"), 2), (["family_id"], F.col("in_family"), 3), ([], F.col("in_profile"), 4)]
        for more, most, column in steps:
            number = F.row_number().over(Window.partitionBy(*profile, *more).orderBy(*preference_order()))
            largest = 1 if column == 1 else max(x[column] for x in limits)  # a constant, so that tasks cut before the exchange
            rows = rows.withColumn("_rank", number).filter(F.col("_rank") <= largest).filter(F.col("_rank") <= most)
    by_id = {r.request_id: r for r in requests}
    order = ["times_used", "_year", "question_id"]

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        got = pdf.iloc[_pick(by_id[int(pdf.request_id.iloc[0])], pdf)].copy()
        got["seq"] = range(1, len(got) + 1)
        return got[["request_id", "seq", "question_id", "qversion_id", "item_type"]]

    rows = rows.withColumn("_year", F.coalesce("last_exam_year", F.lit(-1))).select("request_id", "question_id", "qversion_id", "item_type", "tags", "is_new", "negative", "group_key", "family_id", *order[:2])
    return rows.groupBy("request_id").applyInPandas(fill, "request_id long, seq int, question_id long, qversion_id long, item_type string")


def unmet(requests: list[Request], selected: DataFrame, pool: DataFrame) -> DataFrame:
    """request_id, kind, key, shortfall: what a selection lacks of its total, types, tags and new items.

    A tag's quota is used up by the first open tag of each item in sequence, as the selection counts it;
    where items carry one quota tag each this is the count of items with the tag.
    """
    spark = selected.sparkSession
    want = [(r.request_id, "total", "", r.total) for r in requests]
    want += [(r.request_id, "type", k, n) for r in requests for k, n in (r.types or {}).items()]
    want += [(r.request_id, "tag", k, n) for r in requests for k, n in (r.tags or {}).items()]
    want += [(r.request_id, "new", "", r.new_target) for r in requests if r.new_target is not None]
    asked = spark.createDataFrame(want, "request_id long, kind string, key string, want int")
    full = selected.join(pool.select("question_id", "tags", F.col("p").isNull().alias("is_new")), "question_id")
    quotas = {r.request_id: dict(r.tags or {}) for r in requests}

    def tags_used(pdf: pd.DataFrame) -> pd.DataFrame:
        left, out = dict(quotas[int(pdf.request_id.iloc[0])]), {}
        for t in pdf.sort_values("seq").tags:
            for tag in sorted(t):
                if left.get(tag, 0) > 0:
                    left[tag] -= 1
                    out[tag] = out.get(tag, 0) + 1
                    break
        rows = [(int(pdf.request_id.iloc[0]), "tag", tag, n) for tag, n in out.items()]
        return pd.DataFrame(rows, columns=["request_id", "kind", "key", "got"]).astype({"kind": object, "key": object})

    got = full.groupBy("request_id", F.lit("total").alias("kind"), F.lit("").alias("key")).agg(F.count(F.lit(1)).alias("got"))
    got = got.unionByName(full.groupBy("request_id", F.lit("type").alias("kind"), F.col("item_type").alias("key")).agg(F.count(F.lit(1)).alias("got")))
    got = got.unionByName(full.filter("is_new").groupBy("request_id", F.lit("new").alias("kind"), F.lit("").alias("key")).agg(F.count(F.lit(1)).alias("got")))
    got = got.unionByName(full.select("request_id", "seq", "tags").groupBy("request_id").applyInPandas(tags_used, "request_id long, kind string, key string, got long"))
    return asked.join(got, ["request_id", "kind", "key"], "left").select("request_id", "kind", "key", (F.col("want") - F.coalesce("got", F.lit(0))).alias("shortfall")).filter("shortfall > 0")

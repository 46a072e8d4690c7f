"""Answer-pattern frequency tables and answer keys from CSV files, many exams in one job."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itemlake.functions import columns as C
from itemlake.plans.scratch import materialise
from itemlake.sources.records import read_records

# Header names and cell markers of the two dialects.
ALIASES = {
    "position": ("問題", "問", "設問", "問題番号"),
    "correct": ("正答肢", "正答"),
    "p": ("正答率", "正答率(%)", "正答率（%）", "正答率％"),
    "n_correct": ("正答数",),
    "disc": ("識別係数", "識別指数", "D"),
    "points": ("配点",),
    "adjustment": ("措置",),
    "blank": ("空白", "無解答", "未解答"),
    "other": ("その他",),
    "ignored": ("点双列相関", "点双列相関係数", "備考"),
}
META = {"exam_name": "試験名", "exam_date": "試験日", "n_examinees": "受験者数", "disc_type": "識別係数定義"}
NON_MCQ = ("記述式", "論述式", "記述", "自由記述")
KEY_HEADER = "問題"
EMPTY_CELLS = ("-", "‐", "―", "—", "ー", "")


def scan_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, line_no, cells, unclosed of every record that isn't empty (see records.read_records); cells are trimmed."""
    rows = read_records(spark, paths).withColumn("cells", F.transform("cells", C.trim_all))
    return rows.filter(F.exists("cells", lambda c: c != ""))


def exam_meta(lines: DataFrame) -> DataFrame:
    """file, exam_name, exam_date, n_examinees, disc_type from the lines that begin with #; null where a file has none."""
    meta = lines.filter(F.startswith(F.col("cells")[0], F.lit("#"))).select("file", "line_no", C.trim_all(F.regexp_replace(F.col("cells")[0], "^#+", "")).alias("key"), F.try_element_at("cells", F.lit(2)).alias("value"))
    pick = [F.max_by(F.when(F.col("key") == name, F.coalesce("value", F.lit(""))), F.when(F.col("key") == name, F.col("line_no"))).alias(k) for k, name in META.items()]
    found = lines.select("file").distinct().join(meta.groupBy("file").agg(*pick, F.count(F.lit(1)).alias("n_meta")), "file", "left")
    return found.withColumn("n_examinees", F.col("n_examinees").try_cast("double").cast("long")).withColumn("n_meta", F.coalesce("n_meta", F.lit(0)))


def _table(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(header cells per file, rows after the header)."""
    body = lines.filter(~F.startswith(F.col("cells")[0], F.lit("#")))
    header = body.groupBy("file").agg(F.min_by("cells", "line_no").alias("header"), F.min("line_no").alias("header_line"))
    return header, body.join(header.select("file", "header_line"), "file").filter("line_no > header_line").drop("header_line")


def resolve_columns(header: DataFrame) -> DataFrame:
    """file, i, name, role, key from (file, header): the first header name that is an alias has the role; all names unknown are count columns.

    key is the answer pattern of a count column, '' for blank and '?' for other.
    """
    spark = header.sparkSession
    aliases = spark.createDataFrame([(n, r, k) for r, names in ALIASES.items() for k, n in enumerate(names)], "name string, role string, pref int")
    names = header.select("file", F.posexplode("header").alias("i", "name")).join(F.broadcast(aliases), "name", "left")
    first = F.row_number().over(Window.partitionBy("file", "role").orderBy("pref", "i"))
    single = F.col("role").isin("position", "correct", "p", "n_correct", "disc", "points", "adjustment")
    role = F.when(F.col("role").isin("blank", "other") | F.col("role").isNull() | (single & (first > 1)), "count").otherwise(F.col("role"))
    key = F.when(F.col("role") == "blank", C.BLANK).when(F.col("role") == "other", C.OTHER).otherwise(F.col("name"))
    named = names.withColumn("key", key).withColumn("new", role)
    return named.select("file", "i", "name", F.col("new").alias("role"), F.when(F.col("new") == "count", F.col("key")).alias("key"))


def detect_dialect(columns: DataFrame, meta: DataFrame) -> DataFrame:
    """file, percent, dialect: rates from 0 to 100 where the header says so; ssdb if so or without meta lines, else legacy."""
    per = columns.groupBy("file").agg(F.max((F.col("role") == "p") & F.col("name").rlike("[%％]")).alias("percent"))
    return per.join(meta.select("file", "n_meta"), "file").select("file", "percent", F.when(F.col("percent") | (F.col("n_meta") == 0), "ssdb").otherwise("legacy").alias("dialect"))


def unpivot_counts(wide: DataFrame, keys: Iterable[str] = ("exam_id", "position"), patterns: Iterable[str] | None = None) -> DataFrame:
    """keys, pattern, cnt, unreadable from one column a pattern; 'blank' and 'other' are the columns of '' and '?'. Cells that aren't numbers are unreadable."""
    keys = list(keys)
    names = list(patterns) if patterns is not None else [c for c in wide.columns if c not in keys]
    long = wide.select(*keys, *[F.col(c).cast("string").alias(c) for c in names]).unpivot(keys, names, "name", "cell")
    pattern = F.when(F.col("name") == "blank", C.BLANK).when(F.col("name") == "other", C.OTHER).otherwise(F.col("name"))
    number = F.col("cell").try_cast("double")
    return long.select(*keys, pattern.alias("pattern"), number.alias("cnt"), number.isNull().alias("unreadable"))


class Scan:
    """The tables of a scan, keyed by file. Each is made when asked for, once, and stored, as every validation rule reads them."""

    def __init__(self, spark: SparkSession, paths: str | list[str]):
        self.lines = materialise(scan_lines(spark, paths), "lines")

    @property
    def issues(self) -> DataFrame:
        """file, line_no, code: records whose quote nothing closes; they hold the rest of their file."""
        return self.lines.filter("unclosed").select("file", "line_no", F.lit("unclosed_quote").alias("code"))

    @cached_property
    def meta(self) -> DataFrame:
        return materialise(exam_meta(self.lines), "meta")

    @cached_property
    def _tables(self) -> tuple[DataFrame, DataFrame]:
        return _table(self.lines)

    @cached_property
    def columns(self) -> DataFrame:
        return materialise(resolve_columns(self._tables[0]), "columns")

    @cached_property
    def dialects(self) -> DataFrame:
        return detect_dialect(self.columns, self.meta)

    @cached_property
    def _cells(self) -> DataFrame:
        """A row per cell of a named column; what a short row lacks is empty."""
        body = self._tables[1]
        cells = body.select("file", "line_no", F.posexplode("cells").alias("i", "cell"))
        long = body.select("file", "line_no").join(self.columns, "file").join(cells, ["file", "line_no", "i"], "left")
        return materialise(long.withColumn("cell", F.coalesce("cell", F.lit(""))), "cells")

    @cached_property
    def all_rows(self) -> DataFrame:
        empty = F.col("cell").isin(*EMPTY_CELLS)
        of = lambda role: F.max(F.when(F.col("role") == role, F.col("cell"))).alias(role)
        rows = self._cells.groupBy("file", "line_no").agg(*[of(r) for r in ("position", "correct", "p", "n_correct", "disc", "points", "adjustment")], F.bool_and(F.when(F.col("role") == "count", empty)).alias("all_empty"))
        rows = rows.join(self.dialects, "file")
        raw = F.coalesce("correct", F.lit(""))
        words = F.exists(F.array(*map(F.lit, NON_MCQ)), lambda w: F.contains(raw, w))
        free = F.coalesce("all_empty", F.lit(False)) | words | ~F.lower(raw).rlike("^[a-e]*$")
        number = lambda c: F.col(c).try_cast("double")
        rows = rows.select(
            "file", "line_no", F.coalesce(number("position").cast("long"), F.lit(0)).alias("position"), raw.alias("correct_raw"), C.normalize_correct(raw).alias("correct"),
            F.when(F.col("percent"), number("p") / 100).otherwise(number("p")).alias("p_reported"), number("n_correct").cast("long").alias("n_correct_reported"),
            number("disc").alias("disc"), number("points").alias("points"), "adjustment", F.when(free, "non_mcq").otherwise("mcq").alias("kind"),
        )
        return materialise(rows, "rows")

    @property
    def non_mcq(self) -> DataFrame:
        return self.all_rows.filter("kind = 'non_mcq'")

    @cached_property
    def counts(self) -> DataFrame:
        mcq = self.all_rows.filter("kind = 'mcq'").select("file", "line_no", "position")
        empty, value = F.col("cell").isin(*EMPTY_CELLS), F.col("cell").try_cast("double")
        counts = self._cells.filter("role = 'count'").join(mcq, ["file", "line_no"])
        return materialise(counts.select("file", "line_no", "position", F.col("key").alias("pattern"), F.when(~empty, value).alias("cnt"), (empty | value.isNull()).alias("unreadable")), "counts")

    @cached_property
    def rows(self) -> DataFrame:
        correct = self.all_rows.filter("kind = 'mcq'").select("file", "line_no", "correct")
        sums = self.counts.join(correct, ["file", "line_no"]).groupBy("file", "line_no").agg(
            F.coalesce(F.sum("cnt"), F.lit(0.0)).alias("total"), F.coalesce(F.sum(F.when(F.col("pattern") == F.col("correct"), F.col("cnt"))), F.lit(0.0)).alias("counted")
        )
        return materialise(self.all_rows.filter("kind = 'mcq'").join(sums, ["file", "line_no"]), "mcq-rows")

    @cached_property
    def examinees(self) -> DataFrame:
        return derive_n(self.rows, self.meta)


def scan_item_stats(spark: SparkSession, paths: str | list[str]) -> Scan:
    return Scan(spark, paths)


def derive_n(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """file, derived_n, effective_n: the total if all non-zero totals are one; what the file declares comes first."""
    per = rows.filter("total <> 0").groupBy("file").agg(F.countDistinct(F.col("total").cast("long")).alias("k"), F.max(F.col("total").cast("long")).alias("t"))
    return meta.select("file", "n_examinees").join(per, "file", "left").select("file", F.when(F.col("k") == 1, F.col("t")).alias("derived_n"), F.coalesce("n_examinees", F.when(F.col("k") == 1, F.col("t"))).alias("effective_n"))


def _key_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    lines = scan_lines(spark, paths).filter(F.col("cells")[0] != KEY_HEADER)
    return lines.withColumn("position", F.col("cells")[0].try_cast("long"))


def read_answer_key(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, position, correct of key files; what key_issues names as one cell or without a position is left out."""
    rows = _key_lines(spark, paths).filter("size(cells) >= 2 and position is not null")
    return rows.select("file", "position", C.normalize_correct(F.col("cells")[1]).alias("correct"))


def key_issues(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, line_no, code of records of key files: one_cell and no_position have no key, unclosed_quote has the rest of its file in a cell."""
    rows = _key_lines(spark, paths)
    code = F.when(F.size("cells") < 2, "one_cell").when(F.col("position").isNull(), "no_position")
    codes = F.filter(F.array(code, F.when(F.col("unclosed"), "unclosed_quote")), lambda c: c.isNotNull())
    return rows.select("file", "line_no", F.explode(codes).alias("code"))


def whole_counts(counts: DataFrame) -> DataFrame:
    """Counts as they are stored once valid: truncated, zeros dropped."""
    cnt: Column = F.col("cnt").cast("long")
    return counts.withColumn("cnt", cnt).filter("cnt <> 0")

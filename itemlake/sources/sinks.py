"""Writers of keys, counts, statistics and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlake.functions import columns as C


def answer_key(exam_items: DataFrame) -> DataFrame:
    """exam_id, position, correct as they are exported."""
    return exam_items.select("exam_id", "position", C.normalize_correct(F.col("correct_asked")).alias("correct"))


def write_answer_key(exam_items: DataFrame, path: str) -> None:
    """CSV per exam: header, rows by position, CRLF; rows of an exam stay in one task, which writes them in order."""
    rows = answer_key(exam_items).select("exam_id", F.col("position").alias("問題"), F.col("correct").alias("正答肢"))
    rows.repartition("exam_id").sortWithinPartitions("exam_id", "問題").write.partitionBy("exam_id").option("header", True).option("lineSep", "\r\n").mode("overwrite").csv(path)


def csv_cell(text: Column) -> Column:
    """The text as a CSV cell: quoted, with quotes doubled, if it holds a comma, a quote or a line end."""
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def frequency_lines(rows: DataFrame, counts: DataFrame, exams: DataFrame) -> DataFrame:
    """exam_id, line_no, line of the frequency tables of many exams, as sources.frequency reads them.

    rows: exam_id, position, correct, p, n_correct, disc (p and disc as they are to stand there) and, if not 'none', adjustment. counts: exam_id, position,
    pattern, cell. exams: exam_id, percent (rates from 0 to 100 and no lines about the exam; else name, date and n_examinees).
    """
    order = [*C.PATTERNS, C.BLANK, C.OTHER]
    cells = counts.groupBy("exam_id", "position").pivot("pattern", order).agg(F.first("cell"))
    cells = cells.select("exam_id", "position", F.concat_ws(",", *[F.coalesce(F.col(f"`{p}`"), F.lit("0")) for p in order]).alias("cells"))
    text = lambda c: csv_cell(F.coalesce(F.col(c).cast("string"), F.lit("")))
    adjustment = text("adjustment") if "adjustment" in rows.columns else F.lit("none")
    body = rows.join(cells, ["exam_id", "position"]).join(exams.select("exam_id", "percent"), "exam_id")
    line = F.when(F.col("percent"), F.concat_ws(",", text("position"), F.lit("5"), adjustment, text("correct"), text("p"), text("disc"), F.lit("0.1"), "cells"))
    line = line.otherwise(F.concat_ws(",", text("position"), text("correct"), text("p"), text("n_correct"), text("disc"), "cells"))
    about = [F.concat_ws(",", F.lit(label), text(c)) for label, c in (("#試験名", "name"), ("#試験日", "exam_date"), ("#受験者数", "n_examinees"))]
    names = ",".join(C.PATTERNS)
    heads = F.when(F.col("percent"), F.array(F.lit(f"問,配点,措置,正答,正答率(%),識別係数,点双列相関,{names},無解答,その他"))).otherwise(F.array(*about, F.lit(f"問題,正答肢,正答率,正答数,識別係数,{names},空白,その他")))
    head = exams.select("exam_id", F.posexplode(heads).alias("i", "line")).select("exam_id", (F.col("i") - 9).cast("long").alias("line_no"), "line")
    return head.unionByName(body.select("exam_id", F.col("position").cast("long").alias("line_no"), line.alias("line")))


def write_frequency_tables(rows: DataFrame, counts: DataFrame, exams: DataFrame, path: str) -> None:
    """A file an exam below path/exam_id=...; the lines of an exam stay in one task, which writes them in order."""
    lines = frequency_lines(rows, counts, exams)
    lines.repartition("exam_id").sortWithinPartitions("exam_id", "line_no").select("exam_id", "line").write.partitionBy("exam_id").option("lineSep", "\r\n").text(path)


def replace_exams(df: DataFrame, path: str) -> None:
    """Replace the partitions of the exams in df and leave other exams alone."""
    df.repartition("exam_id").write.partitionBy("exam_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


write_pattern_counts = replace_exams


def write_item_stats(stats: DataFrame, path: str) -> None:
    """As replace_exams, with flags as the comma text that other tools read."""
    replace_exams(stats.withColumn("flags", C.encode_flags(F.col("flags"))) if "flags" in stats.columns and dict(stats.dtypes)["flags"].startswith("array") else stats, path)


def write_tables(tables: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """Each report table under its name; arrays become comma text in CSV."""
    for name, df in tables.items():
        if kind == "csv":
            df = df.select(*[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
        df.write.mode("overwrite").option("header", True).format(kind).save(f"{path}/{name}")

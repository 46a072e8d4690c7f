"""Consecutive numbers for distributed rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itemlake.plans.scratch import materialise


def number_rows(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """df with 1..n in the order of the columns (which should decide it), without one task that holds all rows.

    Rows are range-partitioned, numbered within partitions and written; sums of the partitions' counts come on top.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, "_part").withColumn(name, F.col("_at") + F.col("_start") + 1).drop("_part", "_at", "_start")


def in_written_order(df: DataFrame, name: str = "position") -> DataFrame:
    """df with 0..n-1 in the order in which its rows were written: files by path, rows by their place in the file.

    Spark numbers the files of a write by partition, so this is the order of the DataFrame that was written, whatever
    splits a read makes. df is a read of Parquet files, perhaps with columns chosen; anything else is written first, in its order.
    """

    def located(rows: DataFrame) -> DataFrame:
        return rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at"))

    try:
        placed = located(df)
    except AnalysisException:
        placed = located(materialise(df, "in-order"))
    before = Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    starts = placed.groupBy("_path").agg((F.max("_at") + 1).alias("_n")).select("_path", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, "_path").withColumn(name, F.col("_at") + F.col("_start")).drop("_path", "_at", "_start")

"""Exact medians of many groups, hot ones too, without a list of a group's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def medians(rows: DataFrame, keys: list[str], value: Column, accuracy: int = 10_000) -> DataFrame:
    """keys, n_values, median of value by keys; nulls don't count, and a group of nulls has a null median.

    First a sketch per group, merged from partial ones, gives two values between which the middle surely
    lies (percentile_approx errs by 1 / accuracy of the ranks at most; 3 / accuracy are allowed to each side). Then
    rows below are counted and the values between, some 6 / accuracy of the group, are counted per value,
    partly in the tasks that hold them; a running sum over these few counts finds the middle ranks.
    """
    side = min(0.5, 3 / accuracy)
    named = rows.select(*keys, value.cast("double").alias("_v"))
    bounds = named.groupBy(*keys).agg(F.count("_v").alias("n_values"), F.percentile_approx("_v", F.array(F.lit(0.5 - side), F.lit(0.5 + side)), accuracy).alias("_b"))
    names = [f"_k{i}" for i in range(len(keys))]
    by_key = bounds.withColumnsRenamed(dict(zip(keys, names, strict=True)))
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    near = named.filter("_v is not null").join(by_key, on).filter(F.col("_v") <= F.col("_b")[1])
    below = F.when(F.col("_v") >= F.col("_b")[0], F.col("_v"))  # null: below, and first in order
    counts = near.groupBy(*names, "n_values", below.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*names).orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("_upto", F.sum("_n").over(upto)).filter("_v is not null")
    at = lambda rank: F.min(F.when(F.col("_upto") > F.expr(rank), F.col("_v")))
    found = counts.groupBy(*names).agg(((at("(n_values - 1) div 2") + at("n_values div 2")) / 2).alias("median"))
    return bounds.join(found, on, "left").select(*keys, "n_values", "median")

"""Values carried along sorted rows over the borders of partitions, so that no key needs a task of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itemlake.plans.scratch import materialise


def in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """df sorted by order over range partitions and stored, with each row's partition (_part) and place in it (_at).

    order should decide the order of rows; a key that holds many rows is cut into several partitions by the columns after it.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return materialise(placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"), "in-order")


def last_before(rows: DataFrame, keys: list[str], group: list[str], values: list[str], name: str) -> DataFrame:
    """rows (of in_order, by keys, group and what orders a group) with name: values of the key's last row before the row's group, a struct or null.

    Within a partition that is the row before the group's first one. A group may have begun
    in an earlier partition, though: each partition leaves one row that tells its first and last group, its
    last row and what lies before its last group; a window over these rows, one a partition, carries on what
    the next partition's first group needs. No window spans a key.
    """
    part = Window.partitionBy("_part").orderBy("_at")
    every = [*keys, *group]
    row = F.struct(*every, *values)
    same = lambda a, b, columns: F.reduce(F.array(*[a[c].eqNullSafe(b[c]) for c in columns]), F.lit(True), lambda x, y: x & y)
    found = lambda before, own: F.struct(F.when(same(before, own, keys), F.struct(*[before[v].alias(v) for v in values])).alias("row"))
    rows = rows.withColumn("_own", row).withColumn("_lag", F.lag("_own").over(part))
    starts = F.col("_lag").isNotNull() & ~same(F.col("_lag"), F.col("_own"), every)
    rows = rows.withColumn("_start", F.when(starts, found(F.col("_lag"), F.col("_own"))))
    rows = rows.withColumn("_inner", F.last("_start", ignorenulls=True).over(part.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = lambda c: F.max_by(c, "_at")
    borders = rows.groupBy("_part").agg(F.min_by("_own", "_at").alias("first"), last("_own").alias("last"), last("_inner").alias("inner"))
    over = Window.orderBy("_part")  # a row a partition
    borders = borders.withColumn("before", F.lag("last").over(over)).withColumn("left", F.lag("inner").over(over))
    begins = F.col("before").isNull() | ~same(F.col("before"), F.col("first"), every)
    entry = F.when(begins, found(F.col("before"), F.col("first"))).otherwise(F.col("left"))
    borders = borders.withColumn("entry", F.last(entry, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = rows.join(borders.select("_part", "entry"), "_part")
    return joined.withColumn(name, F.coalesce("_inner", "entry")["row"]).drop("_own", "_lag", "_start", "_inner", "entry")


def last_known(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """rows (of in_order, by keys first) with last_<value> for each of values: its last value that isn't null up to the row, within the key.

    A window spans a key's rows in one partition. What a partition's first key brings along comes from a row a partition: its first
    and last key, and what is known of the last one at its end.
    """
    own = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"_in_{v}": F.last(v, ignorenulls=True).over(own) for v in values}).withColumn("_key", F.struct(*keys))
    borders = rows.groupBy("_part").agg(
        F.min_by("_key", "_at").alias("first"), F.max_by("_key", "_at").alias("last"), *[F.max_by(F.struct(f"_in_{v}"), "_at")[f"_in_{v}"].alias(f"end_{v}") for v in values]
    )
    over = Window.orderBy("_part")  # a row a partition
    before = {c: F.lag(c).over(over) for c in ("first", "last", *[f"end_{v}" for v in values])}
    borders = borders.withColumns({f"before_{c}": e for c, e in before.items()})
    upto = over.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    goes_on = F.coalesce(F.col("before_last") == F.col("first"), F.lit(False))
    for v in values:
        none, end = F.struct(F.lit(None).cast(rows.schema[v].dataType).alias("x")), F.col(f"before_end_{v}")
        event = F.when(~goes_on, none).when(end.isNotNull(), F.struct(end.alias("x"))).when(F.col("before_first") != F.col("before_last"), none)
        borders = borders.withColumn(f"entry_{v}", F.last(event, ignorenulls=True).over(upto)["x"])
    joined = rows.join(borders.select("_part", "first", *[f"entry_{v}" for v in values]), "_part")
    found = {f"last_{v}": F.coalesce(f"_in_{v}", F.when(F.col("_key") == F.col("first"), F.col(f"entry_{v}"))) for v in values}
    return joined.withColumns(found).drop("_key", "first", *[f"_in_{v}" for v in values], *[f"entry_{v}" for v in values])

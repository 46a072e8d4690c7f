"""Records of CSV files, also where quoted cells hold line ends, from splits of long files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# A quoted cell up to its closing quote, and a whole cell; possessive, so that long lines need neither stack nor backtracking.
_BODY = '[^"]*+(?:""[^"]*+)*+'
_CELL = f'(?:"{_BODY}"[^,]*+|[^",][^,]*+|)'
_OPENS = f'(?:{_CELL},)*+"{_BODY}\\z'
#: A line that begins between cells ends inside a quoted one; so does a line that begins inside one.
OPENS, STAYS = f"(?s)\\A{_OPENS}", f'(?s)\\A{_BODY}(?:\\z|"[^,]*+,{_OPENS})'
_CELLS = f'(?s),("{_BODY}(?:"[^,]*+)?+|[^,]*+)'


def carried(df: DataFrame, keys: list[str], order: list[str], out: Column, inside: Column) -> DataFrame:
    """df with from_out and from_in: whether each row begins inside quotes, if its key's first row begins outside or inside.

    out and inside tell whether a row ends inside quotes when it begins outside or inside. Such rows are
    functions of one bit: they fix it, keep it or turn it. What holds before a row is what the last fixing
    row before it left, turned once for every turning row since: two running values of a window.
    """
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_turns", F.coalesce(F.sum((out & ~inside).cast("long")).over(before), F.lit(0)))
    fixed = F.last(F.when(out == inside, F.struct(out.alias("bit"), "_turns")), ignorenulls=True).over(before)
    df = df.withColumn("_fixed", fixed)
    since = F.col("_turns") - F.coalesce("_fixed._turns", F.lit(0))
    turned = since % 2 == 1
    bit = F.col("_fixed.bit")
    return df.withColumn("from_out", F.coalesce(bit, F.lit(False)) != turned).withColumn("from_in", F.coalesce(bit, F.lit(True)) != turned).drop("_turns", "_fixed")


def read_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, line_no, cells, unclosed of every record, with the cells that Python's csv.reader gives.

    line_no counts a file's records from 1, empty ones too (their cells are one empty text). Records end
    at a line feed, a carriage return or both, outside quoted cells; quotes count at a cell's start only,
    doubled ones inside stand for one, and what follows a closing quote is kept. A quote that nothing
    closes takes the rest of its file into its record, which is marked unclosed. A byte-order mark at a
    file's start is left out.

    Splits of a file are read in parallel. Each line is a function of whether it begins inside quotes;
    windows within a split and over the splits (a row each) carry that on. Only records of
    several lines are put together in a shuffle.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value"
    )
    pieces = lines.select("file", "split", "at", F.posexplode(F.split("value", "\r(?!\\z)")).alias("j", "piece"), F.size(F.split("value", "\r(?!\\z)")).alias("_n"))
    pieces = pieces.withColumn("sep", F.when(F.col("j") + 1 < F.col("_n"), "\r").otherwise("\n")).drop("_n")
    pieces = pieces.withColumn("opens", F.col("piece").rlike(OPENS)).withColumn("stays", F.col("piece").rlike(STAYS))
    key, order = ["file", "split"], ["at", "j"]
    pieces = carried(pieces, key, order, F.col("opens"), F.col("stays"))
    so_far = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name in ("out", "in"):
        pieces = pieces.withColumn(f"begun_{name}", F.sum((~F.col(f"from_{name}")).cast("long")).over(so_far))
    end = lambda c: F.when(F.col(c), F.col("stays")).otherwise(F.col("opens"))
    last = lambda c: F.max_by(c, F.struct(*order))
    splits = pieces.groupBy(*key).agg(last(end("from_out")).alias("opens"), last(end("from_in")).alias("stays"), F.max("begun_out").alias("n_out"), F.max("begun_in").alias("n_in"))
    splits = carried(splits, ["file"], ["split"], F.col("opens"), F.col("stays"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.coalesce(F.sum(F.when(F.col("from_out"), F.col("n_in")).otherwise(F.col("n_out"))).over(before), F.lit(0))
    splits = splits.select(*key, F.col("from_out").alias("begins_in"), begun.alias("base"))
    pieces = pieces.join(splits, key)
    pick = lambda name: F.when(F.col("begins_in"), F.col(f"{name}_in")).otherwise(F.col(f"{name}_out"))
    pieces = pieces.select(*key, *order, "piece", "sep", (F.col("base") + pick("begun")).alias("line_no"), pick("from").alias("begins"), "opens", "stays")
    pieces = pieces.withColumn("ends", F.when(F.col("begins"), F.col("stays")).otherwise(F.col("opens"))).drop("opens", "stays")
    alone = pieces.filter("not begins and not ends").select("file", "line_no", F.col("piece").alias("record"), F.lit(False).alias("unclosed"))
    parts = pieces.filter("begins or ends").groupBy("file", "line_no").agg(F.array_sort(F.collect_list(F.struct("split", "at", "j", "piece", "sep", "ends"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: F.concat(x.piece, x.sep)), "")
    parts = parts.select("file", "line_no", joined.alias("record"), F.element_at("p", -1).ends.alias("unclosed"))
    parts = parts.withColumn("record", F.expr("substring(record, 1, length(record) - 1)"))
    records = alone.unionByName(parts).withColumn("record", F.when(F.col("unclosed"), F.col("record")).otherwise(F.regexp_replace("record", "\r\\z", "")))
    return records.select("file", "line_no", F.transform(F.regexp_extract_all(F.concat(F.lit(","), "record"), F.lit(_CELLS), F.lit(1)), _unquoted).alias("cells"), "unclosed")


def _unquoted(cell: Column) -> Column:
    body = F.replace(F.regexp_extract(cell, f'(?s)\\A"({_BODY})', 1), F.lit('""'), F.lit('"'))
    rest = F.regexp_extract(cell, f'(?s)\\A"{_BODY}"(.*+)\\z', 1)
    return F.when(F.startswith(cell, F.lit('"')), F.concat(body, rest)).otherwise(cell)

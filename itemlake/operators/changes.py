"""Changes of the bank as rows to put and to delete, merged into the buckets that they touch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlake.functions import columns as C
from itemlake.operators import bank as B
from itemlake.plans.numbering import number_rows
from itemlake.plans.scratch import materialise

PUT, DELETE = "put", "delete"


def change(rows: DataFrame, kind: str = PUT) -> DataFrame:
    return rows.withColumn("change", F.lit(kind))


class BucketedTable:
    """A table at path whose rows lie in folders by a hash of bucket_key; key names a row.

    A merge reads and rewrites the buckets its changes fall into and leaves the files of others alone. Spark
    replaces a bucket when the whole job is done, so tasks that run again still find the old rows; buckets are
    replaced one by one, and a merge that was cut off is simply run again. The largest id is kept beside the table,
    so nobody has to read all rows to number new ones. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str | list[str] = "id", bucket_key: str = "id", n_buckets: int = 64):
        self.spark, self.path, self.bucket_key, self.n_buckets = spark, path, bucket_key, n_buckets
        self.key = [key] if isinstance(key, str) else key

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.bucket_key).cast("long")), F.lit(self.n_buckets)).cast("int")

    def _write(self, df: DataFrame, mode: str) -> None:
        df.repartition("_bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)

    def _mark(self, df: DataFrame) -> None:
        if self.key == ["id"]:
            df.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("top")).write.mode("append").parquet(f"{self.path}-top")

    def create(self, df: DataFrame) -> BucketedTable:
        self._write(df.withColumn("_gone", F.lit(False)).withColumn("_bucket", self._bucket()), "errorifexists")
        self._mark(df)
        return self

    def _raw(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self) -> DataFrame:
        return self._raw().filter("not _gone").drop("_gone", "_bucket")

    def top(self) -> int:
        """The largest id that ever was in the table."""
        return self.spark.read.parquet(f"{self.path}-top").agg(F.max("top")).first()[0]

    def buckets_of(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())  # n_buckets at most

    def near(self, rows: DataFrame) -> DataFrame:
        """The table's rows in the buckets of rows, which have bucket_key."""
        return self._raw().filter(F.col("_bucket").isin(self.buckets_of(rows)) & ~F.col("_gone")).drop("_gone", "_bucket")

    def merge(self, *changes: DataFrame) -> list[int]:
        """Put and delete rows; of several changes of a key the last one given counts. Returns the buckets written.

        A deleted row leaves its key, marked as gone, until its bucket is written again, so that no bucket is written empty.
        """
        raw = self._raw()
        columns = [c for c in raw.columns if c not in ("_gone", "_bucket")]
        types = {c: raw.schema[c].dataType for c in columns}
        given = [
            c.select(*[(F.col(x) if x in c.columns else F.lit(None)).cast(types[x]).alias(x) for x in columns], (F.col("change") == DELETE).alias("_gone"), F.lit(i).alias("_turn")) for i, c in enumerate(changes)
        ]
        whole = reduce(DataFrame.unionByName, given).groupBy(*self.key).agg(F.max_by(F.struct(*columns, "_gone"), "_turn").alias("x")).select("x.*")
        whole = materialise(whole.withColumn("_bucket", self._bucket()), "changes")
        buckets = sorted(r[0] for r in whole.select("_bucket").distinct().collect())  # n_buckets at most
        if buckets:
            old = raw.filter(F.col("_bucket").isin(buckets) & ~F.col("_gone")).join(whole.select(*self.key), self.key, "left_anti")
            self._write(old.unionByName(whole), "overwrite")
            self._mark(whole)
        return buckets


def register_changes(batch: DataFrame, top_question: int, top_version: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows to put into questions and versions, and the report, of bank.register_questions; ids follow the two largest so far."""
    if "derived_from" not in batch.columns:
        batch = batch.withColumn("derived_from", F.lit(None).cast("long"))
    checked = materialise(B.checked_batch(batch), "checked")
    new = number_rows(checked.filter("not blocked"), ["batch_key"], "_n").withColumn("question_id", F.col("_n") + top_question).withColumn("id", F.col("_n") + top_version)
    new = materialise(new, "new-questions")
    questions = new.select(F.col("question_id").alias("id"), "status", F.col("derived_from").cast("long").alias("derived_from"))
    versions = new.select("id", "question_id", F.lit(1).alias("version_no"), "choice_set_id", "choice_order", "correct", "stem_html")
    report = checked.select("batch_key", "blocked").join(new.select("batch_key", "question_id"), "batch_key", "left")
    return change(questions), change(versions), report


def revise_changes(versions: DataFrame, questions: DataFrame, batch: DataFrame, top_version: int, allow_inplace: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows to put into versions, and the report, of bank.revise_questions; versions and questions need only hold those of the batch's questions."""
    rows = materialise(B.revision_rows(versions, questions, batch, allow_inplace), "revisions")
    go = rows.filter("not blocked")
    new = B.next_versions(number_rows(go.filter("fresh"), ["question_id"], "_n").withColumn("id", F.col("_n") + top_version))
    fixed = go.filter("not fresh").select(F.col("old_id").alias("id"), F.col("stem_html").alias("new_stem"))
    in_place = versions.join(fixed, "id").withColumn("stem_html", F.col("new_stem")).drop("new_stem")
    return change(in_place.unionByName(new, allowMissingColumns=True)), B.revision_report(rows)


def retire_changes(questions: DataFrame, ids: DataFrame) -> DataFrame:
    """Questions in ids (question_id), of those given, with status retired."""
    return change(questions.join(ids.select(F.col("question_id").alias("id")).distinct(), "id", "left_semi").withColumn("status", F.lit("retired")))


def tag_changes(tags: DataFrame, batch: DataFrame) -> DataFrame:
    """What bank.set_tags changes in the given tags of the batch's questions (question_id, tags)."""
    new = batch.select("question_id", F.explode("tags").alias("tag")).withColumn("tag", C.trim_all(F.col("tag"))).filter("tag <> ''").distinct()
    old = tags.select("question_id", "tag").join(batch.select("question_id").distinct(), "question_id", "left_semi")
    gone = old.join(new, ["question_id", "tag"], "left_anti")
    return change(new.join(old, ["question_id", "tag"], "left_anti")).unionByName(change(gone, DELETE))

"""Places that every executor shares: the folder named in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one only for a single-JVM local session that names none."""
    configured = spark.conf.get(_KEY, None)
    context = spark.sparkContext
    if not configured:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError(f"{_KEY} must name a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(_KEY, configured)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Cutting lineage in driver loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or one made for a local session."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quadweave-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again, so columns and filters are pushed into what follows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quadweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

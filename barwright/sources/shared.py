"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a session on one machine, as in tests, gets one; on a cluster executors would
    write to folders of their own, so that is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="barwright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again, for small tables that several steps read: each is computed once
    and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

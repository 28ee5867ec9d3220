"""Tables that several parts of a query share, written once to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str | None:
    """A new path below spark.checkpoint.dir, deleted when the session ends; None where there is no such folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        return None
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, read from where it was written, so that later jobs do not compute it anew. Without a shared folder, df as it is."""
    path = scratch_path(df.sparkSession, name)
    if path is None:
        return df
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

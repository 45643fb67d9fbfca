"""Cutting the lineage of DataFrames that grow step by step, and holding what is broadcast to a bound."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the checkpoint folder, for what is wide and read column by column again and again; it goes
    when the application ends."""
    spark = df.sparkSession
    kept(spark.range(0))  # sees to the folder
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """df checkpointed in the folder all executors share; a folder of our own only on one machine."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir("/tmp/checkpoints")
    return df.checkpoint()


def bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    """df, of at most so many rows, to be broadcast; more are an error, not a slow plan."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")
    return F.broadcast(df)

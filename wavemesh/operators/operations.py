"""Run logs, samples and playback: aggregates, retention, rates and ordered operations."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def run_summary(runs: DataFrame) -> DataFrame:
    """runs, success_pct, mean_seconds, last_ms. runs: success, seconds, started_ms."""
    return runs.agg(F.count("*").alias("runs"), F.round(100 * F.avg(F.col("success").cast("int")), 4).alias("success_pct"), F.round(F.avg("seconds"), 4).alias("mean_seconds"), F.max("started_ms").alias("last_ms"))


def backend_summary(tiers: DataFrame) -> DataFrame:
    """backend ("unknown" if missing), n, mean_seconds of the tiers that succeeded."""
    return tiers.where("success").groupBy(F.coalesce("backend", F.lit("unknown")).alias("backend")).agg(F.count("*").alias("n"), F.round(F.avg("seconds"), 4).alias("mean_seconds"))


def per_day(rows: DataFrame, ms: str) -> DataFrame:
    return rows.groupBy(F.floor(F.col(ms) / 86_400_000).alias("day")).agg(F.count("*").alias("n"))


def memory_ratio(samples: DataFrame) -> DataFrame:
    """box, ratio: mean of available to total; samples without a total don't count."""
    return samples.where("total > 0").groupBy("box").agg(F.round(F.avg(F.col("available") / F.col("total")), 6).alias("ratio"))


def retained(rows: DataFrame, by: list[str], order: list[Column], keep: int) -> DataFrame:
    """The newest rows of each group."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= keep).drop("_r")


def thinned(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """At most so many rows of each group, evenly spread: those at places floor(i * n / most)."""
    w = W.partitionBy(*by)
    placed = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    # place p is taken if some i below `most` has floor(i * n / most) = p
    i = F.ceil(F.col("_i") * most / F.col("_n"))
    taken = (F.col("_n") <= most) | ((i < most) & (F.floor(i * F.col("_n") / most) == F.col("_i")))
    return placed.where(taken).drop("_i", "_n")


def bounded_log(rows: DataFrame, path: str, keep: int, order: str) -> None:
    """Appends JSON lines to a log of limited length: the newest rows stay. A bad line in the log is skipped."""
    spark = rows.sparkSession
    try:
        old = spark.read.schema(rows.schema).json(path, mode="DROPMALFORMED")
    except Exception as e:  # a missing log is an empty one
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = spark.createDataFrame([], rows.schema)
    # written aside, then put in place: a write that fails leaves the old log
    aside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    old.unionByName(rows).orderBy(F.desc(order)).limit(keep).coalesce(1).write.json(aside)
    hadoop = spark._jvm.org.apache.hadoop.fs
    log, fresh = hadoop.Path(path), hadoop.Path(aside)
    files = log.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(log):
        before = hadoop.Path(f"{aside}-before")
        files.rename(log, before)
        files.rename(fresh, log)
        files.delete(before, True)
    else:
        files.rename(fresh, log)

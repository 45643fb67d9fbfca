"""Streaming twins of batch operators; on a bounded replay they give what the batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_hearings(packets: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Packets (hash, ts, …) without repeats of a hash within the lateness; their state ages out with the watermark."""
    return packets.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["hash"])


def memory_windows(samples: DataFrame, width: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """box, start, ratio, n over tumbling windows. samples: box, ts, available, total."""
    w = samples.where("total > 0").withWatermark("ts", lateness).groupBy("box", F.window("ts", width))
    return w.agg(F.avg(F.col("available") / F.col("total")).alias("ratio"), F.count("*").alias("n")).select("box", F.col("window.start").alias("start"), "ratio", "n")


def bursts(packets: DataFrame, gap: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """observer, start, end, n of bursts of traffic that pauses part. packets: observer, ts."""
    s = packets.withWatermark("ts", lateness).groupBy("observer", F.session_window("ts", gap))
    return s.agg(F.count("*").alias("n")).select("observer", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def near_signs(targets: DataFrame, signs: DataFrame, within_s: int = 300, lateness: str = "10 minutes") -> DataFrame:
    """Targets (target, t_ts) joined with the signs of life (observer, s_ts) within so many seconds. Both sides go to time
    cells of that width, a target to the three that its window touches, and meet by cell; the bound on time lets the
    state of both age out."""
    cell = lambda ts: F.floor(F.unix_seconds(ts) / within_s)
    t = targets.withWatermark("t_ts", lateness).withColumn("cell", F.explode(F.sequence(cell(F.col("t_ts")) - 1, cell(F.col("t_ts")) + 1)))
    s = signs.withWatermark("s_ts", lateness).withColumn("s_cell", cell(F.col("s_ts")))
    bound = f"s_cell = cell AND s_ts BETWEEN t_ts - INTERVAL {within_s} SECONDS AND t_ts + INTERVAL {within_s} SECONDS"
    return t.join(s, F.expr(bound)).drop("cell", "s_cell")

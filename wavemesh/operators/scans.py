"""Ordered folds over keys of any size.

Rows are range-sorted by key and order, so that a key is cut into pieces of about equal size and no task holds all of a
hot one. Each piece is reduced to what it does to a state that comes in: a sum or a count adds, a smoothed rate scales and
adds. These few rows, one for each key and piece, are scanned in order, and what has come in is applied inside the pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import stored


def pieces(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (grp, ...) with the piece they are in; pieces of a group follow each other as their numbers do. Rows equal in
    grp and order are in one piece."""
    return stored(rows.repartitionByRange("grp", *order).withColumn("piece", F.spark_partition_id()), "pieces")


def carried(per: DataFrame, **totals) -> DataFrame:
    """per (grp, piece, ...) with the sums of columns over all pieces of the group before."""
    before = W.partitionBy("grp").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    return per.withColumns({name: F.coalesce(F.sum(c).over(before), F.lit(0)) for name, c in totals.items()})


def met(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """rows with what came into their piece; rows without a group are a group as well."""
    named = starts.withColumnsRenamed({"grp": "_g", "piece": "_p"})
    return rows.join(named, rows["grp"].eqNullSafe(named["_g"]) & (rows["piece"] == named["_p"])).drop("_g", "_p")


def warped_times(events: DataFrame, low_ms: int = 120, high_ms: int = 1500) -> DataFrame:
    """Events (grp, at_ms, id) with play_ms: gaps between neighbours held within limits, added up from 0."""
    held = lambda gap: F.when(gap.isNull() | (gap == 0), 0).otherwise(F.least(F.greatest(gap, F.lit(low_ms)), F.lit(high_ms)))
    cut = pieces(events, ["at_ms", "id"])
    order = W.partitionBy("grp", "piece").orderBy("at_ms", "id")
    inner = cut.withColumn("_gap", held(F.col("at_ms") - F.lag("at_ms").over(order)))
    per = inner.groupBy("grp", "piece").agg(F.min("at_ms").alias("first"), F.max("at_ms").alias("last"), F.sum("_gap").alias("length"))
    per = per.withColumn("join", held(F.col("first") - F.lag("last").over(W.partitionBy("grp").orderBy("piece"))))
    starts = carried(per.withColumn("both", F.col("length") + F.col("join")), before="both").select("grp", "piece", (F.col("before") + F.col("join")).alias("_start"))
    placed = inner.withColumn("_run", F.sum("_gap").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return met(placed, starts).select(*events.columns, (F.col("_start") + F.col("_run")).alias("play_ms"))


def running_count(events: DataFrame) -> DataFrame:
    """Events (grp, at_ms, ...) with how many of the group happened up to their time, at the same time included."""
    cut = pieces(events, ["at_ms"])
    starts = carried(cut.groupBy("grp", "piece").agg(F.count("*").alias("n")), before="n").select("grp", "piece", "before")
    here = F.count("*").over(W.partitionBy("grp", "piece").orderBy("at_ms").rangeBetween(W.unboundedPreceding, 0))
    return met(cut.withColumn("_here", here), starts).select(*events.columns, (F.col("before") + F.col("_here")).alias("so_far"))


def smoothed_rates(events: DataFrame, alpha: float = 0.4) -> DataFrame:
    """grp, rate: the exponentially weighted mean of a group's values in the order of time, from its first value on.
    events: grp, at_ms, id, value (null ones are left out).

    Behind n more values a value counts alpha (1 - alpha)^n, the first one (1 - alpha)^n."""
    cut = pieces(events.where("value IS NOT NULL"), ["at_ms", "id"])
    order = W.partitionBy("grp", "piece")
    placed = cut.withColumns({"_behind": F.row_number().over(order.orderBy(F.desc("at_ms"), F.desc("id"))) - 1, "_place": F.row_number().over(order.orderBy("at_ms", "id"))})
    decay = lambda n: F.pow(F.lit(1 - alpha), n)
    per = placed.groupBy("grp", "piece").agg(F.count("*").alias("n"), F.sum(F.col("value") * alpha * decay(F.col("_behind"))).alias("add"), F.max(F.when(F.col("_place") == 1, F.col("value"))).alias("first"))
    later = W.partitionBy("grp").orderBy(F.desc("piece")).rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumns({"_after": F.coalesce(F.sum("n").over(later), F.lit(0)), "_number": F.row_number().over(W.partitionBy("grp").orderBy("piece"))})
    # the state before a group's first value is that value
    start = F.when(F.col("_number") == 1, F.col("first") * decay(F.col("n"))).otherwise(0.0)
    return per.groupBy("grp").agg(F.sum((F.col("add") + start) * decay(F.col("_after"))).alias("rate"))

"""Episodes: what happened around a target packet, rebuilt from what was heard, and how a prediction compares with it.

All targets are worked on at once: packets and targets meet in time buckets that are a fraction of the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FLOOD = (0, 1)
#: What a packet without these counts as: bytes of payload and frame, bytes of a hop's hash.
PAYLOAD, FRAME, HASH_SIZE = 20, 24, 3


def in_window(packets: DataFrame, targets: DataFrame, window_ms: int, parts: int = 16) -> DataFrame:
    """Packets (hash, heard_ms, id and others) within the window around each target (target, target_hash, target_ms):
    the earliest record of each hash, with at_ms, its time from the window's start.

    A packet is recorded by many observers within moments, so of each hash a bucket's earliest record meets targets, and
    the others only those whose window begins within the bucket."""
    step = max(1, -(-window_ms // parts))
    cell = lambda ms: F.floor(ms / step)
    begin, end = cell(F.col("target_ms") - window_ms), cell(F.col("target_ms") + window_ms)
    met = F.concat(F.transform(F.sequence(begin, end), lambda c: F.struct(c.alias("cell"), F.lit(True).alias("earliest"))), F.array(F.struct(begin.alias("cell"), F.lit(False).alias("earliest"))))
    t = targets.select("target", "target_hash", "target_ms", F.inline(met).alias("_cell", "_earliest"))
    placed = packets.withColumn("_cell", cell(F.col("heard_ms")))
    placed = placed.withColumn("_earliest", F.row_number().over(W.partitionBy("hash", "_cell").orderBy("heard_ms", "id")) == 1)
    near = placed.join(t, ["_cell", "_earliest"]).where(F.abs(F.col("heard_ms") - F.col("target_ms")) <= window_ms)
    first = near.withColumn("place", F.row_number().over(W.partitionBy("target", "hash").orderBy("heard_ms", "id"))).where("place = 1")
    return first.withColumn("at_ms", F.greatest(F.lit(0), F.col("heard_ms") - (F.col("target_ms") - window_ms))).drop("_cell", "_earliest", "place")


def senders(window: DataFrame, first_hops: DataFrame, nodes: DataFrame) -> DataFrame:
    """target, hash, kind (flood or background), node, at_ms, payload_len, hash_size, frame_bytes, scoped, is_target.

    A flood starts at its origin, or at the first hop where that isn't known; other traffic loads the channel at its
    first hop. What starts at no placed node is skipped. window: the result of in_window over packets with route_type,
    origin, payload_len, hash_size, frame_bytes; first_hops: id, key; nodes: public_key, lat."""
    flood = F.col("route_type").isin(*FLOOD)
    start = F.when(flood & (F.coalesce("origin", F.lit("")) != ""), F.lower("origin")).otherwise(F.lower("key"))
    rows = window.join(first_hops.select("id", "key"), "id", "left").withColumn("node", start).where("node <> ''")
    placed = rows.join(nodes.where("lat IS NOT NULL").select(F.col("public_key").alias("node")), "node", "left_semi")
    given = lambda c, n: F.coalesce(F.when(F.col(c) > 0, F.col(c)), F.lit(n)).alias(c)
    return placed.select(
        "target", "hash", F.when(flood, "flood").otherwise("background").alias("kind"), "node", "at_ms", given("payload_len", PAYLOAD), given("hash_size", HASH_SIZE),
        F.when(~flood, F.coalesce(F.when(F.col("frame_bytes") > 0, F.col("frame_bytes")), F.lit(FRAME))).alias("frame_bytes"), F.col("route_type").isin(0, 3).alias("scoped"), (flood & (F.col("hash") == F.col("target_hash"))).alias("is_target"),
    )


def stats(states: DataFrame, delivered: DataFrame, kept: DataFrame, targets: DataFrame) -> DataFrame:
    """target, real (observers that heard it), reached (of these, by the prediction too), recall (1 without any),
    over_predicted (predicted at observers that didn't hear it), disputed (of these, such that were active and silent),
    model_reach, constrained_reach.

    states: target, observer, state, without rows for observers of which nothing is known; delivered: target, node;
    kept: target, node, kept, whether a delivery stays once contradicted nodes are taken out."""
    hit = delivered.select("target", F.col("node").alias("observer")).distinct().withColumn("hit", F.lit(True))
    both = states.join(hit, ["target", "observer"], "left")
    count = lambda c, name: F.count(F.when(F.expr(c), 1)).alias(name)
    seen = both.groupBy("target").agg(count("state = 'heard'", "real"), count("state = 'heard' AND hit", "reached"), count("state <> 'heard' AND hit", "over_predicted"), count("state = 'silent_active' AND hit", "disputed"))
    model = hit.groupBy("target").agg(F.count("*").alias("model_reach"))
    bound = kept.where("kept").select("target", "node").distinct().groupBy("target").agg(F.count("*").alias("constrained_reach"))
    rows = targets.select("target").distinct().join(seen, "target", "left").join(model, "target", "left").join(bound, "target", "left").na.fill(0)
    return rows.withColumn("recall", F.when(F.col("real") > 0, F.col("reached") / F.col("real")).otherwise(1.0))


def over_predicted(states: DataFrame, delivered: DataFrame, observers: DataFrame) -> DataFrame:
    """target, observer, state of observers that the prediction reaches and the target's observations don't name."""
    rows = delivered.select("target", F.col("node").alias("observer")).distinct().join(observers.select("observer").distinct(), "observer", "left_semi")
    return rows.join(states, ["target", "observer"], "left").select("target", "observer", F.coalesce("state", F.lit("silent_unknown")).alias("state")).where("state <> 'heard'")

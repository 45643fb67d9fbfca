"""What observers tell about a packet that they did or didn't hear."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import kept


def classified(events: DataFrame, targets: DataFrame, heard: DataFrame, slop_ms: int = 2000, alive_ms: int = 300_000) -> DataFrame:
    """target, observer, state of the observers that tell something about a target packet.

    heard: it reported the target. busy: another frame of it overlaps the target's time, widened by the slop, ends
    included. silent_active: some other activity within the liveness window. Observers without a row are silent_unknown;
    `state_counts` counts them. events: observer, hash, at_ms (end), air_ms. targets: target, hash, at_ms, air_ms.
    heard: target, observer.
    A target occurs once; targets and events without a hash tell nothing.

    Per observer and range of time, events and the targets asked about are merged in one sorted run, and the latest end of
    an event so far is carried along: by end up to the liveness window after a target, that tells activity; by start up to
    the end of the target's own frame, it tells an overlap. Events near a border go to both ranges. A target meets the
    observers of its range, not their events, so the work grows with events and states. Only where an observer has frames
    of the target's own hash, which don't count, and still isn't among the ones that heard it, are its events looked
    through one by one."""
    air = F.greatest(F.coalesce("air_ms", F.lit(0)), F.lit(0))
    e = events.where("hash IS NOT NULL AND at_ms IS NOT NULL").select("observer", F.col("hash").alias("e_hash"), F.col("at_ms").alias("e_ms"), (F.col("at_ms") - air).alias("e_start"))
    t = targets.where("hash IS NOT NULL AND at_ms IS NOT NULL").select("target", F.col("hash").alias("t_hash"), F.col("at_ms").alias("t_ms"), (F.col("at_ms") + air + slop_ms).alias("t_end"))
    longest = t.agg(F.max(F.col("t_end") - F.col("t_ms"))).first()[0] or slop_ms
    heard = heard.select("target", "observer").distinct()
    width = 2 * alive_ms
    cell = lambda ms: F.floor(ms / width)
    low, high = F.least(F.col("e_start") - longest, F.col("e_ms") - alive_ms), F.col("e_ms") + max(alive_ms, slop_ms)
    e = kept(e.withColumn("cell", F.explode(F.sequence(cell(low), cell(high)))))
    t = t.withColumn("cell", cell(F.col("t_ms")))
    asked = t.join(e.select("cell", "observer").distinct(), "cell").join(heard, ["target", "observer"], "left_anti")
    own = kept(t.join(e.select("observer", F.col("e_hash").alias("t_hash")).distinct(), "t_hash").select("target", "observer").distinct().join(heard, ["target", "observer"], "left_anti"))

    # events come before the targets that are asked for at the same time
    met = e.select("observer", "cell", F.lit(0).alias("asks"), F.col("e_ms").alias("by_end"), F.col("e_start").alias("by_start"), F.col("e_ms").alias("end"), F.lit(None).cast("long").alias("t_ms"), F.lit(None).cast(t.schema["target"].dataType).alias("target"))
    met = met.unionByName(asked.join(own, ["target", "observer"], "left_anti").select("observer", "cell", F.lit(1).alias("asks"), (F.col("t_ms") + alive_ms).alias("by_end"), F.col("t_end").alias("by_start"), F.lit(None).cast("long").alias("end"), "t_ms", "target"))
    latest = lambda key: F.max("end").over(W.partitionBy("observer", "cell").orderBy(key, "asks").rowsBetween(W.unboundedPreceding, 0))
    told = met.withColumn("alive", latest("by_end")).withColumn("overlaps", latest("by_start")).where("asks = 1")
    signs = told.select("target", "observer", F.coalesce(F.col("overlaps") >= F.col("t_ms") - slop_ms, F.lit(False)).alias("busy"), F.coalesce(F.col("alive") >= F.col("t_ms") - alive_ms, F.lit(False)).alias("alive")).where("busy OR alive").select("target", "observer", "busy")

    near = t.join(own, "target").join(e, ["observer", "cell"]).where("e_hash <> t_hash")
    busy, alive = (F.col("e_ms") >= F.col("t_ms") - slop_ms) & (F.col("e_start") <= F.col("t_end")), F.abs(F.col("e_ms") - F.col("t_ms")) <= alive_ms
    signs = signs.unionByName(near.where(busy | alive).groupBy("target", "observer").agg(F.max(busy).alias("busy")))
    states = signs.select("target", "observer", F.when(F.col("busy"), "busy").otherwise("silent_active").alias("state"))
    return states.unionByName(heard.withColumn("state", F.lit("heard")))


def state_counts(states: DataFrame, targets: DataFrame, observers: DataFrame) -> DataFrame:
    """target, heard, busy, silent_active, silent_unknown: how many observers are in each state, every target and all
    observers counted. states: target, observer, state; targets: target; observers: observer."""
    known = ("heard", "busy", "silent_active")
    per = states.groupBy("target").agg(*(F.count(F.when(F.col("state") == s, 1)).alias(s) for s in known))
    every = observers.select("observer").distinct().agg(F.count("*").alias("n"))  # one row
    rows = targets.select("target").distinct().join(per, "target", "left").na.fill(0, known).join(F.broadcast(every))
    return rows.select("target", *known, (F.col("n") - sum((F.col(s) for s in known), F.lit(0))).alias("silent_unknown"))


def constrained(deliveries: DataFrame, contradicted: DataFrame) -> DataFrame:
    """packet, node, kept: whether a node has a delivery whose path and itself avoid contradicted nodes.
    deliveries: packet, node, path (array); contradicted: packet, node."""
    bad = contradicted.groupBy("packet").agg(F.collect_set("node").alias("bad"))
    rows = deliveries.join(bad, "packet", "left").withColumn("bad", F.coalesce("bad", F.array().cast("array<long>")))
    clean = ~F.array_contains("bad", F.col("node")) & ~F.arrays_overlap("path", "bad")
    return rows.groupBy("packet", "node").agg(F.max(clean).alias("kept"))


def compared(predicted: DataFrame, proven: DataFrame, states: DataFrame) -> DataFrame:
    """a, b, verdict of predicted and proven pairs: confirmed, unmodelled, or by the state of b: refuted if it was
    active and silent, unconfirmed if it was busy or heard, unconfirmable otherwise. states: id, state."""
    both = predicted.select("a", "b", F.lit(True).alias("p")).join(proven.select("a", "b", F.lit(True).alias("q")), ["a", "b"], "full_outer").join(states.select(F.col("id").alias("b"), "state"), "b", "left")
    verdict = F.when(F.col("p") & F.col("q"), "confirmed").when(F.col("q"), "unmodelled").when(F.col("state") == "silent_active", "refuted").when(F.col("state").isin("busy", "heard"), "unconfirmed").otherwise("unconfirmable")
    return both.select("a", "b", verdict.alias("verdict"))


def recall(wanted: DataFrame, delivered: DataFrame) -> DataFrame:
    """packet, recall: the share of the observers that heard a packet which the prediction reaches too."""
    hit = wanted.select("packet", "node").distinct().join(delivered.select("packet", "node").distinct().withColumn("hit", F.lit(1)), ["packet", "node"], "left")
    return hit.groupBy("packet").agg((F.count("hit") / F.count("*")).alias("recall"))


def joint_silence(runs: DataFrame) -> DataFrame:
    """share of the valid runs in which no contradicted node got the packet. runs: run, valid, contradicted_hit."""
    each = runs.where("valid").groupBy("run").agg(F.max("contradicted_hit").alias("hit"))
    return each.agg(F.avg((~F.col("hit")).cast("int")).alias("p_silent"))


def independent_silence(rates: DataFrame) -> DataFrame:
    """packet, p: the product of 1 - rate, rates held within 0 and 0.999, in the order of node. rates: packet, node, rate."""
    each = F.transform(F.sort_array(F.collect_list(F.struct("node", "rate"))), lambda x: 1 - F.least(F.lit(0.999), F.greatest(F.lit(0.0), x["rate"])))
    return rates.groupBy("packet").agg(each.alias("v")).select("packet", F.aggregate("v", F.lit(1.0), lambda a, x: a * x).alias("p"))

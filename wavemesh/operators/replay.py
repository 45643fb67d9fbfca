"""Rebuilding a window of traffic: hops of the directory backend, events of observers, messages, checklists, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import bounded


def confident_hop(confidence: Column, nodes: Column) -> Column:
    """The key of a hop that the backend is sure of: high confidence and exactly one node; empty otherwise, in place."""
    return F.when((F.lower(confidence) == "high") & (F.size(nodes) == 1), F.lower(nodes[0])).otherwise("")


def path_prefix_bytes(path: Column, hash_size: Column) -> Column:
    """The prefixes of a path's keys as they go on air, as hex; an unknown hop takes zero bytes."""
    return F.array_join(F.transform(path, lambda k: F.when(k == "", F.rpad(F.lit(""), 2 * hash_size, F.lit("0"))).otherwise(F.substring(k, F.lit(1), 2 * hash_size))), "")


def size_label(n: Column, largest: str = "GB") -> Column:
    """Bytes in the largest unit up to `largest` (KB, MB or GB) that leaves 1 or more, with one decimal."""
    step = lambda k, unit: F.format_string(f"%.1f {unit}", F.round(n / float(1024**k), 1))
    label = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB")[: ("KB", "MB", "GB").index(largest) + 1], 1):
        label = F.when(n >= 1024**k, step(k, unit)).otherwise(label)
    return label


def preset_of(radios: DataFrame, presets: DataFrame) -> DataFrame:
    """node, preset: the first preset (ord, label, freq, bw, sf, cr) that equals a radio in all four settings."""
    hit = radios.join(bounded(presets, 10_000, "presets"), ["freq", "bw", "sf", "cr"]).groupBy("node").agg(F.min_by("label", "ord").alias("preset"))
    return radios.select("node").join(hit, "node", "left")


def needs_run(tiers: DataFrame, as_of_ms: int, force: bool = False, gpu: bool = True) -> DataFrame:
    """tier, run: tiers made today are kept unless forced; one that needs the faster device waits for it."""
    today = F.coalesce(F.floor(F.col("made_ms") / 86_400_000) == as_of_ms // 86_400_000, F.lit(False))
    return tiers.select("tier", ((F.lit(force) | ~today) & (F.lit(gpu) | ~F.col("needs_gpu"))).alias("run"))


def placed_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) whose ends both have a position, with the positions. nodes: id, lat, lon."""
    at = nodes.where("lat IS NOT NULL AND lon IS NOT NULL")
    ends = lambda x: at.select(F.col("id").alias(x), F.col("lat").alias(f"lat_{x}"), F.col("lon").alias(f"lon_{x}"))
    return links.join(ends("a"), "a").join(ends("b"), "b")


def checklist(nodes: DataFrame, tx: DataFrame, rx: DataFrame) -> DataFrame:
    """packet, origin, received, collided, missed: how many nodes (node) each packet's flood reached and how."""
    per = rx.groupBy("packet", "node").agg(F.max(~F.col("collided")).alias("ok"))
    origin = tx.where("is_origin").select("packet", "node").distinct()
    state = per.join(origin.withColumn("o", F.lit(True)), ["packet", "node"], "left").where("o IS NULL").groupBy("packet").agg(F.count(F.when(F.col("ok"), 1)).alias("received"), F.count(F.when(~F.col("ok"), 1)).alias("collided"))
    started = origin.groupBy("packet").agg(F.count("*").alias("origin"))
    every = nodes.agg(F.count("*").alias("n"))  # one row
    rows = started.join(state, "packet", "left").na.fill(0, ["received", "collided"]).join(F.broadcast(every))
    return rows.select("packet", "origin", "received", "collided", (F.col("n") - F.col("origin") - F.col("received") - F.col("collided")).alias("missed"))


def activity(tx: DataFrame, rx: DataFrame) -> DataFrame:
    """node, sent, heard, collided: what each node did and got."""
    both = tx.select("node", F.lit("sent").alias("what")).unionByName(rx.select("node", F.when(F.col("collided"), "collided").otherwise("heard").alias("what")))
    return both.groupBy("node").pivot("what", ["sent", "heard", "collided"]).count().na.fill(0)


def observer_events(packets: DataFrame, hops: DataFrame, default_bytes: int = 24) -> DataFrame:
    """observer, at_ms, hash, kind, bytes: rx for each observation, relay where a known observer stands in a path.
    packets: id, hash, observer_key, heard_ms, bytes; hops: id, key."""
    size = F.coalesce(F.when(F.col("bytes") > 0, F.col("bytes")), F.lit(default_bytes)).alias("bytes")
    rx = packets.select(F.col("observer_key").alias("observer"), F.col("heard_ms").alias("at_ms"), "hash", F.lit("rx").alias("kind"), size)
    known = packets.select(F.col("observer_key").alias("key")).distinct()
    relay = hops.select("id", F.lower("key").alias("key")).distinct().join(known, "key", "left_semi").join(packets.drop("observer_key"), "id")
    return rx.unionByName(relay.select(F.col("key").alias("observer"), F.col("heard_ms").alias("at_ms"), "hash", F.lit("relay").alias("kind"), size))


def contradicted(states: DataFrame, relays: DataFrame) -> DataFrame:
    """Observers (target, observer) that were active and silent and of which no relay (target, observer) is proven."""
    return states.where("state = 'silent_active'").select("target", "observer").join(relays, ["target", "observer"], "left_anti")


def frontier(reached: DataFrame, links: DataFrame, states: DataFrame) -> DataFrame:
    """target, node, losses: how many silent, active neighbours each reached node has. reached: target, node; links: a, b;
    states: target, observer, state."""
    silent = states.where("state = 'silent_active'").select("target", F.col("observer").alias("b"))
    rows = reached.join(links, reached["node"] == links["a"]).join(silent, ["target", "b"])
    return rows.groupBy("target", "node").agg(F.countDistinct("b").alias("losses"))


def flood_messages(packets: DataFrame) -> DataFrame:
    """hash, origin, at_ms, scoped of the floods of a window: the earliest record of each hash; an origin that isn't
    known is taken from its first record's observer. packets: id, hash, heard_ms, route_type, origin, observer."""
    order = W.partitionBy("hash").orderBy("heard_ms", "id")
    first = packets.where("route_type IN (0, 1)").withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return first.select("hash", F.coalesce(F.when(F.col("origin") != "", F.col("origin")), F.col("observer").cast("string")).alias("origin"), F.col("heard_ms").alias("at_ms"), (F.col("route_type") == 0).alias("scoped"))


def involved(hops: DataFrame, packets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Keys that stand in paths, observe or originate, and have a position. packets: observer_key, origin; nodes: public_key, lat."""
    keys = hops.select(F.lower("key").alias("public_key")).unionByName(packets.select(F.col("observer_key").alias("public_key"))).unionByName(packets.select(F.col("origin").alias("public_key")))
    return nodes.where("lat IS NOT NULL").select("public_key").join(keys.where("public_key <> ''").distinct(), "public_key", "left_semi")


def pruned(deliveries: DataFrame, kept: DataFrame) -> DataFrame:
    return deliveries.join(kept, ["packet", "node"], "left_anti")


def interpolated(marks: DataFrame, at: DataFrame) -> DataFrame:
    """grp, play_ms, source_ms: playback times turned back to source times on the line between the marks around them.
    marks: grp, play_ms, at_ms; at: grp, play_ms. Both are ordered once per group; no pair is tried."""
    both = marks.select("grp", "play_ms", "at_ms", F.lit(0).alias("ask")).unionByName(at.select("grp", "play_ms", F.lit(None).cast("long").alias("at_ms"), F.lit(1).alias("ask")))
    back = W.partitionBy("grp").orderBy("play_ms", "ask").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy("grp").orderBy("play_ms", F.desc("ask")).rowsBetween(0, W.unboundedFollowing)
    mark = F.when(F.col("ask") == 0, F.struct("play_ms", "at_ms"))
    rows = both.withColumns({"p": F.last(mark, ignorenulls=True).over(back), "q": F.first(mark, ignorenulls=True).over(ahead)}).where("ask = 1")
    share = F.when(F.col("q.play_ms") > F.col("p.play_ms"), (F.col("play_ms") - F.col("p.play_ms")) / (F.col("q.play_ms") - F.col("p.play_ms"))).otherwise(0.0)
    line = F.col("p.at_ms") + share * (F.col("q.at_ms") - F.col("p.at_ms"))
    return rows.select("grp", "play_ms", F.coalesce(line, F.col("p.at_ms").cast("double"), F.col("q.at_ms").cast("double")).alias("source_ms"))


def exported_neighbours(reach: DataFrame) -> DataFrame:
    """src, peer, heard for the other backend: each pair once, the last record (ord) wins."""
    return reach.groupBy("src", "peer").agg(F.max_by("heard", "ord").alias("heard"))


def neighbour_class(snr: Column) -> Column:
    return F.when(snr.isNull(), "unknown").when(snr >= 5, "good").when(snr >= -5, "fair").otherwise("poor")

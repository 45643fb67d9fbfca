"""Packets: windows, details, paths, hops, and who relayed what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codec

SERVER_CAP = 500


def between(packets: DataFrame, from_ms: int, to_ms: int, limit: int) -> DataFrame:
    """The newest packets heard from one time to another, both included; none for a limit of 0 or less."""
    rows = packets.where(F.col("heard_ms").between(from_ms, to_ms)).orderBy(F.desc("heard_ms"), "id")
    return rows.limit(max(0, limit))


def newest(packets: DataFrame, limit: int | None, since_ms: int | None = None) -> DataFrame:
    """The server's list: newest first, at most SERVER_CAP, which a caller can only lower."""
    rows = packets if since_ms is None else packets.where(F.col("heard_ms") >= since_ms)
    return rows.orderBy(F.desc("heard_ms"), "id").limit(SERVER_CAP if not limit or limit <= 0 else min(limit, SERVER_CAP))


def page(packets: DataFrame, offset: int, size: int) -> DataFrame:
    return packets.orderBy(F.desc("heard_ms"), "id").offset(offset).limit(size)


def details(packets: DataFrame) -> DataFrame:
    """hash, n_observations, first_ms, observers in the order of hearing, and the first observation's SNR."""
    seen = F.sort_array(F.collect_list(F.struct("heard_ms", "id", "observer", "snr")))
    rows = packets.groupBy("hash").agg(seen.alias("o"))
    return rows.select("hash", F.size("o").alias("n_observations"), F.col("o")[0]["heard_ms"].alias("first_ms"), F.array_join(F.transform("o", lambda x: x["observer"].cast("string")), ",").alias("observers"), F.col("o")[0]["snr"].alias("snr"))


def first_of_hash(packets: DataFrame) -> DataFrame:
    """The earliest packet of each hash; of equally early ones that of the least id."""
    order = W.partitionBy("hash").orderBy("heard_ms", "id")
    return packets.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def paths(hops: DataFrame) -> DataFrame:
    """id, path: the keys of a packet's hops in order, lower case, unknown ones as empty strings that keep their place."""
    return hops.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.lower("key").alias("key")))), lambda x: x["key"]).alias("path"))


def with_completeness(packets: DataFrame, hops: DataFrame) -> DataFrame:
    """id, path, path_complete, any_unknown: incomplete if a hop is unknown, or hops are counted but none is listed."""
    rows = packets.select("id", "hops").join(paths(hops), "id", "left").withColumn("path", F.coalesce("path", F.array().cast("array<string>")))
    unknown = F.exists("path", lambda h: h == "")
    return rows.select("id", F.array_join("path", "/").alias("path"), (~unknown & ~((F.size("path") == 0) & (F.col("hops") > 0))).alias("path_complete"), unknown.alias("any_unknown"))


def resolved_hops(hops: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, pos, public_key: hops whose prefix belongs to exactly one key; unknown and ambiguous ones drop out.

    The keys' prefixes of the four lengths that go on air form an equi-join, so that no pair is tried in vain."""
    keys = nodes.select(F.lower("public_key").alias("public_key")).distinct()
    prefixes = keys.select("public_key", F.explode(F.transform(F.array(*map(F.lit, (2, 4, 6, 8))), lambda n: F.substring(F.col("public_key"), F.lit(1), n))).alias("prefix"))
    unique = prefixes.groupBy("prefix").agg(F.min("public_key").alias("public_key"), F.count("*").alias("n")).where("n = 1").drop("n")
    return hops.where("prefix <> ''").withColumn("prefix", F.lower("prefix")).join(unique, "prefix").select("id", "pos", "public_key")


def participation(packets: DataFrame, hops: DataFrame, nodes: DataFrame, region: Column) -> DataFrame:
    """public_key, region, n: how often a node relays traffic of a region. Route types 0 and 3 carry regions, 1 is
    unscoped traffic (null region), 2 counts nowhere; a node twice in a path counts twice."""
    kind = packets.where("route_type <> 2").select("id", F.when(F.col("route_type") != 1, region).alias("region"), "route_type").where("route_type = 1 OR region IS NOT NULL")
    return resolved_hops(hops, nodes).join(kind, "id").groupBy("public_key", "region").agg(F.count("*").alias("n"))


def observed_scopes(counts: DataFrame) -> DataFrame:
    """public_key, scopes (sorted, null if none), unscoped_seen. counts: public_key, region, n."""
    scopes = F.array_sort(F.collect_set("region"))
    rows = counts.groupBy("public_key").agg(scopes.alias("s"), F.max(F.col("region").isNull()).alias("unscoped_seen"))
    return rows.select("public_key", F.when(F.size("s") > 0, F.array_join("s", ",")).alias("scopes"), "unscoped_seen")


def hop_pairs(hops: DataFrame) -> DataFrame:
    """id, a, b: neighbouring hops of a path where both are known."""
    order = W.partitionBy("id").orderBy("pos")
    return hops.select("id", "pos", F.lower("key").alias("a")).withColumn("b", F.lead("a").over(order)).where("a <> '' AND b <> ''").select("id", "a", "b")


def proven_edges(hops: DataFrame, packets: DataFrame) -> DataFrame:
    """a, b, first_ms: the earliest time that each edge between two different nodes was proven."""
    return hop_pairs(hops).where("a <> b").join(packets.select("id", "heard_ms"), "id").groupBy("a", "b").agg(F.min("heard_ms").alias("first_ms"))


def filled_paths(packets: DataFrame, detail: DataFrame) -> DataFrame:
    """id, path, filled: a packet's own path, else that of its detail. packets, detail: id, path."""
    rows = packets.alias("p").join(detail.alias("d"), F.expr("p.id = d.id"), "left")
    return rows.select(F.col("p.id").alias("id"), F.coalesce("p.path", "d.path").alias("path"), (F.col("p.path").isNull() & F.col("d.path").isNotNull()).alias("filled"))


def waves(receptions: DataFrame) -> DataFrame:
    """Receptions of one transmission: packet, from_node, at_ms, nodes."""
    return receptions.groupBy("packet", "from_node", "at_ms").agg(F.array_join(F.array_sort(F.collect_set(F.col("node"))), ",").alias("nodes"))


def origin_of(decoded_json: Column, field: str = "pubKey") -> Column:
    """A key in a JSON text, lower case; empty if it is missing or the text isn't JSON."""
    return F.lower(F.coalesce(F.get_json_object(decoded_json, f"$.{field}"), F.lit("")))


def frame_bytes(payload_len: Column, hops: Column, hash_size: Column, route_type: Column) -> Column:
    return F.when(payload_len <= 0, 0).otherwise(2 + hops * hash_size + payload_len + F.when(route_type.isin(0, 3), 4).otherwise(0))


def with_raw_frames(packets: DataFrame, frames: DataFrame) -> DataFrame:
    """packets with raw_hex, the frame known for their hash in lower case, the greatest of several; empty without one.
    frames: hash, raw_hex."""
    known = frames.where("hash <> '' AND raw_hex <> ''").groupBy(F.lower("hash").alias("hash")).agg(F.max(F.lower("raw_hex")).alias("raw_hex"))
    return packets.drop("raw_hex").join(known, "hash", "left").withColumn("raw_hex", F.coalesce("raw_hex", F.lit("")))


def representatives(packets: DataFrame, hops: DataFrame) -> DataFrame:
    """hash, id, path, snr: of each packet the first observation, which stands for it. packets: hash, id, heard_ms, snr."""
    first = packets.groupBy("hash").agg(F.min(F.struct("heard_ms", "id", "snr")).alias("f")).select("hash", "f.id", "f.snr")
    return first.join(paths(hops), "id", "left").select("hash", "id", F.coalesce("path", F.array().cast("array<string>")).alias("path"), "snr")


def canonical(packets: DataFrame, scopes: DataFrame) -> DataFrame:
    """packets (id, raw_hex and others) with the fields of their frame, null where it can't be read, and region, that of
    their transport code. scopes: name, at most codec.MOST_REGIONS."""
    regions = codec.regions_of(packets.select("id", "raw_hex"), scopes).select("id", "region")
    return packets.withColumn("frame", codec.frame(F.col("raw_hex"))).join(regions, "id", "left")

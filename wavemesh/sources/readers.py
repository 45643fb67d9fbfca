"""Sources and sinks: node, packet and log tables in the layouts that backends publish."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = "public_key STRING, name STRING, role STRING, lat DOUBLE, lon DOUBLE, last_heard STRING, first_seen STRING, advert_count INT, relay_count_1h INT, relay_count_24h INT, hash_size INT, default_scope STRING"
PACKET = "hash STRING, timestamp STRING, raw_hex STRING, route_type INT, observer_id STRING, resolved_path ARRAY<STRING>, snr DOUBLE, decoded_json STRING"
DIRECTORY_NODE = "id STRING, publicKey STRING, nodeTypeName STRING, name STRING, lat DOUBLE, lng DOUBLE, defaultScope STRING, iatas ARRAY<STRUCT<iata: STRING, lastHeard: BIGINT>>"
RUN = "started_at STRING, finished_at STRING, duration_seconds DOUBLE, success BOOLEAN, error STRING, version STRING, tiers ARRAY<STRUCT<name: STRING, backend: STRING, duration_seconds: DOUBLE, success: BOOLEAN, error: STRING>>"


def instant(text: Column) -> Column:
    """A time in RFC 3339; what can't be read means never."""
    return F.try_to_timestamp(text)


def nodes(spark: SparkSession, path: str, role: str | None = None) -> DataFrame:
    """Nodes as JSON lines or Parquet, by the path's ending. A role is pushed down to the scan."""
    rows = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(NODE).json(path, mode="DROPMALFORMED")
    rows = rows if role is None else rows.where(F.col("role") == role)
    return rows.withColumns({"public_key": F.lower("public_key"), "last_heard": instant(F.col("last_heard").cast("string")), "first_seen": instant(F.col("first_seen").cast("string"))})


def directory_nodes(spark: SparkSession, path: str, airport: str | None = None) -> DataFrame:
    """Nodes of the other backend: last heard is the newest hearing of any airport, none or 0 means never."""
    rows = spark.read.schema(DIRECTORY_NODE).json(path, mode="DROPMALFORMED")
    rows = rows if airport is None else rows.where(F.exists("iatas", lambda i: i["iata"] == airport))
    newest = F.array_max(F.transform("iatas", lambda i: i["lastHeard"]))
    return rows.select(F.lower("publicKey").alias("public_key"), F.coalesce("name", F.lit("")).alias("name"), F.col("nodeTypeName").alias("role"), "lat", F.col("lng").alias("lon"), F.when(newest > 0, F.timestamp_millis(newest)).alias("last_heard"), F.coalesce("defaultScope", F.lit("")).alias("default_scope"))


def packets(spark: SparkSession, path: str) -> DataFrame:
    """Packets as JSON lines; rows whose time can't be read are skipped."""
    rows = spark.read.schema(PACKET).json(path, mode="DROPMALFORMED").withColumn("heard_at", instant(F.col("timestamp")))
    return rows.where("heard_at IS NOT NULL").withColumn("heard_ms", F.unix_millis("heard_at"))


REACH = "src STRING, peer STRING, we_hear_them BIGINT, they_hear_us BIGINT, snr DOUBLE, days INT"
DIRECTORY_PACKET = "packetHash STRING, heardAt BIGINT, routeType INT, nodeId STRING, iata STRING, snr DOUBLE, rawHex STRING"


def reach(spark: SparkSession, path: str, days: int | None = None) -> DataFrame:
    """Observed reach as JSON lines: src, peer, heard, they_hear, snr, age; rows looked back for over more days drop out."""
    rows = spark.read.schema(REACH).json(path, mode="DROPMALFORMED")
    rows = rows if days is None else rows.where(F.col("days").isNull() | (F.col("days") <= days))
    return rows.select(F.lower("src").alias("src"), F.lower("peer").alias("peer"), F.coalesce("we_hear_them", F.lit(0)).alias("heard"), F.coalesce("they_hear_us", F.lit(0)).alias("they_hear"), "snr", F.col("days").alias("age"))


def directory_keys(spark: SparkSession, path: str) -> DataFrame:
    """id, public_key: which key each identifier of the other backend stands for."""
    rows = spark.read.schema(DIRECTORY_NODE).json(path, mode="DROPMALFORMED")
    return rows.where("id IS NOT NULL AND publicKey <> ''").select("id", F.lower("publicKey").alias("public_key")).distinct()


def airports(spark: SparkSession, path: str) -> DataFrame:
    """iata, nodes: the airports that hear nodes, and how many."""
    rows = spark.read.schema(DIRECTORY_NODE).json(path, mode="DROPMALFORMED")
    return rows.select("publicKey", F.explode("iatas").alias("i")).groupBy(F.col("i.iata").alias("iata")).agg(F.count_distinct("publicKey").alias("nodes"))


def directory_packets(spark: SparkSession, path: str, keys: DataFrame, since_ms: int | None = None, until_ms: int | None = None, limit: int = 500) -> DataFrame:
    """Packets of the other backend, newest first, between two times, both included: hash, heard_ms, route_type, observer
    (the key of the node's id, else empty), airport, snr, raw_hex. A limit of 0 or less is 500. keys: id, public_key."""
    rows = spark.read.schema(DIRECTORY_PACKET).json(path, mode="DROPMALFORMED").where("heardAt IS NOT NULL")
    rows = rows if since_ms is None else rows.where(F.col("heardAt") >= since_ms)
    rows = rows if until_ms is None else rows.where(F.col("heardAt") <= until_ms)
    newest = rows.orderBy(F.desc("heardAt"), "packetHash").limit(limit if limit > 0 else 500)
    named = newest.join(keys.select(F.col("id").alias("nodeId"), "public_key"), "nodeId", "left")
    return named.select(F.lower("packetHash").alias("hash"), F.col("heardAt").alias("heard_ms"), F.col("routeType").alias("route_type"), F.coalesce("public_key", F.lit("")).alias("observer"), F.col("iata").alias("airport"), "snr", F.lower(F.coalesce("rawHex", F.lit(""))).alias("raw_hex"))


def scopes(text: DataFrame) -> DataFrame:
    """name of each scope from JSON texts (value) of either shape: a list of names, or a list of objects with a name."""
    objects = F.from_json("value", "ARRAY<STRUCT<name: STRING>>")
    names = F.from_json("value", "ARRAY<STRING>")
    found = F.when(F.exists(objects, lambda o: o["name"].isNotNull()), F.transform(objects, lambda o: o["name"])).otherwise(names)
    return text.select(F.explode(found).alias("name")).where("name <> '' AND name NOT LIKE '{%'").distinct()


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The run log, JSON lines; a bad line is skipped."""
    return spark.read.schema(RUN).json(path, mode="DROPMALFORMED")


def tiers(run_log: DataFrame) -> DataFrame:
    """A row for each tier of each run."""
    return run_log.select("started_at", F.explode("tiers").alias("t")).select("started_at", "t.name", "t.backend", F.col("t.duration_seconds").alias("seconds"), "t.success")


def terrain_tiles(spark: SparkSession, path: str) -> DataFrame:
    """z, x, y and elev (256 x 256 metres, row by row) of terrain tiles stored as raw RGB bytes under z/x/y.rgb: the
    elevation is r * 256 + g + b / 256 - 32768. A tile of another size is at sea level."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rgb").option("recursiveFileLookup", "true").load(path)
    place = lambda i: F.regexp_extract("path", r"/(\d+)/(\d+)/(\d+)\.rgb$", i).cast("int")
    at = lambda i: F.conv(F.hex(F.substring("content", i + 1, F.lit(1))), 16, 10).cast("int")
    metres = F.transform(F.sequence(F.lit(0), F.lit(256 * 256 - 1)), lambda p: at(p * 3) * 256.0 + at(p * 3 + 1) + at(p * 3 + 2) / 256.0 - 32768)
    flat = F.array_repeat(F.lit(0.0), 256 * 256)
    return files.select(place(1).alias("z"), place(2).alias("x"), place(3).alias("y"), F.when(F.length("content") == 3 * 256 * 256, metres).otherwise(flat).alias("elev"))


def write_features(features: DataFrame, path: str) -> None:
    """GeoJSON features as JSON lines; the commit protocol makes the folder appear whole."""
    features.select(F.to_json("feature").alias("value")).write.mode("overwrite").text(path)


def xml_text(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def placemark(label: Column, lat: Column, lon: Column) -> Column:
    """A KML placemark of a point."""
    at = F.format_string("%.5f,%.5f,0", lon, lat)
    return F.concat(F.lit("<Placemark><name>"), xml_text(label), F.lit("</name><Point><coordinates>"), at, F.lit("</coordinates></Point></Placemark>"))


def write_kml(placemarks: DataFrame, path: str, name: str) -> None:
    """One KML document of a plan's placemarks (id, kml), in the order of id; a plan is small enough for one file."""
    spark = placemarks.sparkSession
    head = spark.range(1).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("id"), F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>'), xml_text(F.lit(name)), F.lit("</name>")).alias("value"))
    foot = spark.range(1).select(F.lit(2).alias("part"), F.lit(0).cast("long").alias("id"), F.lit("</Document></kml>").alias("value"))
    body = placemarks.select(F.lit(1).alias("part"), F.col("id").cast("long").alias("id"), F.col("kml").alias("value"))
    head.unionByName(body).unionByName(foot).coalesce(1).sortWithinPartitions("part", "id").select("value").write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows such as policy actions as CSV with a header, every value quoted."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


@F.pandas_udf(T.BinaryType())
def float32_bytes(values: pd.Series) -> pd.Series:
    """array<float> as little-endian bytes; a null value is not a number."""
    return values.map(lambda v: None if v is None else np.array(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def float32_values(content: pd.Series) -> pd.Series:
    """The values of little-endian bytes; bytes left over are ignored."""
    return content.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4"))


def write_once(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Adds rows whose keys the table doesn't hold yet, so that a repeated run changes nothing."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates(keys)
    try:
        fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    except Exception as e:  # the first run makes the table
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh.write.mode("append").parquet(path)

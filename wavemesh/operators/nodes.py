"""Nodes: normalising, selecting, classifying and describing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec, regions


def instant(ms: Column) -> Column:
    """Milliseconds since the epoch as a time; zero, negative and missing ones mean never."""
    return F.when(ms > 0, F.timestamp_millis(ms))


def normalised(raw: DataFrame) -> DataFrame:
    """Raw nodes with lower-case keys, empty texts and zeros for what is missing, and nulls for what never was."""
    return raw.select(
        F.lower("public_key").alias("public_key"), F.coalesce("name", F.lit("")).alias("name"), "role", "lat", "lon", instant(F.col("last_heard_ms")).alias("last_heard"), instant(F.col("first_seen_ms")).alias("first_seen"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("advert_count", "relay_count_24h", "hash_size")), F.coalesce("default_scope", F.lit("")).alias("default_scope"),
    )


def on_the_wire(nodes: DataFrame) -> DataFrame:
    """What is sent for a normalised node: zeros and empty texts become nulls."""
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    return nodes.withColumns({c: F.when(F.col(c) != 0, F.col(c)) for c in ("relay_count_24h", "hash_size")} | {c: blank(c) for c in ("name", "default_scope")})


def selected(nodes: DataFrame, boundary: list, required_scope: str = "") -> DataFrame:
    """Repeaters with a position inside the boundary and, if one is required, the scope."""
    scope = F.regexp_replace(F.coalesce("default_scope", F.lit("")), "^#", "")
    mine = F.lit(True) if not required_scope else scope == required_scope
    return nodes.where("role = 'repeater' AND lat IS NOT NULL AND lon IS NOT NULL").where(mine).where(regions.contains(boundary, F.col("lon"), F.col("lat")))


def status(last_heard_ms: Column, as_of_ms: int, active_h: int = 6, degraded_h: int = 24) -> Column:
    hours = (F.lit(as_of_ms) - last_heard_ms) / 3_600_000
    return F.when(hours <= active_h, "active").when(hours <= degraded_h, "degraded").otherwise("silent")


def status_counts(nodes: DataFrame, as_of_ms: int) -> DataFrame:
    """How many nodes have each status, zeros included."""
    one = lambda s: F.count(F.when(F.col("s") == s, 1)).alias(s)
    counts = nodes.select(status(F.col("last_heard_ms"), as_of_ms).alias("s")).agg(one("active"), one("degraded"), one("silent"))
    return counts.select(F.explode(F.create_map(*(x for s in ("active", "degraded", "silent") for x in (F.lit(s), F.col(s))))).alias("status", "nodes"))


def alive_at(nodes: DataFrame, ref_ms: int) -> DataFrame:
    """Nodes heard no earlier than 25 hours before, and not first seen more than an hour after."""
    hour = 3_600_000
    return nodes.where((F.col("last_heard_ms") >= ref_ms - 25 * hour) & (F.col("first_seen_ms").isNull() | (F.col("first_seen_ms") <= ref_ms + hour)))


def fresh_today(ms: Column, as_of_ms: int) -> Column:
    day = lambda x: F.floor(x / 86_400_000)
    return F.coalesce(day(ms) == day(F.lit(as_of_ms)), F.lit(False))


def type_code(role: Column) -> Column:
    return F.when(role == "repeater", 2).when(role.isin("room_server", "roomserver"), 3).when(role == "sensor", 4).otherwise(1)


def features(nodes: DataFrame, as_of_ms: int) -> DataFrame:
    """A GeoJSON feature for each node that has a position."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    properties = F.struct(F.coalesce("name", F.lit("Unnamed repeater")).alias("name"), status(F.col("last_heard_ms"), as_of_ms).alias("status"), F.round((F.lit(as_of_ms) - F.col("last_heard_ms")) / 3_600_000, 1).alias("hours_ago"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))
    return nodes.where("lat IS NOT NULL AND lon IS NOT NULL").select("public_key", feature.alias("feature"))


def scopes_of(nodes: DataFrame, observed: DataFrame) -> DataFrame:
    """public_key, scopes: the observed ones and the node's own, sorted. observed: public_key, region."""
    seen = observed.groupBy("public_key").agg(F.collect_set("region").alias("seen"))
    own = F.when(F.coalesce("default_scope", F.lit("")) != "", F.array("default_scope")).otherwise(F.array().cast("array<string>"))
    both = F.array_sort(F.array_union(F.coalesce("seen", F.array().cast("array<string>")), own))
    return nodes.join(seen, "public_key", "left").select("public_key", both.alias("scopes"))


def in_scopes(scoped: DataFrame, ticked: list[str]) -> DataFrame:
    """Rows with any ticked scope; all rows if none is ticked. "unscoped" stands for having none."""
    if not ticked:
        return scoped
    wanted = F.arrays_overlap("scopes", F.array(*(F.lit(t) for t in ticked)))
    return scoped.where(wanted | (F.lit("unscoped" in ticked) & (F.size("scopes") == 0)))


def backfilled_scopes(nodes: DataFrame, memberships: DataFrame) -> DataFrame:
    """public_key, default_scope: the node's own, else the last scope of the list that has it as a member.
    memberships: public_key, scope, ord."""
    last = memberships.groupBy("public_key").agg(F.max_by("scope", "ord").alias("scope"))
    return nodes.join(last, "public_key", "left").select("public_key", F.coalesce("default_scope", "scope").alias("default_scope"))


def nearest_site(nodes: DataFrame, sites: list[tuple[str, float, float]], fallback: str) -> DataFrame:
    """public_key, site: the first of the nearest sites by equirectangular distance; the fallback without a position."""
    d2 = lambda lat, lon: F.pow(F.col("lat") - lat, 2) + F.pow((F.col("lon") - lon) * F.cos(F.radians(F.col("lat"))), 2)
    each = F.array(*(F.struct(d2(lat, lon).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, lat, lon) in enumerate(sites)))
    return nodes.select("public_key", F.when(F.col("lat").isNull() | F.col("lon").isNull(), fallback).otherwise(F.array_min(each)["name"]).alias("site"))


def merged_settings(nodes: DataFrame, overrides: DataFrame, defaults: dict[str, object], truthy: tuple[str, ...] = ()) -> DataFrame:
    """k and each setting: the override, else the node's own, else the default. For truthy settings 0 counts as unset."""
    own = nodes.alias("n").join(overrides.alias("o"), F.expr("n.k = o.k"), "left")

    def pick(c: str) -> Column:
        value = lambda side: F.when(F.col(f"{side}.{c}") != 0, F.col(f"{side}.{c}")) if c in truthy else F.col(f"{side}.{c}")
        return F.coalesce(value("o"), value("n"), F.lit(defaults[c])).alias(c)

    return own.select(F.col("n.k").alias("k"), *(pick(c) for c in defaults))


def differences(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each key of two snapshots with what sets it apart: only_left, only_right, or the fields that differ."""
    l, r = left.select(key, F.lit(1).alias("_l"), *(F.col(f).alias(f"_l_{f}") for f in fields)), right.select(key, F.lit(1).alias("_r"), *(F.col(f).alias(f"_r_{f}") for f in fields))
    both = l.join(r, key, "full_outer")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"_l_{f}").eqNullSafe(F.col(f"_r_{f}")), f) for f in fields)))
    what = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").when(F.size(changed) > 0, F.array_join(changed, ","))
    return both.select(key, what.alias("difference")).where("difference IS NOT NULL")


def changed_buckets(left: DataFrame, right: DataFrame, key: str, fields: list[str], buckets: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """The rows of two snapshots whose buckets of keys differ. Each side is first summed up to a digest for each bucket,
    where it is, so only digests shuffle: a count and sums of two 64-bit hashes of key and fields, nulls told apart.
    Buckets of equal digests hold the same rows but for a chance of 2^-100 or so. The buckets that differ are broadcast;
    they are at most as many as there are buckets."""
    columns = [key, *fields]
    if [left.schema[c].dataType for c in columns] != [right.schema[c].dataType for c in columns]:
        raise ValueError("the snapshots' columns are of different types")
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    told = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), *told).cast("decimal(20,0)"))
    sides = [side.select(*columns, bucket.alias("_bucket")) for side in (left, right)]
    digests = [side.groupBy("_bucket").agg(F.struct(F.count("*").alias("n"), total(1).alias("s"), total(2).alias("t")).alias(name)) for side, name in zip(sides, ("_of_left", "_of_right"), strict=True)]
    differ = F.broadcast(digests[0].join(digests[1], "_bucket", "full_outer").where(~F.col("_of_left").eqNullSafe(F.col("_of_right"))).select("_bucket"))
    return tuple(side.join(differ, "_bucket", "left_semi").drop("_bucket") for side in sides)


def bucketed_differences(left: DataFrame, right: DataFrame, key: str, fields: list[str], buckets: int = 1 << 16) -> DataFrame:
    """As `differences`, for large snapshots with few changes: only buckets of keys whose digests differ are joined."""
    return differences(*changed_buckets(left, right, key, fields, buckets), key, fields)


def identities(nodes: DataFrame) -> DataFrame:
    return nodes.select("public_key", codec.uuid_of(F.col("public_key")).alias("uuid"), type_code(F.col("role")).alias("node_type"))


def reported(nodes: DataFrame, participation: DataFrame, positions: DataFrame, sites: DataFrame) -> DataFrame:
    """nodes with relays (how many hops of packets they were, 0 without any), lat and lon moved to the calibrated position
    where one was adopted, calibrated, and the site they belong to. participation: public_key, n; positions: public_key,
    lat, lon; sites: public_key, site."""
    seen = participation.groupBy("public_key").agg(F.sum("n").alias("relays"))
    moved = positions.select("public_key", F.col("lat").alias("new_lat"), F.col("lon").alias("new_lon"))
    rows = nodes.join(seen, "public_key", "left").join(moved, "public_key", "left").join(sites.select("public_key", "site"), "public_key", "left")
    return rows.withColumns({"relays": F.coalesce("relays", F.lit(0)), "calibrated": F.col("new_lat").isNotNull(), "lat": F.coalesce("new_lat", "lat"), "lon": F.coalesce("new_lon", "lon")}).drop("new_lat", "new_lon")

"""The wire format of packets, and the region codes in it, as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _byte(raw: Column, at: Column) -> Column:
    """A byte of a hex string, by its place from 0."""
    return F.conv(F.substring(raw, at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def frame(raw_hex: Column) -> Column:
    """The structure of a frame, or null if it is too short, overruns or isn't hex."""
    raw = F.lower(raw_hex)
    good = raw.rlike("^([0-9a-f]{2}){2,}$")
    raw = F.when(good, raw).otherwise("0000")
    size = (F.length(raw) / 2).cast("int")
    head = _byte(raw, F.lit(0))
    route = head.bitwiseAND(3)
    transport = route.isin(0, 3)
    at = F.when(transport, 5).otherwise(1)
    path = F.when(at < size, _byte(raw, at)).otherwise(0)
    hops, hash_size = path.bitwiseAND(63), F.shiftright(path, 6) + 1
    offset = at + 1 + hops * hash_size
    built = F.struct(
        route.alias("route_type"), F.shiftright(head, 2).bitwiseAND(15).alias("payload_type"), transport.alias("has_transport"), hops.alias("hop_count"),
        hash_size.alias("hash_size"), offset.alias("payload_offset"), (size - offset).alias("payload_len"), size.alias("total_bytes"),
    )
    return F.when(good & (at < size) & (offset <= size), built)


def region_keys(names: DataFrame) -> DataFrame:
    """name, and the two pads of HMAC-SHA256 under the first half of its digest. names: name."""
    key = F.rpad(F.substring(F.sha2("name", 256), 1, 32), 128, "0")
    pad = lambda value: F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.lower(F.hex(_byte(key, i).bitwiseXOR(value).cast("long"))), 2, "0")), ""))
    return names.select("name").distinct().select("name", pad(0x36).alias("inner_pad"), pad(0x5C).alias("outer_pad"))


def region_code(inner_pad: Column, outer_pad: Column, message: Column) -> Column:
    """The first two bytes of the HMAC, as hex in the order they go on air."""
    inner = F.unhex(F.sha2(F.concat(inner_pad, message), 256))
    return F.substring(F.sha2(F.concat(outer_pad, inner), 256), 1, 4)


#: Regions that a packet is tried with.
MOST_REGIONS = 10_000


def regions_of(packets: DataFrame, names: DataFrame) -> DataFrame:
    """id, region (the least name whose code the packet carries, or null), n_matches. packets: id, raw_hex.

    Every packet with a transport code meets every region: the list of regions is a declared catalogue of at most
    MOST_REGIONS, and its broadcast is what keeps the packets in place."""
    if names.select("name").distinct().limit(MOST_REGIONS + 1).count() > MOST_REGIONS:
        raise ValueError(f"more than {MOST_REGIONS} regions")
    parsed = packets.select("id", F.lower("raw_hex").alias("raw"), frame(F.col("raw_hex")).alias("f")).where("f.has_transport AND f.total_bytes >= 6")
    message = F.unhex(F.concat(F.lpad(F.lower(F.hex(F.col("f.payload_type").cast("long"))), 2, "0"), F.substring("raw", F.col("f.payload_offset") * 2 + 1, F.col("f.payload_len") * 2)))
    rows = parsed.select("id", F.substring("raw", 3, 4).alias("code"), message.alias("message"))
    keys = region_keys(names).agg(F.collect_list(F.struct("name", "inner_pad", "outer_pad")).alias("keys"))
    matched = F.filter("keys", lambda k: region_code(k["inner_pad"], k["outer_pad"], F.col("message")) == F.col("code"))
    found = rows.join(F.broadcast(keys)).select("id", F.transform(matched, lambda k: k["name"]).alias("names"))
    return found.select("id", F.array_min("names").alias("region"), F.size("names").alias("n_matches"))


def hmac_code(name: str, message: bytes) -> str:
    """The same code in plain Python, for tests and fixtures."""
    import hmac

    return hmac.new(hashlib.sha256(name.encode()).digest()[:16], message, hashlib.sha256).hexdigest()[:4]


def path_byte(hops: Column, hash_size: Column) -> Column:
    return F.least(hops, F.lit(63)).bitwiseOR(F.shiftleft(F.least(F.greatest(hash_size, F.lit(1)), F.lit(4)) - 1, 6))


def uuid_of(key: Column, salt: str = "wavemesh-node:") -> Column:
    """A deterministic identifier in UUID form."""
    h = F.sha2(F.concat(F.lit(salt), key), 256)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def packet_hash(pasted: Column) -> Column:
    """The first 16 hex digits that stand alone in a pasted text, in lower case; null if there are none."""
    found = F.lower(F.regexp_extract(pasted, r"(?<![0-9A-Fa-f])([0-9A-Fa-f]{16})(?![0-9A-Fa-f])", 1))
    return F.when(found != "", found)

"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size: an offset and a step from the hash
of its name, so that its order is a permutation. Shards take turns to claim their next free slot until all are taken;
they own the same number of slots, but for one. A document's hash picks its slot, and the broadcast table its shard.

Defined cases: a document with a null doc_id is placed by its text, with neither in slot hash('') mod size; rows that
repeat are placed alike; the length of a text plays no part, if it has a doc_id; no rows give no rows; other columns stay, and a column named shard or slot is replaced.
Only built-in functions run on the documents; the table's size is fixed by its parameters.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = tuple(f"shard-{i:02d}" for i in range(16))
TABLE_SIZE = 4099


def lookup_table(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """The index of the shard that owns each slot."""
    if size < len(shards) or not shards or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size has to be a prime, no smaller than the number of shards")
    number = lambda kind, name: int(hashlib.md5(f"{kind}:{name}".encode()).hexdigest()[:15], 16)
    place = [number("offset", s) % size for s in shards]
    step = [number("step", s) % (size - 1) + 1 for s in shards]
    table, left = [-1] * size, size
    while left:
        for i in range(len(shards)):
            while table[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % size
            table[place[i]] = i
            left -= 1
            if not left:
                break
    return table


def table_frame(spark: SparkSession, table: list[int]) -> DataFrame:
    """slot, shard; a constant of the plan."""
    owners = F.split(F.lit(",".join(map(str, table))), ",")
    return spark.range(1, numPartitions=1).select(F.posexplode(owners)).select(F.col("pos").alias("slot"), F.col("col").cast("int").alias("shard"))


def slot_of(key: Column, size: int) -> Column:
    return (F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % size).cast("int")


def place(docs: DataFrame, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """docs with slot and shard (an index into shards)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.col("text")), F.lit(""))
    table = F.broadcast(table_frame(docs.sparkSession, lookup_table(shards, size)))
    return docs.drop("slot", "shard").withColumn("slot", slot_of(key, size)).join(table, "slot")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 8) -> None:
    """A folder for each shard; its rows are spread over several files, so that no task writes a whole shard."""
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(files_per_shard))
    placed.repartition(len(SHARDS) * files_per_shard, "shard", spread).write.partitionBy("shard").mode("overwrite").parquet(path)

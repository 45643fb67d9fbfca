"""Readers on small files, and streaming twins on a bounded replay."""

import json

from pyspark.sql import functions as F

from wavemesh.sources import readers
from wavemesh.streaming import live


def test_readers(spark, tmp_path):
    p = tmp_path / "nodes.json"
    p.write_text("\n".join(['{"public_key": "AB", "role": "repeater", "last_heard": "2024-01-02T03:04:05Z"}', '{"public_key": "CD", "role": "sensor", "last_heard": "soon"}', "not json"]))
    rows = {r.public_key: r for r in readers.nodes(spark, str(p)).collect()}
    assert rows["ab"].last_heard is not None and rows["cd"].last_heard is None
    assert [r.public_key for r in readers.nodes(spark, str(p), "repeater").collect()] == ["ab"]
    q = tmp_path / "packets.json"
    q.write_text("\n".join(json.dumps({"hash": str(i), "timestamp": t}) for i, t in enumerate(["2024-01-01T00:00:00Z", "bad", "2024-01-01T00:00:01.5Z"])))
    assert sorted(r.heard_ms for r in readers.packets(spark, str(q)).collect()) == [1704067200000, 1704067201500]
    d = tmp_path / "directory.json"
    d.write_text(json.dumps({"publicKey": "EF", "iatas": [{"iata": "EDI", "lastHeard": 5}, {"iata": "GLA", "lastHeard": 9000}]}) + "\n" + json.dumps({"publicKey": "00", "iatas": []}))
    got = {r.public_key: r.last_heard for r in readers.directory_nodes(spark, str(d)).collect()}
    assert got["ef"].timestamp() == 9 and got["00"] is None
    two = spark.createDataFrame([('["#a", ""]',), ('[{"name": "#b"}]',)], "value string")
    assert sorted(r.name for r in readers.scopes(two).collect()) == ["#a", "#b"]


def test_terrain_tiles(spark, tmp_path):
    tile = tmp_path / "t" / "11" / "3"
    tile.mkdir(parents=True)
    (tile / "4.rgb").write_bytes(bytes([128, 10, 128]) + bytes([128, 0, 0]) * 65535)
    (tile / "5.rgb").write_bytes(b"short")
    rows = {(r.z, r.x, r.y): r.elev for r in readers.terrain_tiles(spark, str(tmp_path / "t")).collect()}
    assert rows[11, 3, 4][:2] == [10.5, 0.0] and set(rows[11, 3, 5]) == {0.0}


def test_writing_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    for n in (3, 5, 5):
        readers.write_once(spark.range(n), path, ["id"])
    assert spark.read.parquet(path).count() == 5


def test_streams_equal_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.range(400).select((F.col("id") % 150).cast("string").alias("hash"), (F.col("id") % 5).alias("observer"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 7 + F.when(F.col("id") > 200, 900).otherwise(0)).alias("ts"), F.lit("b").alias("box"), F.col("id").alias("available"), (F.col("id") + 1).alias("total"))
    rows.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)

    def played(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    firsts = played(live.first_hearings(stream, "3 hours"), "firsts", "append")
    assert firsts.count() == 150
    windows = played(live.memory_windows(stream), "windows", "complete")
    key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert key(windows) == key(live.memory_windows(rows))
    sessions = played(live.bursts(stream), "sessions", "complete")
    assert key(sessions) == key(live.bursts(rows)) and sessions.count() == 10
    signs = lambda df: df.select("observer", F.col("ts").alias("s_ts"))
    targets = lambda df: df.where("hash = '7'").select(F.col("hash").alias("target"), F.col("ts").alias("t_ts"))
    near = played(live.near_signs(targets(stream), signs(stream)), "near", "append")
    assert key(near) == key(live.near_signs(targets(rows), signs(rows))) and near.count() > 100

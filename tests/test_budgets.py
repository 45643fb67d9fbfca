"""Airtime budgets, batch and live, against a plain loop."""

import random

import pytest

from wavemesh.operators import budgets, scans

BUDGET = budgets.Budget(window_ms=40_000, factor=0.125, gate_ms=250.0)


def rows(n=3000, senders=11):
    """(grp, at_ms, id, air_ms): a third on one sender, ties in time, pauses long enough to fill up again."""
    rnd = random.Random(21)
    made = [(1 if i % 3 == 0 else rnd.randrange(2, senders), rnd.randrange(0, 3_000_000) // 40 * 40, i, rnd.randrange(200, 900)) for i in range(n)]
    return [*made, (77, 5, n + 1, 9000), (77, 5, n + 2, 10), (77, 41_000, n + 3, 10)]


def plain(sent, budget=BUDGET):
    out, state = {}, {}
    for g, at, i, air in sorted(sent, key=lambda r: (r[1], r[2])):
        left, last = state.get(g, (budget.full, at))
        left = min(budget.full, left + (at - last) * budget.factor)
        wait = int((budget.gate_ms - left) / budget.factor) if left < budget.gate_ms else 0
        after = left - air if air < left else 0.0
        out[i], state[g] = (left, after, wait), (after, at)
    return out


def found(df):
    return {r.id: (r.before_ms, r.after_ms, r.wait_ms) for r in df.collect()}


@pytest.fixture
def cut(spark):
    """Range partitions stay as many as they are."""
    keys = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


SCHEMA = "grp long, at_ms long, id long, air_ms long"


def test_budgets_over_pieces_of_a_hot_sender(spark, cut):
    sent = [*rows(), (None, 3, 4001, 700), (None, 4, 4002, 700)]
    df = spark.createDataFrame(sent, SCHEMA)
    assert scans.pieces(df, ["at_ms", "id"]).where("grp = 1").select("piece").distinct().count() >= 3
    want = plain(sent)
    got = budgets.states(df, BUDGET)
    assert got.columns == ["grp", "at_ms", "id", "air_ms", "before_ms", "after_ms", "wait_ms"]
    assert found(got) == want and sum(w > 0 for *_, w in want.values()) > 100 and any(b == BUDGET.full for b, *_ in want.values())


def test_the_published_sizes(spark):
    hour = budgets.Budget()
    assert hour.full == 1_800_000
    sent = [(1, 0, 1, 1_799_900), (1, 0, 2, 0), (1, 7_200_001, 3, 2_000_000), (1, 7_200_001, 4, 5)]
    got = found(budgets.states(spark.createDataFrame(sent, SCHEMA), budgets.Budget(gate_ms=150.0)))
    assert got[2] == (100.0, 100.0, 100)  # 50 ms short at half a millisecond a millisecond
    assert got[3] == (1_800_000.0, 0.0, 0) and got[4] == (0.0, 0.0, 300)
    assert budgets.states(spark.createDataFrame([], SCHEMA)).count() == 0


def test_live_budgets_equal_those_of_the_batch_and_age_out(spark, tmp_path):
    sent = rows(600, 7)
    ordered = sorted(sent, key=lambda r: (r[1], r[2]))
    size = 130
    for i in range(0, len(ordered), size):
        spark.createDataFrame(ordered[i : i + size], SCHEMA).selectExpr("grp", "timestamp_millis(at_ms) AS ts", "id", "air_ms").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = max(r[1] for r in sent)
    spark.createDataFrame([(500, last + 9_000_000, 9001, 1)], SCHEMA).selectExpr("grp", "timestamp_millis(at_ms) AS ts", "id", "air_ms").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        stream = spark.readStream.schema("grp long, ts timestamp, id long, air_ms long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        running = budgets.live_states(stream, BUDGET, "10 seconds").writeStream.format("memory").queryName("live_budgets").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        running.awaitTermination(150)
        assert running.exception() is None and not running.isActive
        got = found(spark.table("live_budgets"))
        states = [p["stateOperators"][0]["numRowsTotal"] for p in running.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.set(key, before)
    want = plain(sent) | plain([(500, 0, 9001, 1)])
    assert got == want
    assert states[-1] < max(states)  # all senders but the last one have been dropped

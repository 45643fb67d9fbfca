"""States of observers against looking through all events, and the work that takes."""

import random

from pyspark.sql import functions as F

from wavemesh.operators import episodes, evidence


def plain(events, targets, heard, slop=2000, alive=300_000):
    out = {(t, o): "heard" for t, o in heard}
    for t, th, tm, ta in targets:
        for o, eh, em, ea in events:
            if eh is None or th is None or eh == th or out.get((t, o)) in ("heard", "busy"):
                continue
            if em >= tm - slop and em - max(ea or 0, 0) <= tm + max(ta or 0, 0) + slop:
                out[t, o] = "busy"
            elif abs(em - tm) <= alive:
                out[t, o] = "silent_active"
    return out


def inputs(seed, n=400):
    rnd = random.Random(seed)
    events = [(rnd.randrange(9), rnd.choice("abcdefgh"), rnd.randrange(0, 6_000_000), rnd.choice([0, 50, 3000, 900_000, None, -5])) for _ in range(n)]
    events += [(1, None, 5000, 10), (2, "a", 2_999_999, 0), (2, "a", 3_000_000, 0), (3, "b", 2_400_000, 0)]
    targets = [(i, rnd.choice("abcdefgh"), rnd.randrange(0, 6_000_000), rnd.choice([0, 100, 40_000, None])) for i in range(40)]
    targets += [(40, "z", 3_000_000, 0), (41, None, 3_000_000, 0), (42, "a", 2_700_000, 0), (43, "q", 9_000_000, 10)]
    heard = sorted({(t, o) for t, th, _, _ in targets for o, eh, _, _ in events if eh == th and (t + o) % 3} | {(7, 77)})
    return events, targets, heard


def test_states_equal_those_of_all_events(spark):
    for seed, n in ((1, 400), (2, 30)):
        events, targets, heard = inputs(seed, n)
        got = evidence.classified(
            spark.createDataFrame(events, "observer long, hash string, at_ms long, air_ms long"), spark.createDataFrame(targets, "target long, hash string, at_ms long, air_ms long"), spark.createDataFrame([*heard, heard[0]], "target long, observer long")
        )
        rows = got.collect()
        assert len(rows) == len({(r.target, r.observer) for r in rows})
        assert {(r.target, r.observer): r.state for r in rows} == plain(events, targets, heard)


def test_work_grows_with_events_and_states(spark):
    """A busy observer's events aren't paired with targets."""
    events = spark.range(60_000).select((F.col("id") % 3).alias("observer"), F.concat(F.lit("e"), "id").alias("hash"), (F.col("id") * 5).alias("at_ms"), F.lit(10).alias("air_ms"))
    targets = spark.range(2000).select(F.col("id").alias("target"), F.concat(F.lit("t"), "id").alias("hash"), (F.col("id") * 150).alias("at_ms"), F.lit(10).alias("air_ms"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan is what runs
    try:
        found = evidence.classified(events, targets, spark.createDataFrame([], "target long, observer long"))
        assert [r.state for r in found.collect()] == ["busy"] * 6000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")

    def joined(node):
        metric = node.metrics().get("numOutputRows")
        own = metric.get().value() if metric.isDefined() and "Join" in node.nodeName() else 0
        return max([own, *(joined(node.children().apply(i)) for i in range(node.children().length()))])

    assert 6000 <= joined(found._jdf.queryExecution().executedPlan()) <= 4 * 6000


def test_episodes_hold_the_earliest_record_of_each_hash(spark):
    """Against looking through all packets, with many records a hash, windows that begin within bursts, and ties."""
    rnd = random.Random(3)
    heard = [(i, h, b + rnd.randrange(9)) for i, (h, b) in enumerate((h, b) for h in "abcdef" for b in rnd.choices(range(0, 400), k=6) for _ in range(8))]
    heard += [(len(heard) + i, None, 7 * i) for i in range(5)] + [(1000, "a", -50)]
    targets = [(t, "a", rnd.randrange(-20, 420)) for t in range(40)]
    packets = spark.createDataFrame(heard, "id long, hash string, heard_ms long")
    around = spark.createDataFrame(targets, "target long, target_hash string, target_ms long")
    for window, parts in ((60, 16), (60, 1), (7, 16), (0, 4)):
        want = set()
        for t, _, ms in targets:
            first = {}
            for i, h, at in heard:
                if abs(at - ms) <= window:
                    first[h] = min(first.get(h, (at, i)), (at, i))
            want |= {(t, h, i, at - (ms - window)) for h, (at, i) in first.items()}
        got = [(r.target, r.hash, r.id, r.at_ms) for r in episodes.in_window(packets, around, window, parts).collect()]
        assert len(got) == len(want) and set(got) == want

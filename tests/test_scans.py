"""Folds over pieces of keys against plain loops, with a third of all rows on one key."""

import random

import pytest
from pyspark.sql import functions as F

from wavemesh.operators import scans


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


def rows():
    rnd = random.Random(12)
    made = [(1 if i % 3 == 0 else rnd.randrange(2, 12), rnd.randrange(0, 400_000) // 50 * 50, i, rnd.uniform(-20, 20)) for i in range(3000)]
    return [*made, (99, 5, 3001, 1.5), (None, 7, 3002, 2.5), (None, 9, 3003, 3.5), (98, 1, 3004, None)]


def groups():
    out = {}
    for r in sorted(rows(), key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.fixture
def events(spark):
    return spark.createDataFrame(rows(), "grp long, at_ms long, id long, value double")


def test_no_piece_holds_a_hot_key(cut, events):
    sizes = scans.pieces(events, ["at_ms", "id"]).where("grp = 1").groupBy("piece").count().collect()
    assert len(sizes) >= 3 and max(r["count"] for r in sizes) < 600


def test_warped_times(cut, events):
    want = {}
    for rs in groups().values():
        play, last = 0, None
        for _, at, i, _ in rs:
            gap = 0 if last is None else at - last
            play, last = play + (0 if not gap else min(max(gap, 120), 1500)), at
            want[i] = play
    got = scans.warped_times(events)
    assert got.columns == ["grp", "at_ms", "id", "value", "play_ms"]
    known = {r.id: r.play_ms for r in got.collect()}
    assert known == want


def test_running_counts_take_ties_together(cut, events):
    got = {r.id: r.so_far for r in scans.running_count(events).collect()}
    assert got == {i: sum(r[1] <= at for r in rs) for rs in groups().values() for _, at, i, _ in rs}


def test_smoothed_rates(cut, events):
    want = {}
    for g, rs in groups().items():
        for *_, v in rs:
            if v is not None:
                want[g] = v if g not in want else 0.4 * v + 0.6 * want[g]
    got = {r.grp: r.rate for r in scans.smoothed_rates(events).collect()}
    assert set(got) == set(want) and all(got[g] == pytest.approx(want[g], abs=1e-9) for g in want)
    assert scans.smoothed_rates(events.where(F.lit(False))).count() == 0

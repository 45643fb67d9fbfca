"""Widest paths by merging components against plain search; large snapshots by digests of buckets; capture at a listener."""

import math
import random

import pytest

from wavemesh.operators import graph, nodes, reports


def plain_widest(edges, a, b):
    """Links in falling order of margin until both ends are joined."""
    if a == b:
        return math.inf
    of = {}

    def root(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for x, y, m in sorted(edges, key=lambda e: -e[2]):
        of[root(x)] = root(y)
        if root(a) == root(b):
            return m
    return None


@pytest.mark.parametrize("seed, n, m, levels", [(1, 40, 45, 6), (2, 30, 120, 4), (3, 60, 50, 50)])
def test_widest_paths_of_all_pairs(spark, seed, n, m, levels):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(n), rnd.randrange(n), float(rnd.randrange(levels) - 2)) for _ in range(m)]
    merged = graph.merges(spark.createDataFrame(edges, "a long, b long, margin double"))
    pairs = [(a, b) for a in range(n + 1) for b in range(n + 1)]
    got = {(r.a, r.b): r.weakest for r in graph.widest_between(spark.createDataFrame(pairs, "a long, b long"), merged).collect()}
    real = [e for e in edges if e[0] != e[1]]
    assert got == {p: plain_widest(real, *p) for p in pairs}
    assert max(len(r.ups) for r in merged.collect()) <= math.ceil(math.log2(n))


def test_a_long_chain_merges_in_few_rounds(spark):
    n = 300
    edges = [(i, i + 1, float(i)) for i in range(n)]  # every component's strongest link points the same way
    merged = graph.merges(spark.createDataFrame(edges, "a long, b long, margin double"))
    pairs = spark.createDataFrame([(0, n), (17, 250), (299, 300), (5, 999)], "a long, b long")
    assert [(r.a, r.weakest) for r in graph.widest_between(pairs, merged).orderBy("a").collect()] == [(0, 0.0), (5, None), (17, 17.0), (299, 299.0)]
    assert graph.merges(spark.createDataFrame([], "a long, b long, margin double")).count() == 0


def test_snapshots_meet_in_changed_buckets_only(spark):
    rows = [(i, None if i % 5 == 0 else f"n{i}", None if i % 7 == 0 else f"r{i % 3}") for i in range(4000)]
    other = dict((r[0], r) for r in rows)
    other[15] = (15, other[15][2], None)  # the value moves from one null to the other column
    del other[100]
    other[77] = (77, "new", other[77][2])
    other[9001] = (9001, None, None)
    schema = "k long, name string, role string"
    left, right = spark.createDataFrame(rows, schema), spark.createDataFrame(list(other.values()), schema)
    got = sorted(map(tuple, nodes.bucketed_differences(left, right, "k", ["name", "role"], buckets=512).collect()))
    assert got == sorted(map(tuple, nodes.differences(left, right, "k", ["name", "role"]).collect())) and [k for k, _ in got] == [15, 77, 100, 9001]
    few = nodes.changed_buckets(left, right, "k", ["name", "role"], buckets=512)
    assert max(x.count() for x in few) < 80  # of 4000: what shuffles is the rows of four buckets
    assert nodes.bucketed_differences(left, left, "k", ["name", "role"]).count() == 0
    assert {r.difference for r in nodes.bucketed_differences(left, right.where("false"), "k", ["name"]).collect()} == {"only_left"}
    # a row twice on one side and another one twice on the other aren't taken for equal
    a, b = spark.createDataFrame([(1, "x", "r")] * 2, schema), spark.createDataFrame([(1, "y", "r")] * 2, schema)
    assert nodes.bucketed_differences(a, b, "k", ["name"]).count() == 4
    with pytest.raises(ValueError):
        nodes.bucketed_differences(left, right.selectExpr("CAST(k AS int) AS k", "name"), "k", ["name"])


def test_outcomes_at_a_listener(spark):
    schema = "listener int, id int, node int, start_ms long, air_ms long, preamble_ms double, snr double"
    rows = [
        (1, 1, 1, 0, 400, 100.0, 10.0), (1, 2, 2, 99, 50, 10.0, 4.5),  # 5.5 dB weaker, in the preamble
        (2, 1, 1, 0, 400, 100.0, 10.0), (2, 2, 2, 100, 50, 10.0, 4.5),  # the same behind it
        (3, 1, 1, 0, 400, 100.0, 10.0), (3, 2, 2, 100, 50, 10.0, 4.0),  # 6 dB weaker
        (4, 1, 1, 0, 400, 100.0, 10.0), (4, 2, 2, 50, 50, 10.0, 2.0), (4, 3, 3, 300, 50, 10.0, 2.0), (4, 4, 1, 10, 50, 10.0, 99.0),  # two of 8 dB weaker; its own sender's
        (5, 1, 1, 0, 400, 100.0, 10.0), (5, 2, 2, 400, 50, 10.0, 20.0),  # one begins where the other ends
    ]
    got = {(r.listener, r.id): (r.outcome, r.interferers) for r in reports.capture_outcomes(spark.createDataFrame(rows, schema), 64).collect()}
    assert {k: got[k] for k in got if k[1] == 1} == {(1, 1): ("no_lock", 1), (2, 1): ("corrupted", 1), (3, 1): ("captured", 1), (4, 1): ("corrupted", 2), (5, 1): ("captured", 0)}
    assert len(got) == len(rows)


def test_outcomes_of_crowded_listeners_equal_those_of_all_pairs(spark, monkeypatch):
    """Odd lengths, no airtime, missing values, much stronger own signals, and buckets that most transmissions cross; no
    joins of transmissions with each other."""
    import math
    import random

    r = random.Random(7)
    rows = [(i % 3, i, r.choice([1, 2, 3, 4, 5, None]), r.randrange(0, 1500), r.choice([0, 0, 1, 7, 60, 300]), r.choice([0.0, 5.5, 40.0, 500.0, None]), r.choice([None, -30.0, -3.25, 0.0, 4.5, 10.0, 140.0])) for i in range(900)]
    monkeypatch.setattr(reports, "MET_TOGETHER", 100)
    monkeypatch.setattr(reports, "GROUPS_PER_TASK", 1)
    df = reports.capture_outcomes(spark.createDataFrame(rows, "listener int, id int, node int, start_ms long, air_ms long, preamble_ms double, snr double"), 64)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 2
    got = {(x.listener, x.id): (x.outcome, x.interferers) for x in df.collect()}
    want = {}
    for n, i, node, start, air, preamble, snr in rows:
        met = [b for b in rows if b[0] == n and b[1] != i and None not in (b[2], node) and b[2] != node and b[3] < start + air and start < b[3] + b[4]]
        early = max((b[6] for b in met if b[6] is not None and preamble is not None and b[3] < start + math.floor(preamble)), default=None)
        power = math.fsum(10 ** (b[6] / 10) for b in met if b[6] is not None)
        lost = snr is not None and early is not None and snr - early < 6 - 1e-9
        want[n, i] = ("no_lock" if lost else "corrupted" if snr is not None and power > 0 and snr - 10 * math.log10(power) < 6 - 1e-9 else "captured", len(met))
    assert got == want
    assert {o for o, _ in got.values()} == {"no_lock", "corrupted", "captured"}

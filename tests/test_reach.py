"""Reach of all nodes against a search from each."""

import random

import pytest

from wavemesh.operators import graph


def plain_reach(edges, nodes, relays):
    ahead = {}
    for a, b in edges:
        if a != b and a in nodes and b in nodes:
            ahead.setdefault(a, set()).add(b)
    out = {}
    for s in nodes:
        seen, todo = {s}, [s]
        while todo:
            v = todo.pop()
            for w in ahead.get(v, ()) if v == s or v in relays else ():
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        out[s] = seen - {s}
    return out


def made(seed):
    rnd = random.Random(seed)
    edges = [(i, i + 1) for i in range(6)] + [(6, 0)]  # a ring
    edges += [(10 + i, 10 + (i + 1) % 4) for i in range(4)] + [(3, 10), (12, 20), (20, 21)]
    edges += [tuple(rnd.sample(range(40), 2)) for _ in range(25)] + [(5, 5), (1, 999), (-7, 2)]
    nodes = set(range(42))
    return edges, nodes, {i for i in nodes if rnd.random() < 0.8}


@pytest.mark.parametrize("seed", [1])
def test_reach_of_all_nodes(spark, seed):
    edges, nodes, relays = made(seed)
    want = plain_reach(edges, nodes, relays)
    ids = lambda xs: spark.createDataFrame([(i,) for i in sorted(xs)], "id long")
    links = spark.createDataFrame(edges, "a long, b long")
    reach = graph.Reach(links, ids(nodes), ids(relays))
    assert {r.id: r.reached for r in reach.counts().collect()} == {i: len(w) for i, w in want.items()}
    got = [(s, i) for s in nodes for i in nodes if (s * 7 + i) % 3 == 0]
    shares = {r.start: r.share for r in reach.shares(spark.createDataFrame(got, "start long, id long")).collect()}
    assert shares == pytest.approx({s: sum((s * 7 + i) % 3 == 0 for i in w) / len(w) if w else 1.0 for s, w in want.items()})


def test_strong_components(spark):
    edges, nodes, _ = made(3)
    want = plain_reach(edges, nodes | {999, -7}, nodes | {999, -7})
    found = {r.id: r.component for r in graph.strong_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for i in want:
        with_i = {j for j in want[i] if i in want[j]} | {i}
        assert (i in found) == (len(with_i) > 1)
        if i in found:
            assert found[i] in with_i and {j for j in found if found[j] == found[i]} == with_i


def test_a_ring_makes_no_pairs(spark):
    n = 60
    ring = spark.range(n).selectExpr("id AS a", f"(id + 1) % {n} AS b").unionByName(spark.range(n).selectExpr("id AS a", f"(id * 5 + 3) % {n} AS b"))
    reach = graph.Reach(ring, spark.range(n + 1))
    assert reach.closed.count() <= 4
    assert {r.reached for r in reach.counts().where(f"id < {n}").collect()} == {n - 1} and reach.counts().where(f"id = {n}").first().reached == 0

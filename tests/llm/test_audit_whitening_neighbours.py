"""The filter audit, whitening and neighbour search against brute force, on odd inputs included."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemesh.llm import filter_audit, hnsw, whitening

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def texts(n):
    rng = np.random.default_rng(5)
    for i in range(n):
        kind = i % 6
        if kind < 2:  # a third of all rows are one text
            yield "the very common text | of many documents"
        elif kind == 2:
            yield " ".join(rng.choice(WORDS, 60))
        elif kind == 3:
            yield " ".join(f"w{i}x{k}" for k in range(60))
        elif kind == 4:
            yield "SHOUTED WORDS é " * int(rng.integers(1, 4))
        else:
            yield None if i % 4 else ""


def plain_audit(rows, labels):
    """rows: doc_id, text, source. The interactions, filter by filter and document by document."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    fails = []
    for i, t, s in rows:
        t = t or ""
        w = [x for x in t.replace("\t", " ").replace("\n", " ").split(" ") if x]
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        fails.append((s or "", {k for k, v in bad.items() if v}, *labels.get(i, (0, 0))))
    out = {}
    for order in map("".join, permutations("ABCDE")):
        for part in {f[0] for f in fails}:
            mine = [f for f in fails if f[0] == part]
            for step, own in enumerate(order, 1):
                here = [f for f in mine if own in f[1] and not f[1] & set(order[: step - 1])]
                out[part, order, step] = [sum(not f[1] & set(order[:step]) for f in mine), len(here), sum(own in f[1] for f in mine) - len(here), sum(f[1] == {own} for f in mine), sum(f[2] for f in here), sum(f[3] for f in here), 0]
    for (part, order, step), row in out.items():
        row[6] = sum(out[part, o, o.index(order[step - 1]) + 1][1] for o in map("".join, permutations("ABCDE")))
    return {k: tuple(v) for k, v in out.items()}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.mark.parametrize("ranges", [1, 7])
def test_audit_equals_brute_force(spark, ranges):
    rows = [(None if i % 17 == 3 else i - i % 2 if i % 19 == 5 else 1000 - i, t, [None, "", "a", "b"][i % 4]) for i, t in enumerate(texts(240))]
    marks = [(i, i % 3, int(i % 5 == 0)) for i in range(700, 1000)] + [(760, 0, 0), (None, 1, 1), (761, None, None)]
    labels = {}
    for i, q, x in marks:
        if i is not None:
            labels[i] = tuple(max(a, b) for a, b in zip(labels.get(i, (0, 0)), (int(q == 1), int(x == 1)), strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("part", "mask", "p1", "range", "least", "good", "lang")})
    keys = {"spark.sql.shuffle.partitions": str(ranges), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        table = filter_audit.audit(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in table} == plain_audit(rows, labels)
    assert len(table) == 3 * 120 * 5


def test_audit_of_odd_inputs(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0
    rows = [(r.doc_id, r.text, r.source) for r in odd.select("doc_id", "text", "source").collect()]
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in filter_audit.audit(odd, labels).collect()}
    assert got == plain_audit(rows, {1: (1, 1)})


def test_texts_of_one_fingerprint_stay_apart():
    walk = filter_audit.Walk()
    said = [(walk.step(*row), walk.nth, walk.least, walk.first) for row in [((1, 1), "a", None), ((1, 1), "a", 4), ((1, 1), "b", 2), ((1, 1), "b", 9), ((2, 2), "b", 3)]]
    assert [x[1:] for x in said] == [(0, None, True), (0, 4, True), (1, 2, True), (1, 2, True), (0, 3, False)]
    assert said[-1][0] == [((1, 1), 0, "a", 4), ((1, 1), 1, "b", 2)] and walk.known() == [((2, 2), -1, "b", 3)]


def plain_white(x, k):
    fit = np.unique(x, axis=0)
    c = fit - fit.mean(0)
    e, v = np.linalg.eigh(c.T @ c / len(fit))
    e, v = e[::-1], v[:, ::-1]
    return len(fit), (x - fit.mean(0)) @ v[:, :k] / np.sqrt(e[:k]), e / e.sum()


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 20)) * np.linspace(3, 0.5, 20) + 7
    vectors[100:230] = vectors[99]  # a third are one vector, which is fitted on once
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    odd = [(900, None, 1), (901, [], 1), (902, [1.0] * 19 + [None], 1), (903, [float("nan")] + [1.0] * 19, 1), (904, [float("inf")] * 20, 1), (905, [1e300] * 20, 1)]
    df = spark.createDataFrame([*rows, *odd, (None, vectors[7].tolist(), 1), rows[8]], "vec_id long, embedding array<double>, n int").withColumn("x", F.lit("clash"))
    got = whitening.whiten(df.repartition(7)).toPandas()
    x = np.floor(64 * vectors).astype(np.int64) + 1_000_000
    n, white, share = plain_white(x, 16)
    assert len(got) == 402 * 16 and set(got.n) == {n}
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    own = got[got.vec_id.notna()].drop_duplicates(["vec_id", "component"]).sort_values(["vec_id", "component"])
    w = own.whitened.to_numpy().reshape(-1, 16)
    assert np.abs(np.abs(w) - np.abs(white)).max() < 1e-8
    signs = np.sign(w * white)
    assert (signs == signs[0]).all()
    assert np.allclose(own.explained.to_numpy()[:16], share[:16], rtol=1e-9)
    fit = np.unique(x, axis=0).astype(object)
    exact = ((x.astype(object) * n - fit.sum(0)) ** 2).sum(1)
    assert own.deviation.to_numpy()[::16].tolist() == exact.tolist()


def test_whitening_without_variance_and_of_several_sizes(spark):
    schema = "vec_id long, embedding array<double>"
    flat = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], schema))
    assert flat.count() == 0 and whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)]  # one direction only
    plane = [(20 + i, [float(i % 3), float(i * i)]) for i in range(10)]
    got = whitening.whiten(spark.createDataFrame([*line, *plane], schema)).toPandas()
    assert set(got[got.vec_id < 20].component) == {1} and set(got[got.vec_id >= 20].component) == {1, 2}
    assert np.allclose(got[(got.vec_id < 20)].explained, 1) and got.identity_error.max() < 1e-9
    far = spark.createDataFrame([(i, [float(i) * 2**40, float(i % 2)]) for i in range(6)], schema)
    far = {r.vec_id: r.deviation for r in whitening.whiten(far).collect()}
    assert set(far) == set(range(6)) and set(far.values()) == {None}  # beyond a long
    x = np.array([[2**54, 3], [2**53, 5]])
    assert whitening.scaled(x, 1000, [7, 9]).tolist() == [[2**54 * 1000 - 7, 2991], [2**53 * 1000 - 7, 4991]]


def plain_nearest(rows, k=5):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)})
    out = {}
    for q, a in rows:
        if q % 50 == 0:
            cos = [(-hnsw.cosines(np.array([a]), np.array([b]))[0], i) for i, b in rows if i != q and len(a) == len(b)]
            out[q] = [(i, -s) for s, i in sorted(cos)[:k]]
    return out


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def some_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=12).round(3).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # copies, of which some are queries
    rows += [(2000 + i, [float(i + 1), 1.0]) for i in range(4)]  # few of another size
    rows += [(3000, None), (3050, []), (3100, [None] * 12), (3150, [0.0] * 12), (3200, [float("nan")] * 12), (None, rows[1][1]), rows[0], (3250, [1e200] * 12)]
    return rows


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "PER_SHARD", 60)
    monkeypatch.setattr(hnsw, "PART", 80)
    monkeypatch.setattr(hnsw, "CHUNK", 5)
    rows = some_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("node", "query", "size", "rank", "_asks2")})
    found, recall = hnsw.nearest(df, F.col("vec_id") % 50 == 0)
    got, want = ranked(found), plain_nearest(rows)
    assert recall > 0.95 and set(got) == set(want)
    assert {len(v) for k, v in got.items() if k < 2000} == {5} and len(got[2000]) == 3
    hits = [len(set(got[q]) & set(want[q])) / len(want[q]) for q in want]
    assert np.mean(hits) > 0.93
    assert got[1000] == want[1000] == [(i, 1.0) for i in (0, 1001, 1002, 1003, 1004)]


def test_nearest_compares_all_where_graphs_fall_short(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "EXACT_BELOW", 1.1)
    monkeypatch.setattr(hnsw, "BLOCK", 7)
    rows = some_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert ranked(hnsw.nearest(df, F.col("vec_id") % 50 == 0)[0]) == plain_nearest(rows)
    assert hnsw.nearest(df.where("false"), F.lit(True))[0].count() == 0
    assert hnsw.nearest(df, F.lit(None).cast("boolean"))[0].count() == 0


def test_a_graph_finds_its_vectors():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 24))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    level = hnsw.levels(np.arange(len(x)))
    order = np.argsort(-level, kind="stable")
    graph = hnsw.build(x[order], level[order])
    assert all((links < len(layer_x)).all() for links, layer_x in zip(graph.links, [graph.x[: len(a)] for a in graph.links], strict=True))
    q = graph.x[::7]
    near, _ = graph.search(q, 64, 6)
    true = np.argsort(-(q @ graph.x.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(near, true, strict=True)]) > 0.97

"""Operators that SQL doesn't check, against plain brute force on small inputs, and their bounds."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from wavemesh.operators import coverage, episodes, evidence, graph, lineage, links, planning, policies
from wavemesh.sources import readers


def pieces(nodes, edges):
    left, n = set(nodes), 0
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    while left:
        n += 1
        todo = [left.pop()]
        while todo:
            for x in near.get(todo.pop(), set()) & left:
                left.discard(x), todo.append(x)
    return n


def cuts(edges):
    nodes = {x for e in edges for x in e}
    whole = pieces(nodes, edges)
    return {v for v in nodes if pieces(nodes - {v}, [e for e in edges if v not in e]) > whole}


def both_ways(spark, edges):
    return spark.createDataFrame([(a, b) for x in edges for a, b in (x, x[::-1])], "a long, b long").distinct()


def test_articulation_points(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(5)] + [(0, 2)]  # a tail on a triangle
    for base, n, m in ((100, 30, 34), (200, 25, 40), (300, 12, 11)):  # loose, denser, and forest-like components
        edges += [tuple(base + x for x in rnd.sample(range(n), 2)) for _ in range(m)]
    edges += [(400, 401), (500, 501), (501, 502), (502, 500), (502, 503), (503, 504), (504, 502)]  # a pair, and two triangles at a node
    want = cuts(edges)
    assert 502 in want and {r.id for r in graph.articulation_points(both_ways(spark, edges)).collect()} == want
    assert graph.articulation_points(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shortest_path_and_routes(spark):
    links = spark.createDataFrame([(1, 2, 20.0), (2, 3, 3.0), (1, 4, 9.0), (4, 3, 8.0), (3, 5, 14.0), (2, 6, 13.0), (6, 3, 12.5)], "a long, b long, margin double")
    assert graph.shortest_path(links, 1, 5) == [1, 2, 3, 5] and graph.shortest_path(links, 5, 1) == []
    ends = spark.createDataFrame([(1, 5)], "a long, b long")
    got = [(r.target, r.path, r.weakest, r["rank"]) for r in graph.routes(links, ends).orderBy("rank").collect()]
    assert got == [(12.0, [1, 2, 6, 3, 5], 12.5, 1), (6.0, [1, 4, 3, 5], 8.0, 2)]


def test_greedy_and_phased_cover(spark):
    rnd = random.Random(2)
    covers = {s: {c for c in range(40) if rnd.random() < 0.2} for s in range(12)}
    rows = spark.createDataFrame([(s, c) for s, cs in covers.items() for c in cs], "site long, cell long")
    left, want = set(range(40)), []
    for pick in range(7):
        gain, site = max((len(cs & left), -s) for s, cs in covers.items())
        if not gain:
            break
        want.append((pick, -site, gain))
        left -= covers[-site]
    assert [tuple(r) for r in planning.greedy_cover(rows, 7).orderBy("pick").collect()] == want
    phases = planning.phased_cover(spark.range(40).withColumnRenamed("id", "cell"), rows.where("site < 3"), rows.where("site >= 3"), 2).collect()
    done = set().union(*(covers[s] for s in range(3)))
    first = max((len(covers[s] - done), -s) for s in range(3, 12))
    assert [(r.phase, r.gain) for r in phases if r.phase == 0] == [(0, len(done))] and (1, 0, -first[1], first[0]) in [tuple(r) for r in phases]
    assert sum(r.gain for r in phases) == 40


def test_states_with_long_frames(spark):
    """A frame longer than the liveness window makes an observer busy."""
    targets = spark.createDataFrame([(1, "h", 10_000_000, 100)], "target long, hash string, at_ms long, air_ms long")
    events = spark.createDataFrame([(7, "x", 11_000_000, 1_500_000), (8, "x", 11_000_000, 10), (9, "x", 10_299_999, None), (9, "h", 10_000_000, 1)], "observer long, hash string, at_ms long, air_ms long")
    heard = spark.createDataFrame([(1, 5)], "target long, observer long")
    states = evidence.classified(events, targets, heard)
    assert {(r.observer, r.state) for r in states.collect()} == {(7, "busy"), (9, "silent_active"), (5, "heard")}
    counts = evidence.state_counts(states, targets, spark.range(5, 15).withColumnRenamed("id", "observer")).first()
    assert (counts.heard, counts.busy, counts.silent_active, counts.silent_unknown) == (1, 1, 1, 7)
    delivered = spark.createDataFrame([(1, 5), (1, 9), (1, 12)], "target long, node long")
    stay = delivered.withColumn("kept", F.col("node") != 9)
    r = episodes.stats(states, delivered, stay, targets).first()
    assert (r.real, r.reached, r.over_predicted, r.disputed, r.model_reach, r.constrained_reach, r.recall) == (1, 1, 1, 1, 3, 2, 1.0)


def test_what_is_broadcast_is_bounded(spark):
    with pytest.raises(ValueError):
        lineage.bounded(spark.range(4), 3, "rows")
    rules = spark.createDataFrame([(i, "none", None, "n", 0.1, None, None) for i in range(policies.MOST_RULES + 1)], "rule int, kind string, threshold double, name string, tx_delay double, rx_delay double, flood_max int")
    with pytest.raises(ValueError):
        policies.applied(spark.range(1), rules)


def test_float32_values_go_round(spark):
    rows = [([1.5, -0.25, float("inf")],), ([],), (None,)]
    df = spark.createDataFrame(rows, "v array<float>").withColumn("b", readers.float32_bytes("v"))
    assert df.first().b == b"\0\0\xc0\x3f\0\0\x80\xbe\0\0\x80\x7f"
    assert [r.w for r in df.select(readers.float32_values("b").alias("w")).collect()] == [r[0] for r in rows]
    assert spark.sql("SELECT X'0000C03F00' AS b").select(readers.float32_values("b").alias("w")).first().w == [1.5]


def test_exports(spark, tmp_path):
    sites = spark.createDataFrame([(2, "b <&>", 56.5, -4.25), (1, "a", 55.0, -3.0)], "id long, name string, lat double, lon double")
    readers.write_kml(sites.select("id", readers.placemark(F.col("name"), F.col("lat"), F.col("lon")).alias("kml")), str(tmp_path / "kml"), "plan & more")
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "kml"), wholetext=True).collect())
    assert text.index("<name>a<") < text.index("<name>b &lt;&amp;&gt;<") < text.index("</Document></kml>") and "plan &amp; more" in text and "-4.25000,56.50000,0" in text
    readers.write_csv(sites.select("id", "name"), str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()) == [("1", "a"), ("2", "b <&>")]
    readers.write_features(sites.select(F.struct(F.lit("Feature").alias("type"), "id").alias("feature")), str(tmp_path / "features"))
    assert sorted(json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "features")).collect()) == [1, 2]


def test_directory_layouts(spark, tmp_path):
    def lines(name, rows):
        (tmp_path / name).write_text("\n".join([*map(json.dumps, rows), "{bad"]))
        return str(tmp_path / name)

    nodes = lines("nodes.json", [{"id": "u1", "publicKey": "AB", "iatas": [{"iata": "EDI", "lastHeard": 5}]}, {"id": "u2", "publicKey": "CD", "iatas": [{"iata": "EDI", "lastHeard": 1}, {"iata": "GLA", "lastHeard": 0}]}, {"id": "u3", "publicKey": ""}])
    assert {tuple(r) for r in readers.directory_keys(spark, nodes).collect()} == {("u1", "ab"), ("u2", "cd")}
    assert {tuple(r) for r in readers.airports(spark, nodes).collect()} == {("EDI", 2), ("GLA", 1)}
    packets = lines("packets.json", [{"packetHash": f"H{i}", "heardAt": i, "routeType": 1, "nodeId": "u1" if i % 2 else "u9", "rawHex": "FF"} for i in range(1, 8)])
    got = readers.directory_packets(spark, packets, readers.directory_keys(spark, nodes), since_ms=2, until_ms=6, limit=0)
    assert {(r.hash, r.observer, r.raw_hex) for r in got.collect()} == {(f"h{i}", "ab" if i % 2 else "", "ff") for i in range(2, 7)}
    assert [r.hash for r in readers.directory_packets(spark, packets, readers.directory_keys(spark, nodes), limit=2).orderBy("heard_ms").collect()] == ["h6", "h7"]
    reach = lines("reach.json", [{"src": "A", "peer": "B", "we_hear_them": 3, "days": 2}, {"src": "A", "peer": "C", "days": 9}, {"src": "A", "peer": "D"}])
    assert {(r.peer, r.heard, r.they_hear) for r in readers.reach(spark, reach, days=5).collect()} == {("b", 3, 0), ("d", 0, 0)}


def test_path_margins_keep_repeated_paths(spark):
    from wavemesh.functions import geo

    row = (1, 56.0, -4.0, 300.0, 56.1, -4.1, 12.0)
    df = spark.createDataFrame([row, row, (2, *row[1:6], 3.0)], "id long, lat1 double, lon1 double, tx_m double, lat2 double, lon2 double, d double")
    got = coverage.path_margins(df, lambda lat, lon: 200 + 100 * F.sin(lat * 20) * F.cos(lon * 15), geo.Radio()).orderBy("id").collect()
    assert [r.id for r in got] == [1, 1, 2] and got[0].margin == got[1].margin


def test_methods(spark):
    rows = policies.methods(spark).collect()
    assert len(rows) == 17 and len({r.method for r in rows}) == 5
    assert {r.method for r in policies.methods(spark, has_altitude=False).collect()} == {"MeshSydney (NSW)", "TennMesh", "Upstream proposed minimums (issue #2123)"}
    assert list(itertools.chain(*[[r.tx_delay] for r in rows if r.method == "TennMesh"])) == [0.3, 0.5, 1.0, 1.5, 2.0]


def test_headlines(spark):
    from wavemesh.operators import reports

    names = "node success collided tx_busy delivered unique_deliveries relays airtime_ms redundant loop_detect hop_limit region_mismatch cannot_relay weak_signal contention".split()
    rows = [(1, 3, 0, 0, 3, 0, 0, 0, 0, 5, 0, 0, 0, 0, 0), (2, 3, 0, 0, 3, 0, 0, 0, 0, 0, 0, 0, 2, 0, 0), (3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (4, 3, 0, 0, 3, 1, 2, 0, 0, 0, 0, 0, 0, 0, 0), (5, 3, 1, 0, 3, 1, 2, 0, 0, 0, 0, 0, 0, 1, 2)]
    got = {r.node: r.headline for r in reports.headlines(spark.createDataFrame(rows, " int, ".join(names) + " int"), 1000).collect()}
    assert got == {1: "relayed_none", 2: "cannot_relay", 3: "received_nothing", 4: "healthy", 5: "causes_contention"}


def test_sites_at_one_place_are_compared_once(spark):
    """Best partners, isolated sites and covers of crowded places are those of all pairs, without rows for these."""
    rnd = random.Random(5)
    spots = [(56 + rnd.random() / 5, -4 + rnd.random() / 5) for _ in range(9)]
    rows = [(i, *(spots[i % 8] if i % 11 else spots[8])) for i in range(200)] + [(200, 70.0, 5.0), (201, None, 5.0), (202, 71.0, 5.0), (203, 71.0, 5.0)]
    sites = spark.createDataFrame(rows, "id long, lat double, lon double")
    pairs = links.pairs_in_range(sites, 12.0)
    want = {(r.a, r.b, r["rank"]) for r in links.nearest(pairs, 3).collect()}
    best = links.best_in_range(sites, 12.0, 3, lambda d: d)
    assert {(r.a, r.b, r["rank"]) for r in best.collect()} == want and len(want) == 602
    coarse = links.nearest(pairs.withColumn("d", F.floor(F.col("d") / 5)).where("d < 2"), 3)  # ties between places
    assert {(r.a, r.b) for r in links.best_in_range(sites, 12.0, 3, lambda d: F.when(d < 10, F.floor(d / 5))).collect()} == {(r.a, r.b) for r in coarse.collect()}
    assert {r.id for r in links.isolated_sites(sites, 12.0).collect()} == {200, 201} == {r.id for r in links.isolated(sites, pairs).collect()}
    every = links.places(sites)
    assert every.count() == 11 and every.agg(F.sum("n")).first()[0] == 203
    cover = pairs.selectExpr("a AS site", "b AS cell").unionByName(sites.where("lat IS NOT NULL").selectExpr("id AS site", "id AS cell"))
    near = links.pairs_in_range(every.selectExpr("place AS id", "lat", "lon"), 12.0).selectExpr("a AS site", "b AS cell").unionByName(every.selectExpr("place AS site", "place AS cell"))
    weighed = near.join(every.selectExpr("place AS cell", "n AS weight"), "cell")
    assert planning.lazy_cover(weighed, 4) == planning.lazy_cover(cover, 4)
    assert weighed.count() <= 121


def test_pairs_by_place_do_the_work_once_and_deal_the_rows(spark, monkeypatch):
    """Crowded places: all pairs of sites as before, worked out between places, made in more parts as they grow."""
    spots = [(55.0, -3.0), (55.1, -3.0), (55.0, -2.7), (57.0, -3.0)]
    at = spark.createDataFrame([(i, *spots[i % 4 if i < 40 else 0]) for i in range(300)] + [(900, 56.0, 1.0), (901, None, 1.0)], "id long, lat double, lon double")
    monkeypatch.setattr(links, "ROWS_PER_TASK", 10_000)
    seen = []
    got = links.pairs_by_place(at, 35.0, lambda p: seen.append(p.count()) or p)
    assert seen[0] == 10  # four places with themselves, three of them in range of each other
    want = links.pairs_in_range(at, 35.0)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    assert got.rdd.getNumPartitions() >= got.count() // 10_000 > 4

"""Hand-made anchors for functions and graph operators."""

import pytest
from pyspark.sql import functions as F

from wavemesh.functions import codec, geo, lora, regions
from wavemesh.operators import coverage, graph, links, nodes, operations, packets, reports


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_airtime_of_twenty_bytes_at_the_default_radio(spark):
    assert value(spark, lora.airtime_ms(F.lit(8), F.lit(62.5), F.lit(8), F.lit(20))) == 377
    assert 377 <= value(spark, lora.airtime_exact_ms(F.lit(8), F.lit(62.5), F.lit(8), F.lit(20))) < 378
    assert value(spark, lora.airtime_exact_ms(F.lit(0), F.lit(62.5), F.lit(8), F.lit(20))) == 0


def test_radio_anchors(spark):
    assert value(spark, geo.haversine_km(F.lit(51.5074), F.lit(-0.1278), F.lit(48.8566), F.lit(2.3522))) == pytest.approx(344, abs=1)
    assert value(spark, geo.free_space_db(F.lit(1.0), 868.0)) == pytest.approx(91.21, abs=0.01)
    assert value(spark, geo.knife_edge_db(F.lit(0.0))) == pytest.approx(6.03, abs=0.01)
    assert value(spark, geo.knife_edge_db(F.lit(-0.78))) == 0
    assert geo.Radio(max_range_km=0).range_km() == pytest.approx(78, abs=1)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("001122334400aabbcc", (0, True, 0, 1, 6, 3, 9)),
        ("0100aabbcc", (1, False, 0, 1, 2, 3, 5)),
        ("0182aabbccddeeff1234", (1, False, 2, 3, 8, 2, 10)),
        *((bad, None) for bad in ("", "00", "00112233", "0105aa", "zzzz", None)),
    ],
)
def test_frames(spark, raw, want):
    f = value(spark, codec.frame(F.lit(raw).cast("string")))
    got = f and (f.route_type, f.has_transport, f.hop_count, f.hash_size, f.payload_offset, f.payload_len, f.total_bytes)
    assert got == want


def test_region_of_a_packet_by_its_code(spark):
    payload = bytes(range(40))
    code = codec.hmac_code("#north", bytes([4]) + payload)
    raw = f"{4 << 2:02x}{code}000001aa{payload.hex()}"
    rows = spark.createDataFrame([(1, raw), (2, "15" + raw[2:]), (3, "01" + raw[2:])], "id long, raw_hex string")
    names = spark.createDataFrame([("#south",), ("#north",), ("#east",)], "name string")
    got = {r.id: (r.region, r.n_matches) for r in codec.regions_of(rows, names).collect()}
    assert got == {1: ("#north", 1)}


def test_ambiguous_and_unknown_prefixes_resolve_to_nothing(spark):
    keys = spark.createDataFrame([("aabbcc01",), ("aabbcc02",), ("70D1E5FF",)], "public_key string")
    hops = spark.createDataFrame([(1, 0, "aabbcc"), (1, 1, "70d1e5"), (1, 2, "112233"), (1, 3, "")], "id long, pos int, prefix string")
    assert [(r.pos, r.public_key) for r in packets.resolved_hops(hops, keys).collect()] == [(1, "70d1e5ff")]


def undirected(spark, edges):
    return spark.createDataFrame([e for a, b in edges for e in ((a, b), (b, a))], "a long, b long")


@pytest.mark.parametrize(
    ("edges", "cut"),
    [
        ([(7, 3), (3, 9), (9, 1)], {3, 9}),
        ([(2, 5), (5, 8), (8, 4), (4, 2)], set()),
        ([(1, 6), (6, 8), (8, 1), (8, 9), (9, 3), (3, 7), (7, 8), (7, 9)], {8}),
    ],
)
def test_articulation_points(spark, edges, cut):
    assert {r.id for r in graph.articulation_points(undirected(spark, edges)).collect()} == cut


def test_links_to_missing_nodes_drop_out(spark):
    links = spark.createDataFrame([(1, 2), (2, 1), (2, 2), (2, 900), (-4, 1), (3, 2)], "a long, b long")
    assert sorted(tuple(r) for r in graph.undirected(links, spark.range(1, 5)).collect()) == [(1, 2), (2, 1), (2, 3), (3, 2)]


def test_marginal_coverage_equals_two_paths(spark):
    import random

    rnd = random.Random(11)
    edges = {tuple(sorted(rnd.sample(range(60), 2))) for _ in range(150)} | {(60, i) for i in range(0, 60, 2)}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {i: sum(not any(b in near[c] for c in near[i] if c != b) for b in near.get(i, ())) for i in range(63)}
    got = {r.id: r.marginal for r in graph.marginal_coverage(undirected(spark, edges), spark.range(63)).collect()}
    assert got == want and 0 < sum(want.values())


def test_a_hub_makes_no_pairs_of_its_leaves(spark):
    star = spark.range(1, 100_001).selectExpr("0L AS a", "id AS b")
    both = star.unionByName(star.selectExpr("b AS a", "a AS b"))
    assert graph.in_triangles(both).count() == 0
    got = graph.marginal_coverage(both, spark.range(100_001))
    assert got.where("id = 0").first().marginal == 100_000 and got.where("marginal = 1").count() == 100_000


def test_marginal_coverage_of_a_star(spark):
    n = undirected(spark, [(0, i) for i in range(1, 5)])
    ids = spark.range(5)
    assert {r.id: r.marginal for r in graph.marginal_coverage(n, ids).collect()} == {0: 4, 1: 1, 2: 1, 3: 1, 4: 1}


def test_reach_stops_at_nodes_that_dont_relay(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long")
    got = graph.reached(e, spark.range(1).select(F.col("id").alias("start")), spark.createDataFrame([(2,)], "id long"))
    assert {(r.id, r.hops) for r in got.collect()} == {(0, 0), (1, 1)}
    assert graph.shortest_path(e, 0, 3) == [0, 1, 2, 3]
    assert graph.shortest_path(e, 3, 0) == []


def test_boundaries(spark):
    square = '{"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0,0],[4,0],[4,4],[0,4],[0,0]]]}}, {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[9,9],[12,9],[12,12],[9,12]]]}}]}'
    b = regions.parse_geojson(square)
    pts = spark.createDataFrame([(1, 2.0, 2.0), (2, 10.0, 10.0), (3, 5.0, 5.0)], "id long, lon double, lat double")
    assert {r.id for r in regions.points_inside(pts, regions.boundary_edges(spark, b)).collect()} == {1, 2}
    assert {r.id for r in pts.where(regions.contains(b, F.col("lon"), F.col("lat"))).collect()} == {1, 2}
    for bad in ('{"type": "LineString", "coordinates": []}', '{"type": "FeatureCollection", "features": []}'):
        with pytest.raises(ValueError):
            regions.parse_geojson(bad)


def test_reach_of_two_backends_rows(spark):
    n = spark.createDataFrame([(1, 2, 10, 1), (2, 1, 3, 1), (1, 3, 4, None), (1, 4, 9, 30)], "src long, peer long, heard long, age int")
    got = {r.peer: (r.bottleneck, r.bidir) for r in links.synthesised_reach(n, 7).where("src = 1").collect()}
    assert got == {2: (3, True), 3: (4, False)}


def test_pairs_in_range_equal_all_pairs(spark):
    at = spark.range(80).selectExpr("id", "50 + (id * 37 % 100) / 40.0D AS lat", "3 + (id * 61 % 90) / 30.0D AS lon")
    rows = at.collect()
    import math

    def d(a, b):
        x = math.sin(math.radians(b.lat - a.lat) / 2) ** 2 + math.cos(math.radians(a.lat)) * math.cos(math.radians(b.lat)) * math.sin(math.radians(b.lon - a.lon) / 2) ** 2
        return 2 * geo.EARTH_KM * math.asin(math.sqrt(x))

    want = {(a.id, b.id) for a in rows for b in rows if a.id != b.id and d(a, b) <= 30}
    got = [(r.a, r.b) for r in links.pairs_in_range(at, 30.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_higher_ridge_costs_margin(spark):
    def margin(ridge):
        ground = lambda lat, lon: F.when(F.abs(lon - 0.05) < 0.005, ridge).otherwise(0.0)
        d = geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.1))
        p = spark.range(1).select(F.lit(0.0).alias("lat1"), F.lit(0.0).alias("lon1"), F.lit(50.0).alias("tx_m"), F.lit(0.0).alias("lat2"), F.lit(0.1).alias("lon2"), d.alias("d"))
        return coverage.path_margins(p, ground, geo.Radio()).first().margin

    assert margin(0.0) > margin(60.0) > margin(200.0)


def test_calibration_moves_only_where_it_pays(spark):
    ground = lambda lat, lon: F.when(F.abs(lat - 56.0) < 0.001, 0.0).otherwise(120.0)  # noqa: E731  the reported place is in a ditch
    n = spark.createDataFrame([(1, 56.0, -4.0), (2, 57.0, -4.0)], "node long, lat double, lon double")
    l = spark.createDataFrame([(1, 56.3, -4.0, 5), (1, 55.7, -4.1, 9), (2, 57.05, -4.0, 5)], "node long, plat double, plon double, bottleneck long")
    got = {r.node: (r.adopted, r.ring > 0) for r in coverage.calibrated(coverage.candidates(n, 300.0), l, ground, geo.Radio()).collect()}
    assert got == {1: (True, True)}


def test_retransmit_delays_are_spread_and_repeatable(spark):
    draw = lambda seed: [r.d for r in spark.range(6000).orderBy("id").select(lora.retransmit_delay_ms(F.lit(21), F.lit(0.1), seed, F.col("id")).alias("d")).collect()]
    got = draw("a")
    assert got == draw("a") != draw("b") and set(got) == set(range(11))
    assert all(400 < got.count(d) < 700 for d in range(11))


def test_thinning_and_logs(spark, tmp_path):
    rows = spark.range(23).select(F.lit(1).alias("g"), "id")
    assert [r.id for r in operations.thinned(rows, ["g"], [F.col("id")], 7).orderBy("id").collect()] == [i * 23 // 7 for i in range(7)]
    log = str(tmp_path / "log")
    for i in range(3):
        operations.bounded_log(spark.range(i * 10, i * 10 + 4), log, 5, "id")
    assert sorted(r.id for r in spark.read.json(log).collect()) == [13, 20, 21, 22, 23]


def test_status_limits_are_included(spark):
    hour = 3_600_000
    rows = spark.createDataFrame([(6 * hour,), (6 * hour + 1,), (24 * hour,), (24 * hour + 1,), (None,)], "age long")
    got = [r.s for r in rows.select(nodes.status(F.lit(10**12) - F.col("age"), 10**12).alias("s")).collect()]
    assert got == ["active", "degraded", "degraded", "silent", "silent"]


def test_overlaps_are_counted_once(spark):
    rows = [(1, 1, 0, 5000), (2, 2, 4999, 10), (3, 3, 5000, 10), (4, 1, 100, 10)]
    tx = spark.createDataFrame([(n, *r) for n in (7, 8) for r in rows if r[0] + n != 11], "listener long, id long, node long, start_ms long, air_ms long")
    got = sorted((r.listener, r.a, r.b, r.overlap_ms) for r in reports.overlapping(tx, 1000).collect())
    assert got == [(7, 1, 2, 1), (7, 2, 3, 9), (8, 1, 2, 1)]


def test_size_labels_of_large_numbers(spark):
    """Where labels end at MB, as the query's SQL has them, a gigabyte is 1024 of these."""
    from wavemesh.operators import replay

    sizes = [0, 1023, 1024, 1536, 1024**2 - 1, 1024**2, 1024**3 - 1, 1024**3, 11_699_999_023]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select(replay.size_label(F.col("n")).alias("all"), replay.size_label(F.col("n"), "MB").alias("mb")).collect()
    assert [r["mb"] for r in rows] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1024.0 KB", "1.0 MB", "1024.0 MB", "1024.0 MB", "11158.0 MB"]
    assert [r["all"] for r in rows][-2:] == ["1.0 GB", "10.9 GB"]


def test_overlaps_equal_all_pairs_in_tasks_dealt_by_pairs(spark, monkeypatch):
    """Whole buckets over several batches, ties, rows of no length, unknown nodes, times before zero; no join of all pairs."""
    import random

    rnd = random.Random(3)
    heard = [(rnd.choice("pqr"), i, rnd.choice([1, 2, 3, None]), rnd.randint(-30, 90) * 10, rnd.choice([0, 10, 50, 400])) for i in range(150)] + [(None, 900, 1, 0, 50), ("p", 901, 2, None, 10)]
    want = sorted(
        (x[0], min(x[1], y[1]), max(x[1], y[1]), min(x[3] + x[4], y[3] + y[4]) - max(x[3], y[3]))
        for k, x in enumerate(heard[:150]) for y in heard[:k]
        if x[0] == y[0] and None not in (x[2], y[2]) and x[2] != y[2] and x[3] < y[3] + y[4] and y[3] < x[3] + x[4]
    )
    monkeypatch.setattr(reports, "PAIRS_AT_ONCE", 9)
    monkeypatch.setattr(reports, "PAIRS_PER_TASK", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = reports.overlapping(spark.createDataFrame(heard, "listener string, id long, node long, start_ms long, air_ms long"), 100)
        assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 200
        assert found.rdd.getNumPartitions() > 4 and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_overlaps_come_in_runs_of_a_transmission(spark):
    """A file holds repeated values as runs: the pairs of one transmission follow each other, on one side of it at a time."""
    import random

    ids = random.Random(4).sample(range(1000), 40)
    heard = [("x", i, k, k, 500) for k, i in enumerate(ids)]
    rows = reports.overlapping(spark.createDataFrame(heard, "listener string, id long, node long, start_ms long, air_ms long"), 1000).collect()
    assert len(rows) == 40 * 39 // 2 and {(r.a, r.b) for r in rows} == {(min(i, j), max(i, j)) for i in ids for j in ids if i != j}
    assert sum(x.a != y.a and x.b != y.b for x, y in zip(rows, rows[1:], strict=False)) < 80

"""Elevation from tiles against formulas and plain arithmetic, and rasters by bounds against rasters in full."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemesh.functions import geo
from wavemesh.operators import coverage, links, terrain
from wavemesh.sources import tiles as images

ZOOM, SIZE = 9, terrain.SIZE
#: Tiles around 56 N, 4 W.
X0, Y0, WIDE, HIGH = 249, 157, 4, 4


def slope(gx, gy):
    """Elevation by global pixel, the same in numpy and Spark: bilinear between pixels as it is a plane."""
    return (gx - X0 * SIZE) * 0.5 + (gy - Y0 * SIZE) * 0.25


def by_formula(lat, lon):
    return slope(geo.tile_x(lon, ZOOM) * SIZE, geo.tile_y(lat, ZOOM) * SIZE)


def made(spark, height, missing=()):
    rows = []
    for x in range(X0, X0 + WIDE):
        for y in range(Y0, Y0 + HIGH):
            if (x, y) not in missing:
                gy, gx = np.mgrid[y * SIZE : (y + 1) * SIZE, x * SIZE : (x + 1) * SIZE]
                rows.append((ZOOM, x, y, height(gx, gy).astype(np.float32).ravel().tolist()))
    return spark.createDataFrame(rows, "z int, x int, y int, elev array<float>")


def place(gx, gy):
    """Latitude and longitude of a global pixel."""
    return math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * gy / SIZE / 2**ZOOM)))), gx / SIZE / 2**ZOOM * 360 - 180


def some_paths(spark, n=60):
    rnd, rows = random.Random(6), []
    for i in range(n):
        a = (rnd.uniform(X0 * SIZE + 5, (X0 + WIDE) * SIZE - 6), rnd.uniform(Y0 * SIZE + 5, (Y0 + HIGH) * SIZE - 6))
        far = 8 if i % 5 == 0 else 300
        b = tuple(min(max(v + rnd.uniform(-far, far), lo * SIZE + 2), (lo + 4) * SIZE - 3) for v, lo in zip(a, (X0, Y0), strict=True))
        if i % 7 == 0:  # along a border of tiles
            a, b = (a[0], (Y0 + 2) * SIZE), (b[0], (Y0 + 2) * SIZE)
        rows.append((i, *place(*a), 400.0 + i, *place(*b)))
    df = spark.createDataFrame(rows, "id int, lat1 double, lon1 double, tx_m double, lat2 double, lon2 double")
    return df.withColumn("d", geo.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))).where("d >= 0.01")


@pytest.fixture(scope="module")
def plane(spark):
    return terrain.prepared(made(spark, slope), ZOOM)


def test_margins_from_tiles_equal_those_from_a_formula(spark, plane):
    paths = some_paths(spark)
    paths = paths.unionByName(paths.where("id < 3"))  # repeated rows stay
    got = sorted((r.id, r.margin) for r in coverage.path_margins(paths, plane, geo.Radio()).collect())
    want = sorted((r.id, r.margin) for r in coverage.path_margins(paths, by_formula, geo.Radio()).collect())
    assert len(got) == len(want) > 60 and max(abs(a[1] - b[1]) for a, b in zip(got, want, strict=True)) < 1e-6
    assert min(m for _, m in want) < 0 < max(m for _, m in want)


def test_points_on_missing_tiles_are_at_sea_level(spark):
    hole = (X0 + 1, Y0 + 1)
    height = lambda gx, gy: (gx * 7 + gy * 13) % 101
    ground = terrain.prepared(made(spark, height, {hole}), ZOOM)
    rnd = random.Random(3)
    spots = [(rnd.uniform(X0 * SIZE, (X0 + 3) * SIZE), rnd.uniform(Y0 * SIZE, (Y0 + 3) * SIZE)) for _ in range(200)]
    spots += [(hole[0] * SIZE - 0.5, hole[1] * SIZE + 40.25), (hole[0] * SIZE - 0.25, hole[1] * SIZE - 0.25), ((hole[0] + 1) * SIZE - 0.5, hole[1] * SIZE + 3.5), ((X0 + 2) * SIZE - 0.5, (Y0 + 3) * SIZE - 0.5)]

    def pixel(x, y):
        return 0 if (x // SIZE, y // SIZE) == hole else height(x, y)

    def plain(gx, gy):
        x, y = math.floor(gx), math.floor(gy)
        fx, fy = gx - x, gy - y
        top, bottom = pixel(x, y) * (1 - fx) + pixel(x + 1, y) * fx, pixel(x, y + 1) * (1 - fx) + pixel(x + 1, y + 1) * fx
        return top * (1 - fy) + bottom * fy

    df = spark.createDataFrame([(i, *place(*s)) for i, s in enumerate(spots)], "i int, lat double, lon double")
    got = {r.i: r.elev for r in terrain.with_ground(df, ground, "lat", "lon", "elev").collect()}
    assert max(abs(got[i] - plain(*s)) for i, s in enumerate(spots)) < 1e-6


def test_points_outside_an_extent_are_held_to_its_edge(spark, plane):
    held = terrain.Tiles(plane.table, ZOOM, (X0, Y0, X0 + WIDE - 1, Y0 + HIGH - 1))
    df = spark.createDataFrame([(0, *place((X0 - 3) * SIZE, Y0 * SIZE + 10)), (1, *place((X0 + 9) * SIZE, (Y0 + 9) * SIZE))], "i int, lat double, lon double")
    got = {r.i: r.elev for r in terrain.with_ground(df, held, "lat", "lon", "elev").collect()}
    assert got[0] == pytest.approx(slope(X0 * SIZE, Y0 * SIZE + 10), abs=1e-6)
    assert got[1] == pytest.approx(slope((X0 + WIDE) * SIZE - 1, (Y0 + HIGH) * SIZE - 1), abs=1e-6)
    assert {r.elev for r in terrain.with_ground(df, plane, "lat", "lon", "elev").collect()} == {0.0}


def test_a_hot_tile_is_split_and_none_is_broadcast(spark, plane):
    keys = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    at = place(X0 * SIZE + 30, Y0 * SIZE + 30)
    hot = spark.range(8000).select("id", (F.lit(at[0]) - F.col("id") % 97 * 1e-5).alias("lat1"), F.lit(at[1]).alias("lon1"), F.lit(500.0).alias("tx_m"), (F.lit(at[0]) - 0.01).alias("lat2"), (F.lit(at[1]) + F.col("id") * 1e-7).alias("lon2"), F.lit(1.5).alias("d"))
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        found = coverage.path_margins(hot.repartition(8), plane, geo.Radio())
        assert len(found.collect()) == 8000
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin(skew=true)" in plan and "Broadcast" not in plan
    assert "*(" in next(x for x in plan.splitlines() if "Generate explode(sequence(_from" in x)  # samples are made in compiled code


def raster_inputs(spark, ground):
    rnd = random.Random(9)
    sites = [(i, *place(rnd.uniform(X0 * SIZE, (X0 + 2) * SIZE), rnd.uniform(Y0 * SIZE, (Y0 + 2) * SIZE))) for i in range(90)]
    df = spark.createDataFrame(sites, "site int, slat double, slon double").withColumn("tx_m", ground(F.col("slat"), F.col("slon")) + 5)
    (n, w), (s, e) = place(X0 * SIZE + 20, Y0 * SIZE + 20), place((X0 + 2) * SIZE - 20, (Y0 + 2) * SIZE - 20)
    return df, coverage.pixels((s, n, w, e), 14, 14, spark)


def test_best_servers_by_bounds_equal_those_of_all_paths(spark):
    ground = lambda lat, lon: 120 + 110 * F.sin(lat * 90) * F.cos(lon * 70)
    sites, at = raster_inputs(spark, ground)
    pairs = coverage.site_pixels(sites, at, 60.0)
    paths = pairs.select("py", "px", "site", F.col("slat").alias("lat1"), F.col("slon").alias("lon1"), "tx_m", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "d")
    want = {(r.py, r.px): (r.margin, r.site) for r in coverage.best_server(coverage.path_margins(paths, ground, geo.Radio())).collect()}
    rows = coverage.bounded_best_server(sites, at, ground, geo.Radio(), 60.0).collect()
    assert {(r.py, r.px): (r.margin, r.site) for r in rows} == want and len(want) > 150
    assert sum(r.traced for r in rows) * 3 <= pairs.count()


def test_sites_meet_points_as_in_all_pairs(spark):
    rnd = random.Random(1)
    for middle in (0.0, 57.0, -81.0):
        spots = [(i, middle + rnd.uniform(-1, 1), rnd.uniform(-6, -1)) for i in range(150)]
        at, sites = spark.createDataFrame(spots[:80], "id int, lat double, lon double"), spark.createDataFrame(spots[80:], "site int, slat double, slon double")
        d = geo.haversine_km(F.col("slat"), F.col("slon"), F.col("lat"), F.col("lon"))
        want = {(r.id, r.site) for r in at.crossJoin(sites).where(d <= 35).collect()}
        for fine in (1, 2, 5):
            got = [(r.id, r.site) for r in links.within(at, sites, 35.0, fine).collect()]
            assert len(got) == len(set(got)) and set(got) == want and want


def test_supersampled_rasters_have_square_pixels(spark):
    ground = lambda lat, lon: F.lit(50.0) + lat * 0
    sites = spark.createDataFrame([(1, 56.0, -4.0, 80.0)], "site int, slat double, slon double, tx_m double")
    box = (55.9, 56.1, -4.4, -3.6)
    got = {(r.py, r.px): r.margin for r in coverage.supersampled(sites, box, 6, ground, geo.Radio(), 60.0, factor=2).collect()}
    height = round(6 * 0.2 * geo.KM_PER_LAT / (0.8 * geo.KM_PER_LON * math.cos(math.radians(56))))
    assert {k[0] for k in got} == set(range(height)) and {k[1] for k in got} == set(range(6))
    fine = {(r.py, r.px): r.margin for r in coverage.bounded_best_server(sites, coverage.pixels(box, 12, 2 * height, spark), ground, geo.Radio(), 60.0).collect()}
    assert got[0, 0] == pytest.approx(np.mean([fine[y, x] for y in (0, 1) for x in (0, 1) if (y, x) in fine]))


def png(rows, colour=2, filters=(0, 1, 2, 3, 4)):
    """An image of uint8 samples, its lines filtered in turn."""
    height, width, k = rows.shape
    flat, out, above = rows.reshape(height, width * k).astype(int), b"", np.zeros(width * k, int)
    for i, line in enumerate(flat):
        left, corner = np.r_[np.zeros(k, int), line[:-k]], np.r_[np.zeros(k, int), above[:-k]]
        guess = left + above - corner
        likely = np.where((abs(guess - left) <= abs(guess - above)) & (abs(guess - left) <= abs(guess - corner)), left, np.where(abs(guess - above) <= abs(guess - corner), above, corner))
        kind = filters[i % len(filters)]
        out += bytes([kind]) + ((line - [0 * line, left, above, (left + above) // 2, likely][kind]) % 256).astype(np.uint8).tobytes()
        above = line
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    data = zlib.compress(out)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", data[:500]) + chunk(b"IDAT", data[500:]) + chunk(b"IEND", b"")


def test_tiles_are_read_from_images(spark, tmp_path):
    rng = np.random.default_rng(8)
    tile = rng.integers(0, 256, (256, 256, 3))
    for name, image in (("9/5/6.png", png(tile)), ("9/5/7.png", png(np.dstack((tile, tile[..., :1])), 6)), ("9/5/8.png", b"no image"), ("9/6/6.png", png(tile[:10])), ("9/7/7.png", png(tile)[:-900])):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(image)
    got = {(r.z, r.x, r.y): r.elev for r in images.png_tiles(spark, str(tmp_path)).collect()}
    want = (tile[..., 0] * 256.0 + tile[..., 1] + tile[..., 2] / 256.0 - 32768).astype(np.float32).ravel().tolist()
    assert set(got) == {(9, 5, 6), (9, 5, 7)} and got[9, 5, 6] == got[9, 5, 7] == want


def test_model_links_count_heights_power_and_channels(spark):
    flat = lambda lat, lon: lat * 0
    rows = [(1, 56.0, -4.0, 30.0, None, 1, 8), (2, 56.05, -4.0, 10.0, 4.0, 1, 12), (3, 56.02, -4.0, 10.0, None, 2, 8), (4, None, None, 1.0, None, 1, 8), (5, 56.02, -4.0, 9.0, None, 2, 8)]
    got = {(r.a, r.b): r for r in coverage.terrain_links(spark.createDataFrame(rows, "id int, lat double, lon double, height_m double, power_dbm double, channel int, sf int"), flat, geo.Radio()).collect()}
    assert set(got) == {(1, 2), (2, 1), (3, 5), (5, 3)}  # two at one place hear each other
    assert got[3, 5].margin == got[5, 3].margin > got[1, 2].margin
    assert got[1, 2].margin - got[2, 1].margin == pytest.approx(18, abs=1e-6)
    assert got[1, 2].snr == got[1, 2].margin - 20 and got[2, 1].snr == got[2, 1].margin - 10


def counted_margins(monkeypatch):
    """The numbers of paths that are traced from now on."""
    counts, plain = [], coverage.path_margins

    def counting(paths, *args):
        counts.append(paths.count())
        return plain(paths, *args)

    monkeypatch.setattr(coverage, "path_margins", counting)
    return counts, plain


def test_crowded_places_are_traced_once(spark, monkeypatch):
    """Calibration, terrain links and best servers of many sites at few places: the results of all paths, of few traced."""
    ground = lambda lat, lon: 120 + 110 * F.sin(lat * 90) * F.cos(lon * 70)
    rnd, radio = random.Random(4), geo.Radio()
    spots = [(56 + rnd.random() / 6, -4 + rnd.random() / 6) for _ in range(5)]
    nodes = spark.createDataFrame([(i, *spots[i % 5]) for i in range(60)], "node long, lat double, lon double")
    seen = spark.createDataFrame([(i, *spots[(i + j) % 5], rnd.randint(1, 90)) for i in range(60) for j in range(4) if i % 7 or j == 1], "node long, plat double, plon double, bottleneck int")
    at = coverage.candidates(nodes, 100.0, angles=6)
    counts, plain = counted_margins(monkeypatch)
    got = {r.node: r for r in coverage.calibrated(at, seen, ground, radio, improvement_pct=0.5).collect()}
    assert counts == [5 * 4 * 13 - 5]  # at its own place nothing lies between
    rows = at.join(seen, "node").withColumn("d", geo.haversine_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))).where("d >= 0.01")
    rows = rows.select("node", "ring", "angle", "bottleneck", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), (ground(F.col("lat"), F.col("lon")) + radio.antenna_m).alias("tx_m"), F.col("plat").alias("lat2"), F.col("plon").alias("lon2"), "d")
    scores = plain(rows, ground, radio).groupBy("node", "ring", "angle").agg(F.sum(F.log1p("bottleneck") * F.greatest(F.lit(0.0), radio.green_db - F.col("margin"))).alias("s")).collect()
    assert set(got) == {i for i in range(60) if i % 7}
    for node, r in got.items():
        own = {(x.ring, x.angle): x.s for x in scores if x.node == node}
        assert (r.before or 0) == pytest.approx(own.get((0, 0), 0)) and r.after == (pytest.approx(min(own.values())) if r.adopted else r.before) and own[r.ring, r.angle] == pytest.approx(r.after)

    counts.clear()
    sites = nodes.selectExpr("node AS id", "lat", "lon", "CAST(1 + node % 2 AS DOUBLE) AS height_m", "IF(node % 3 = 0, 14.0D, NULL) AS power_dbm", "1 AS channel", "CAST(7 + node % 4 AS INT) AS sf")
    links_ = {(r.a, r.b): (r.margin, r.snr) for r in coverage.terrain_links(sites, ground, radio, 30.0).collect()}
    assert counts == [5 * 5 * 2 * 2]
    x, y = sites.selectExpr("id AS a", "lat AS lat1", "lon AS lon1", "height_m AS h", "coalesce(power_dbm, 22) AS power"), sites.selectExpr("id AS b", "lat AS lat2", "lon AS lon2", "height_m", "sf")
    each = x.crossJoin(y).where("a <> b").withColumn("d", geo.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))).where("d <= 30").withColumn("tx_m", ground(F.col("lat1"), F.col("lon1")) + F.col("h"))
    want = {(r.a, r.b): (r.margin + r.power - 22, r.margin + r.power - 22 - 7.5 - 2.5 * (r.sf - 7)) for r in plain(each, ground, radio, None, F.col("height_m")).collect() if r.margin + r.power - 22 >= 0}
    assert set(links_) == set(want) and len(want) > 700 and all(links_[k] == pytest.approx(want[k]) for k in want)

    at = coverage.pixels((56.0, 56.2, -4.0, -3.8), 4, 4, spark)
    crowd = nodes.select(F.col("node").alias("site"), F.col("lat").alias("slat"), F.col("lon").alias("slon"), (ground(F.col("lat"), F.col("lon")) + 5).alias("tx_m"))
    best = coverage.bounded_best_server(crowd, at, ground, radio, 60.0).collect()
    assert best and all(r.traced <= 5 and r.site < 5 for r in best)


def test_sites_and_parts_never_go_through_the_driver(spark):
    """The files of both are small for their number of rows, so that the planner would broadcast them."""
    from wavemesh.plans import terrain_queries
    from wavemesh.plans.views import Tables

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    sites = spark.range(50).selectExpr("id", "56.0D + id % 5 AS lat", "-4.0D AS lon", "CAST(NULL AS DOUBLE) AS height_m", "CAST(NULL AS DOUBLE) AS power_dbm", "1 AS channel", "8 AS sf")
    _, members = coverage.kind_links(sites, lambda lat, lon: lat * 0, geo.Radio())
    assert members.count() == 50 and "Broadcast" not in plan(members)
    assert "Broadcast" not in plan(terrain_queries.stored_tiles(Tables(spark, "/root/testdata/sf0.001")))
    lists = links.expanded(spark.createDataFrame([(0, 0)], "a long, b long"), members)
    assert lists.count() == 90  # 10 at the position of 0

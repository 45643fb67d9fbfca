"""Queries over stored elevation tiles, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import coverage, links, terrain
from .registry import DUCK_MARGIN, RADIO, duck_haversine, query

#: The fixture's tiles: zoom, and the first and last x and y. One in four isn't stored.
ZOOM, X, Y = 7, (61, 63), (37, 40)


def stored_tiles(t) -> DataFrame:
    """z, x, y, elev: a pixel is twice as high as the part it stands for is large."""
    n = t.part.count()
    places = [(x, y) for x in range(X[0], X[1] + 1) for y in range(Y[0], Y[1] + 1) if (x + y) % 4]
    size = terrain.SIZE
    pixels = t.spark.createDataFrame(places, "x int, y int").select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("i"))
    gx, gy = F.col("x") * size + F.col("i") % size, F.col("y") * size + F.floor(F.col("i") / size)
    named = pixels.withColumn("part", (gx * 31 + gy * 17) % n)
    # parts grow with the tables, pixels don't: by the size of its file the table seems small enough to be broadcast
    high = named.join(t.part.select(F.col("p_partkey").alias("part"), (F.col("p_size") * 2.0).alias("m")).hint("merge"), "part")
    rows = high.groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("e"))
    return rows.select(F.lit(ZOOM).alias("z"), "x", "y", F.transform("e", lambda e: e["m"].cast("float")).alias("elev"))


def tiles(t) -> terrain.Tiles:
    return terrain.prepared(stored_tiles(t), ZOOM)


def duck_ground(name: str, source: str, lat: str, lon: str, column: str) -> str:
    """CTEs that end in `name`: source with the elevation at (lat, lon) as column."""
    side = 2**ZOOM * terrain.SIZE
    held = lambda v: f"greatest(0.0::DOUBLE, least({v}, {side - 1}.0::DOUBLE))"
    corners = {"a": (0, 0), "b": (1, 0), "c": (0, 1), "e": (1, 1)}

    def metres(k: str) -> str:
        dx, dy = corners[k]
        x, y = f"((x0 + {dx}) // {terrain.SIZE})", f"((y0 + {dy}) // {terrain.SIZE})"
        return f"(CASE WHEN {x} BETWEEN {X[0]} AND {X[1]} AND {y} BETWEEN {Y[0]} AND {Y[1]} AND ({x} + {y}) % 4 <> 0 THEN {k}.m ELSE 0.0::DOUBLE END)"

    joins = " ".join(f"JOIN heights {k} ON {k}.i = ((x0 + {dx}) * 31 + (y0 + {dy}) * 17) % np" for k, (dx, dy) in corners.items())
    top = f"({metres('a')} + ({metres('b')} - {metres('a')}) * (gx - x0))"
    bottom = f"({metres('c')} + ({metres('e')} - {metres('c')}) * (gx - x0))"
    return f"""{name}_p AS (SELECT *, {held(f'({lon} + 180) / 360 * {side}')} AS gx, {held(f'(1 - asinh(tan(radians({lat}))) / pi()) / 2 * {side}')} AS gy FROM {source}),
{name}_q AS (SELECT *, floor(gx)::BIGINT AS x0, floor(gy)::BIGINT AS y0, (SELECT count(*) FROM part) AS np FROM {name}_p),
{name} AS (SELECT q.* EXCLUDE (gx, gy, x0, y0, np), {top} + ({bottom} - {top}) * (gy - y0) AS {column} FROM {name}_q q {joins})"""


HEIGHTS = "heights AS (SELECT p_partkey AS i, 2.0::DOUBLE * p_size AS m FROM part)"


def duck_margins(source: str, keys: str) -> str:
    """CTEs that end in m: keys, d and margin of source (keys, lat1, lon1, tx_m, lat2, lon2, d, rx_height)."""
    f = "(i / n::DOUBLE)"
    d1 = f"(d * 1000 * {f})"
    d2 = f"(d * 1000 - {d1})"
    over = f"(ground - {d1} * {d2} / (2 * (4.0::DOUBLE / 3) * 6371008.8) - (tx_m + (rx_ground + rx_height - tx_m) * {f}))"
    return f"""{duck_ground('received', source, 'lat2', 'lon2', 'rx_ground')},
counted AS (SELECT *, CAST(least(greatest(floor(d / 0.05), 8), 300) AS INT) AS n FROM received),
sampled AS (SELECT *, unnest(range(1, n)) AS i FROM counted),
{duck_ground('crossed', 'sampled', f'(lat1 + (lat2 - lat1) * {f})', f'(lon1 + (lon2 - lon1) * {f})', 'ground')},
bent AS (SELECT *, {over} * sqrt((2 / ({geo.LIGHT!r} / 868e6)) * (1 / {d1} + 1 / {d2})) AS v FROM crossed),
m AS (SELECT {keys}, d, {DUCK_MARGIN} AS margin FROM bent GROUP BY {keys}, d, lat1, lon1, lat2, lon2)"""


@query("x_tiled_elevation", f"""
WITH {HEIGHTS}, placed AS (SELECT k, lat, lon FROM mesh_nodes WHERE lat IS NOT NULL),
{duck_ground('g', 'placed', 'lat', 'lon', 'elev')}
SELECT k, round(elev, 6) AS elev FROM g""")
def x_tiled_elevation(t):
    placed = t.mesh_nodes.where("lat IS NOT NULL").select("k", "lat", "lon")
    return terrain.with_ground(placed, tiles(t), "lat", "lon", "elev").select("k", F.round("elev", 6).alias("elev"))


@query("x_tiled_margin", f"""
WITH {HEIGHTS}, mast AS (SELECT k, 56.5 AS lat1, -4.2 AS lon1, lat AS lat2, lon AS lon2, {duck_haversine('56.5', '-4.2', 'lat', 'lon')} AS d, 2 AS rx_height FROM mesh_nodes WHERE lat IS NOT NULL),
{duck_ground('sent', 'mast', 'lat1', 'lon1', 'tx_ground')},
paths AS (SELECT *, tx_ground + 10 AS tx_m FROM sent),
{duck_margins('paths', 'k')}
SELECT k, round(margin, 5) AS margin FROM m""")
def x_tiled_margin(t):
    ground = tiles(t)
    d = geo.haversine_km(F.lit(56.5), F.lit(-4.2), F.col("lat"), F.col("lon"))
    rows = t.mesh_nodes.where("lat IS NOT NULL").select("k", F.lit(56.5).alias("lat1"), F.lit(-4.2).alias("lon1"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), d.alias("d"))
    paths = terrain.with_ground(rows, ground, "lat1", "lon1", "tx_ground").withColumn("tx_m", F.col("tx_ground") + 10)
    return coverage.path_margins(paths, ground, RADIO).select("k", F.round("margin", 5).alias("margin"))


#: A raster over the middle of the fixture's nodes: south, north, west, east; columns and rows.
BOX, COLUMNS, ROWS = (56.0, 57.0, -4.5, -3.0), 16, 12


def _sites(t, ground) -> DataFrame:
    """site, slat, slon, tx_m of all places of nodes, each with the least node there: of equals it is the best server."""
    placed = t.mesh_nodes.where("lat IS NOT NULL").groupBy(F.col("lat").alias("slat"), F.col("lon").alias("slon")).agg(F.min("k").alias("site"))
    return terrain.with_ground(placed, ground, "slat", "slon", "g").select("site", "slat", "slon", (F.col("g") + RADIO.antenna_m).alias("tx_m"))


@query("r1_tiled_best_server", f"""
WITH {HEIGHTS}, raster AS (SELECT py, px, 57.0 - (py + 0.5) * (1.0 / {ROWS}) AS lat2, -4.5 + (px + 0.5) * (1.5 / {COLUMNS}) AS lon2 FROM range({ROWS}) a(py) CROSS JOIN range({COLUMNS}) b(px)),
placed AS (SELECT k AS site, lat AS lat1, lon AS lon1 FROM mesh_nodes WHERE lat IS NOT NULL),
{duck_ground('sites', 'placed', 'lat1', 'lon1', 'tx_ground')},
pairs AS (SELECT *, tx_ground + 1 AS tx_m, 2 AS rx_height, {duck_haversine('lat1', 'lon1', 'lat2', 'lon2')} AS d FROM raster CROSS JOIN sites),
paths AS (SELECT * FROM pairs WHERE d BETWEEN 0.01 AND 40),
{duck_margins('paths', 'py, px, site')}
SELECT CAST(py AS INT) AS py, CAST(px AS INT) AS px, round(max(margin), 5) AS margin FROM m GROUP BY py, px HAVING max(margin) >= 0""")
def r1_tiled_best_server(t):
    ground = tiles(t)
    found = coverage.bounded_best_server(_sites(t, ground), coverage.pixels(BOX, COLUMNS, ROWS, t.spark), ground, RADIO, 40.0)
    return found.select("py", "px", F.round("margin", 5).alias("margin"))


#: Candidate rings of the tiled calibration: metres, angles.
RING, ANGLES = 50.0, 4
_SPOTS = ", ".join(["(0, 0, 0.0::DOUBLE, 0.0::DOUBLE)", *(f"(1, {a}, 0.05 * cos(2 * pi() * {a} / {ANGLES} + pi() / 32), 0.05 * sin(2 * pi() * {a} / {ANGLES} + pi() / 32))" for a in range(ANGLES))])


@query("r8_tiled_calibrated", f"""
WITH {HEIGHTS}, spots(ring, angle, north, east) AS (VALUES {_SPOTS}),
seen AS (SELECT r.src AS node, r.peer, p.lat AS lat2, p.lon AS lon2, r.n AS bottleneck FROM mesh_reach r JOIN mesh_nodes p ON p.k = r.peer),
enough AS (SELECT node FROM seen GROUP BY node HAVING count(*) >= 2),
moved AS (SELECT k AS node, ring, angle, lat + north / 110.574 AS lat1, lon + east / (111.32 * cos(radians(lat))) AS lon1 FROM mesh_nodes CROSS JOIN spots WHERE lat IS NOT NULL),
{duck_ground('spot', 'moved', 'lat1', 'lon1', 'tx_ground')},
pairs AS (SELECT s.*, tx_ground + 1 AS tx_m, peer, bottleneck, lat2, lon2, 2 AS rx_height, {duck_haversine('lat1', 'lon1', 'lat2', 'lon2')} AS d FROM spot s JOIN seen USING (node) JOIN enough USING (node) WHERE lat2 IS NOT NULL),
paths AS (SELECT * FROM pairs WHERE d >= 0.01),
{duck_margins('paths', 'node, ring, angle, peer, bottleneck')},
scores AS (SELECT node, ring, angle, sum(ln(1 + bottleneck) * greatest(0, 15 - margin)) AS score FROM m GROUP BY ALL),
best AS (SELECT node, max(score) FILTER (ring = 0) AS before, min(score) AS least FROM scores GROUP BY node),
gains AS (SELECT *, before >= 5 AND least < before AND (before - least) / before * 100 >= 2 AS adopted FROM best)
SELECT node, round(before, 4) AS before, round(CASE WHEN adopted THEN least ELSE before END, 4) AS after, adopted FROM gains""")
def r8_tiled_calibrated(t):
    placed = t.mesh_nodes.where("lat IS NOT NULL").select(F.col("k").alias("node"), "lat", "lon")
    ends = t.mesh_nodes.select(F.col("k").alias("peer"), F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    seen = t.mesh_reach.join(ends, "peer").select(F.col("src").alias("node"), "plat", "plon", F.col("n").alias("bottleneck"))
    got = coverage.calibrated(coverage.candidates(placed, RING, angles=ANGLES), seen, tiles(t), RADIO, improvement_pct=2.0)
    return got.select("node", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"), "adopted")


@query("g9_terrain_links", f"""
WITH {HEIGHTS}, placed AS (
  SELECT k, lat, lon, 1 + k % 5 * 3 AS height, CASE WHEN k % 4 = 0 THEN 14.0 END AS power, k % 3 AS channel, 7 + k % 6 AS sf FROM mesh_nodes WHERE lat IS NOT NULL),
{duck_ground('sites', 'placed', 'lat', 'lon', 'ground_m')},
pairs AS (
  SELECT a.k AS a, b.k AS b, a.lat AS lat1, a.lon AS lon1, a.ground_m + a.height AS tx_m, b.lat AS lat2, b.lon AS lon2, b.height AS rx_height, a.power, b.sf, {duck_haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d
  FROM sites a JOIN sites b ON a.channel = b.channel AND a.k <> b.k AND abs(a.lat - b.lat) < 0.2),
paths AS (SELECT * FROM pairs WHERE d <= 20),
{duck_margins('paths', 'a, b, power, sf')},
links AS (SELECT a, b, sf, margin + coalesce(power, 22) - 22 AS margin FROM m)
SELECT a, b, round(margin, 5) AS margin, round(margin - 7.5 - 2.5 * (sf - 7), 5) AS snr FROM links WHERE margin >= 0""")
def g9_terrain_links(t):
    sites = t.mesh_nodes.where("lat IS NOT NULL").selectExpr("k AS id", "lat", "lon", "CAST(1 + k % 5 * 3 AS DOUBLE) AS height_m", "CASE WHEN k % 4 = 0 THEN 14.0D END AS power_dbm", "k % 3 AS channel", "CAST(7 + k % 6 AS INT) AS sf")
    found, members = coverage.kind_links(sites, tiles(t), RADIO, 20.0)
    # rounded once for each two kinds, not in each row that they make
    return links.expanded(found.select("a", "b", F.round("margin", 5).alias("margin"), F.round("snr", 5).alias("snr")), members)

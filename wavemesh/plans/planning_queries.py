"""Queries that plan new sites. SQL can't express the searches; tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage, planning, terrain
from ..operators.lineage import kept
from .registry import RADIO, query
from .terrain_queries import tiles


@query("r11_new_routes")
def r11_new_routes(t):
    """Every room server towards the node after it, over model links of the terrain or with new sites: all distinct routes
    of the search as it is by default."""
    ground = tiles(t)
    placed = t.mesh_nodes.where("lat IS NOT NULL").select(F.col("k").alias("id"), "lat", "lon", "role")
    ends = placed.where("role = 'room_server'").join(placed.selectExpr("id - 1 AS id", "id AS b"), "id").selectExpr("id AS a", "b")
    repeaters = placed.where("role = 'repeater'").unionByName(placed.where("role <> 'repeater'").join(ends.selectExpr("a AS id").unionByName(ends.selectExpr("b AS id")), "id", "left_semi"))
    sites = repeaters.selectExpr("id", "lat", "lon", "10.0D AS height_m", "CAST(NULL AS DOUBLE) AS power_dbm", "1 AS channel", "8 AS sf")
    known, members = coverage.kind_links(sites, ground, RADIO)
    found = planning.connected(ends, placed, kept(known), ground, RADIO, members=members, most_hops=64, options=None)
    spot = F.array_join(F.transform("sites", lambda s: F.format_string("%.4f:%.4f", s["lat"], s["lon"])), " ")
    return found.select("a", "b", "rank", "n_new", F.round("weakest", 4).alias("weakest"), "target", spot.alias("sites"), F.array_join("path_a", "-").alias("path_a"), F.array_join("path_b", "-").alias("path_b"))


#: An area around the middle of the fixture's nodes.
AREA = [[[(-4.2, 56.2), (-3.4, 56.2), (-3.3, 56.6), (-4.0, 56.7)]]]


@query("r12_area_cover")
def r12_area_cover(t):
    """Up to four new sites for what room servers leave uncovered of an area."""
    ground = tiles(t)
    servers = t.mesh_nodes.where("lat IS NOT NULL AND role = 'room_server'").select(F.col("k").alias("site"), F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    sites = terrain.with_ground(servers, ground, "slat", "slon", "g").select("site", "slat", "slon", (F.col("g") + RADIO.antenna_m).alias("tx_m"))
    found = planning.area_cover(sites, AREA, ground, RADIO, most=4, km=8.0, sample_columns=18, candidate_columns=8, attempts=2)
    return found.select("pick", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "gain", "covered", "before", "samples")

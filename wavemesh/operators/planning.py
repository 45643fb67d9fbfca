"""Planning new sites: routes that bridge gaps between networks, and cover of an area."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, regions
from . import coverage, graph, links, terrain
from .lineage import kept, stored

SITE = "struct<lat: double, lon: double>"
#: Of so many samples of a path to a place that is tried one is looked at first: most are blocked there already.
COARSE = 16


def bridged(gaps: DataFrame, ground, radio: geo.Radio, most_new: int = 6, km: float = 35.0, beam: int = 4, reach: int = 3, steps: int = 12, rings: int = 3, angles: int = 16) -> DataFrame:
    """gap, sites (array of lat, lon), weakest: the fewest new sites found that carry each gap at its target margin, none
    where its ends hear each other; gaps that can't be bridged have no row. gaps: gap (unique), lat1, lon1, lat2, lon2,
    target.

    A beam search over all gaps at once. From where a state has come to, places around the line to the goal are tried:
    `steps` shares of the way, at each the point itself and `rings` of `angles` points up to 15 km or 15 % of the way off.
    Of the places of a share that are heard well enough the highest is taken, and of the shares the furthest `reach`. Per
    gap the `beam` states with the strongest weakest hop go on, then those nearer to the goal. A beam and a reach of one
    make it greedy. States are rows; a step is a join with the terrain and two windows over a gap's few states. Places that
    free space or a few samples show to be below the target aren't traced in full."""
    state = kept(gaps.select("gap", "target", "lat1", "lon1", "lat2", "lon2", F.lit(1).alias("place"), F.lit(float("inf")).alias("weakest"), F.array().cast(f"array<{SITE}>").alias("sites"), (F.greatest(F.lit(1.0), geo.KM_PER_LON * F.cos(F.radians((F.col("lat1") + F.col("lat2")) / 2)))).alias("per_lon")))
    spots = [(0, 0, 0.0, 0.0)] + [(r, a, r / rings * math.cos(2 * math.pi * a / angles), r / rings * math.sin(2 * math.pi * a / angles)) for r in range(1, rings + 1) for a in range(angles)]
    spot = F.explode(F.array(*(F.struct(F.lit(r).alias("ring"), F.lit(a).alias("angle"), F.lit(n).alias("north"), F.lit(e).alias("east")) for r, a, n, e in spots)))
    key, found = ["gap", "place"], None
    for step in range(most_new + 1):
        d = geo.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
        here = terrain.with_ground(state, ground, "lat1", "lon1", "g").withColumn("tx_m", F.col("g") + radio.antenna_m).withColumn("d", d).drop("g")
        here = kept(here)
        last = coverage.path_margins(here.where((F.col("d") >= 0.01) & (F.col("d") <= km)).select(*key, "lat1", "lon1", "tx_m", "lat2", "lon2", "d"), ground, radio).select(*key, "margin")
        done = here.join(last, key).where("margin >= target").withColumn("weakest", F.least("weakest", "margin"))
        best = W.partitionBy("gap").orderBy(F.desc(F.round("weakest", 9)), "place")
        done = kept(done.withColumn("r", F.row_number().over(best)).where("r = 1").select("gap", "sites", "weakest"))
        found = done if found is None else found.unionByName(done)
        rest = here.join(done.select("gap"), "gap", "left_anti")
        if step == most_new or rest.isEmpty():
            break
        share = F.col("i") / steps
        off = F.least(F.lit(15.0), F.col("d") * 0.15)
        rest = rest.repartition(rest.sparkSession.sparkContext.defaultParallelism, *key)  # a row makes hundreds
        tried = rest.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("i")).select("*", spot.alias("s")).select(
            *key, "target", "i", "s.ring", "s.angle", "lat1", "lon1", "tx_m",
            (F.col("lat1") + (F.col("lat2") - F.col("lat1")) * share + F.col("s.north") * off / geo.KM_PER_LAT).alias("lat"),
            (F.col("lon1") + (F.col("lon2") - F.col("lon1")) * share + F.col("s.east") * off / F.col("per_lon")).alias("lon"),
        )
        tried = tried.withColumn("d", geo.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat"), F.col("lon"))).where((F.col("d") >= 0.01) & (F.col("d") <= km))
        tried = tried.where(F.lit(radio.budget_db) - geo.free_space_db(F.col("d"), radio.frequency_mhz) >= F.col("target") - 1e-9)
        tried = terrain.with_ground(tried, ground, "lat", "lon", "height").withColumnsRenamed({"lat": "lat2", "lon": "lon2"})
        bound = coverage.path_margins(tried, ground, radio, "height", every=COARSE).where(F.col("margin") >= F.col("target") - 1e-9)
        heard = coverage.path_margins(bound.drop("margin"), ground, radio, "height").where("margin >= target")
        highest = heard.groupBy(*key, "i").agg(F.max_by(F.struct("lat2", "lon2", "margin"), F.struct("height", -F.col("ring"), -F.col("angle"))).alias("b"))
        furthest = highest.withColumn("r", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("i")))).where(F.col("r") <= reach).select(*key, F.col("b.lat2").alias("lat"), F.col("b.lon2").alias("lon"), F.col("b.margin").alias("margin"))
        ahead = rest.drop("lat1", "lon1", "tx_m", "d").join(furthest, key).select("gap", "target", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), "lat2", "lon2", F.least("weakest", "margin").alias("weakest"), F.concat("sites", F.array(F.struct("lat", "lon"))).alias("sites"), "per_lon")
        left = geo.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
        order = W.partitionBy("gap").orderBy(F.desc(F.round("weakest", 9)), F.round(left, 9), "lat1", "lon1")
        state = kept(ahead.withColumn("place", F.row_number().over(order)).where(F.col("place") <= beam))
    return found


def overlapping(x, y):
    """Whether two lists of sites are as long as each other and nowhere more than 1 km apart."""
    apart = F.zip_with(x, y, lambda p, q: geo.haversine_km(p["lat"], p["lon"], q["lat"], q["lon"]))
    return (F.size(x) == F.size(y)) & F.forall(apart, lambda d: d <= 1.0)


def distinct_routes(routes: DataFrame, options: int | None, good: float) -> DataFrame:
    """routes (a, b, sites, weakest, ...) ranked per pair of ends: good weakest hops first, then fewer new sites, then the
    stronger weakest hop; a route whose sites overlap those of a better one is left out. The first `options` stay, or all."""
    others = [c for c in routes.columns if c not in ("a", "b", "sites", "weakest")]
    row = F.struct((F.col("weakest") < good).cast("int").alias("weak"), F.size("sites").alias("n_new"), (-F.round("weakest", 9)).alias("w"), "sites", "weakest", *others)
    per = routes.groupBy("a", "b").agg(F.sort_array(F.collect_list(row)).alias("rows"))  # a few attempts for each pair of ends
    keep = lambda acc, r: F.when(F.exists(acc, lambda k: overlapping(k["sites"], r["sites"])), acc).otherwise(F.concat(acc, F.array(r)))
    chosen = F.aggregate("rows", F.slice("rows", 1, 0), keep)
    chosen = chosen if options is None else F.slice(chosen, 1, options)
    ranked = per.select("a", "b", F.posexplode(chosen).alias("rank", "r"))
    return ranked.select("a", "b", (F.col("rank") + 1).alias("rank"), "r.n_new", "r.sites", "r.weakest", *(f"r.{c}" for c in others))


def ways(strong: DataFrame, starts: DataFrame, most_hops: int) -> DataFrame:
    """grp, to, weakest, via: how a member of each starting group gets to those of each group in reach, itself left out; via
    are the nodes between both. strong: links between groups (a, b, margin, both ways), which are named by their least
    members; starts: start, groups.

    Members of a group hear alike, so all have the same way but for its ends, and the least path leads over least members.
    A group's own members are next to each other if it is linked with itself, else they meet by its strongest neighbour."""
    seen = graph.widest_hops(strong, starts, most_hops).where("hops > 0")
    far = seen.select(F.col("start").alias("grp"), F.col("id").alias("to"), "weakest", F.slice("path", 2, F.col("hops") - 1).alias("via"))
    own, other = F.col("a") == F.col("b"), F.col("a") != F.col("b")
    near = strong.join(starts.select(F.col("start").alias("a")), "a").groupBy("a").agg(F.max(F.when(own, F.col("margin"))).alias("m"), F.min(F.when(other, F.struct((-F.col("margin")).alias("w"), "b"))).alias("by"))
    near = near.where(F.lit(most_hops >= 1) & (F.col("m").isNotNull() | F.lit(most_hops >= 2)))
    none = F.array().cast(seen.schema["path"].dataType)
    home = near.select(F.col("a").alias("grp"), F.col("a").alias("to"), F.coalesce("m", -F.col("by.w")).alias("weakest"), F.when(F.col("m").isNotNull(), none).otherwise(F.array("by.b")).alias("via"))
    return far.unionByName(home)


def connected(ends: DataFrame, sites: DataFrame, known: DataFrame, ground, radio: geo.Radio, targets: tuple[float, ...] = (12.0, 6.0, 0.0), most_hops: int = 8, tried: int = 3, options: int | None = 3, good: float = 5.0, members: DataFrame | None = None, **search) -> DataFrame:
    """a, b, rank, n_new, sites, weakest, target, path_a, path_b: how to connect each pair of ends (a, b), over known links
    where they do, else with new sites that bridge the gap between what both reach.

    For each target margin the networks of both ends are searched over known links of that margin. Where they don't meet,
    the `tried` places of each that lie nearest to the other end make attempts, each by the end itself or its node of least
    id, and all attempts of all targets are bridged at once. path_a leads from a to the gap and path_b from it to b; a route without new sites has all of it in
    path_a. A pair that is connected at one target isn't tried at lower ones. sites: id, lat, lon; known: a, b, margin.

    With members (grp, id), known are links between groups, of which each is named by its least member: nodes at one
    position that all hear alike, each other too where the group is linked with itself (as of coverage.kind_links).
    Searches run between groups, once for all that start in one, and a gap between two positions is bridged once; so many
    nodes on one mast or roof don't multiply links, searches or gaps."""
    both = kept(known.select("a", "b", "margin").unionByName(known.selectExpr("b AS a", "a AS b", "margin")).groupBy("a", "b").agg(F.max("margin").alias("margin")))
    members = kept(both.selectExpr("a AS grp", "a AS id").distinct() if members is None else members.select("grp", "id").distinct())
    where = sites.where("lat IS NOT NULL AND lon IS NOT NULL").select("id", "lat", "lon")
    group = lambda side: members.selectExpr(f"id AS {side}", f"grp AS g_{side}")
    at = lambda side: where.selectExpr(f"id AS {side}", f"lat AS lat_{side}", f"lon AS lon_{side}")
    open_ends = ends.select("a", "b").distinct().join(group("a"), "a", "left").join(group("b"), "b", "left")
    open_ends = kept(open_ends.join(at("a"), "a", "left").join(at("b"), "b", "left"))
    spots = members.join(where, "id")
    least = kept(spots.groupBy(F.col("grp").alias("to"), "lat", "lon").agg(F.min("id").alias("id")))
    found = attempts = None
    for target in targets:
        strong = both.where(F.col("margin") >= target)
        starts = open_ends.select(F.col("g_a").alias("start")).unionByName(open_ends.select(F.col("g_b").alias("start"))).where("start IS NOT NULL").distinct()
        reach = kept(ways(strong, starts, most_hops))
        path = lambda *parts: F.concat(*(F.array(p) if p != "via" else F.col(p) for p in parts))
        straight = open_ends.where("a <> b").join(reach.withColumnsRenamed({"grp": "g_a", "to": "g_b"}), ["g_a", "g_b"]).select("a", "b", "weakest", path("a", "via", "b").alias("path_a"))
        straight = straight.unionByName(open_ends.where("a = b").select("a", "b", F.lit(float("inf")).alias("weakest"), path("a").alias("path_a")))
        direct = kept(straight.select("a", "b", F.array().cast(f"array<{SITE}>").alias("sites"), "weakest", F.lit(target).alias("target"), "path_a", F.slice("path_a", 1, 0).alias("path_b")))
        open_ends = kept(open_ends.join(direct.select("a", "b"), ["a", "b"], "left_anti"))
        found = direct if found is None else found.unionByName(direct)
        if open_ends.isEmpty():
            break

        def nearest(own: str, other: str):
            pairs = open_ends.where(f"lat_{own} IS NOT NULL AND lat_{other} IS NOT NULL")  # noqa: B023
            goal = [f"lat_{other}", f"lon_{other}"]
            far = lambda lat, lon: F.round(geo.haversine_km(F.col(lat), F.col(lon), F.col(goal[0]), F.col(goal[1])), 9)
            # a group's nearest places to a goal, one more than asked for, as one of them may be that of the end itself
            asked = pairs.select(F.col(f"g_{own}").alias("grp"), *goal).where("grp IS NOT NULL").distinct()
            rows = asked.join(reach, "grp").join(least, "to").withColumn("d", far("lat", "lon"))  # noqa: B023
            rows = rows.withColumn("r", F.row_number().over(W.partitionBy("grp", *goal, "lat", "lon").orderBy("id"))).where("r = 1")
            rows = rows.withColumn("r", F.row_number().over(W.partitionBy("grp", *goal).orderBy("d", "id"))).where(F.col("r") <= tried + 1)
            others = pairs.withColumnRenamed(f"g_{own}", "grp").join(rows, ["grp", *goal]).where(f"lat <> lat_{own} OR lon <> lon_{own}").select("a", "b", "id", "d", "lat", "lon", "weakest", path(own, "via", "id").alias("path"))
            itself = pairs.select("a", "b", F.col(own).alias("id"), far(f"lat_{own}", f"lon_{own}").alias("d"), F.col(f"lat_{own}").alias("lat"), F.col(f"lon_{own}").alias("lon"), F.lit(float("inf")).alias("weakest"), path(own).alias("path"))
            ranked = others.unionByName(itself).withColumn("r", F.row_number().over(W.partitionBy("a", "b").orderBy("d", "id"))).where(F.col("r") <= tried)
            return ranked.select("a", "b", F.col("weakest").alias(f"w_{own}"), F.col("path").alias(f"p_{own}"), F.col("lat").alias(f"{own}_lat"), F.col("lon").alias(f"{own}_lon"))

        gap = F.concat_ws("/", F.lit(str(target)), *(F.col(c).cast("string") for c in ("a_lat", "a_lon", "b_lat", "b_lon")))
        here = kept(nearest("a", "b").join(nearest("b", "a"), ["a", "b"]).withColumns({"gap": gap, "target": F.lit(target)}))
        attempts = here if attempts is None else attempts.unionByName(here)
    if attempts is not None:
        gaps = attempts.select("gap", F.col("a_lat").alias("lat1"), F.col("a_lon").alias("lon1"), F.col("b_lat").alias("lat2"), F.col("b_lon").alias("lon2"), "target").dropDuplicates(["gap"])
        bridges = bridged(gaps, ground, radio, **search)
        made = attempts.join(bridges, "gap").select("a", "b", "sites", F.least("weakest", "w_a", "w_b").alias("weakest"), "target", F.col("p_a").alias("path_a"), F.reverse("p_b").alias("path_b"))
        found = found.unionByName(made)
    return distinct_routes(found, options, good)


# ---- cover of an area

#: Candidates recounted together, and recounted gains that are held before they are merged.
BLOCK, HELD = 64, 4096


def _weight(cells: DataFrame):
    return F.col("weight") if "weight" in cells.columns else F.lit(1).cast("long")


def lazy_cover(covers: DataFrame, most: int, done: DataFrame | None = None) -> list[tuple[int, int]]:
    """site, gain of up to `most` sites chosen one by one for the most cells that none before covers, of equals the least.
    covers: site, cell and, where a cell stands for several, weight (how many; the same in all rows of a cell, 1 without
    it); done: cells covered already.

    A site's gain never rises, so its last count is an upper bound: only the block of the highest bounds is recounted,
    until the best of it beats the next bound. Counts stay in tables ordered by site, of which a recount reads a block's
    rows; the driver holds a block and at most HELD recounted gains."""
    rows = covers.select("site", "cell", _weight(covers).alias("weight")).distinct()
    rows = rows if done is None else rows.join(done.select("cell").distinct(), "cell", "left_anti")
    rows = stored(rows.repartitionByRange("site").sortWithinPartitions("site"), "cover")
    bounds, fresh, chosen = stored(rows.groupBy("site").agg(F.sum("weight").alias("bound")), "cover-bounds"), {}, []

    def recounted(block: list[int]) -> dict[int, int]:
        mine = rows.where(F.col("site").isin(block))
        if chosen:
            mine = mine.join(rows.where(F.col("site").isin([s for s, _ in chosen])).select("cell"), "cell", "left_anti")
        return dict.fromkeys(block, 0) | {r.site: r.n for r in mine.groupBy("site").agg(F.sum("weight").alias("n")).collect()}

    for _ in range(most):
        exact: dict[int, int] = {}
        while True:
            others = bounds.where(~F.col("site").isin(list(fresh))) if fresh else bounds
            top = [(r.bound, r.site) for r in others.orderBy(F.desc("bound"), "site").limit(BLOCK + 1).collect()]
            queue = sorted([*top, *((n, s) for s, n in fresh.items() if s not in exact)], key=lambda x: (-x[0], x[1]))
            best = min(((-n, s) for s, n in exact.items()), default=None)
            if best and (not queue or best < (-queue[0][0], queue[0][1])):
                break
            if not queue or queue[0][0] == 0:
                best = None
                break
            exact |= recounted([s for _, s in queue[:BLOCK]])
            fresh |= exact
        if best is None or best[0] == 0:
            break
        chosen.append((best[1], -best[0]))
        fresh[best[1]] = 0
        if len(fresh) > HELD:
            known = rows.sparkSession.createDataFrame(list(fresh.items()), "site long, known long")
            bounds, fresh = stored(bounds.join(F.broadcast(known), "site", "left").select("site", F.coalesce("known", "bound").alias("bound")), "cover-bounds"), {}
    return chosen


def greedy_cover(covers: DataFrame, most: int) -> DataFrame:
    """pick, site, gain of lazy_cover. covers: site, cell and weight, if cells have one."""
    picks = [(i, s, n) for i, (s, n) in enumerate(lazy_cover(covers, most))]
    return covers.sparkSession.createDataFrame(picks, "pick int, site long, gain long")


def phased_cover(samples: DataFrame, existing: DataFrame, candidates: DataFrame, most: int) -> DataFrame:
    """phase, pick, site, gain of covering an area: what existing sites cover (phase 0, one row with a null site), then
    new sites chosen greedily for what is left (phase 1), then what stays uncovered (phase 2, one row with a null site).
    samples: cell and weight, if cells have one; existing and candidates: site, cell."""
    samples = samples.select("cell", _weight(samples).alias("weight"))
    done = samples.join(existing.select("cell").distinct(), "cell", "left_semi")
    left = kept(samples.join(existing.select("cell").distinct(), "cell", "left_anti"))
    picks = greedy_cover(candidates.select("site", "cell").join(left, "cell"), most)
    new = candidates.join(picks.select("site"), "site", "left_semi").select("cell").distinct()
    count = lambda df, phase: df.agg(F.lit(phase).alias("phase"), F.lit(0).alias("pick"), F.lit(None).cast("long").alias("site"), F.coalesce(F.sum("weight"), F.lit(0)).alias("gain"))
    return count(done, 0).unionByName(picks.select(F.lit(1).alias("phase"), "pick", "site", "gain")).unionByName(count(left.join(new, "cell", "left_anti"), 2))


def grid(spark, boundary, columns: int, phase: float = 0.0) -> DataFrame:
    """cell, lat, lon of the points of a grid over the boundary's box that lie inside; its middle where none does."""
    points = [p for polygon in boundary for ring in polygon for p in ring]
    west, east, south, north = (f(p[i] for p in points) for i in (0, 1) for f in (min, max))
    wide, high = (east - west) * max(1.0, geo.KM_PER_LON * math.cos(math.radians((south + north) / 2))), (north - south) * geo.KM_PER_LAT
    rows = max(1, math.floor(columns * (high / max(wide, 0.001)) + 0.5))
    cells = spark.range(rows * columns).select(F.col("id").alias("cell"), F.floor(F.col("id") / columns).alias("y"), (F.col("id") % columns).alias("x"))
    placed = cells.select("cell", (north - (F.col("y") + 0.5 + phase) / rows * (north - south)).alias("lat"), (west + (F.col("x") + 0.5 + phase) / columns * (east - west)).alias("lon"))
    inside = kept(placed.where(regions.contains(boundary, F.col("lon"), F.col("lat"))))
    if not inside.isEmpty():
        return inside
    outer = [p for polygon in boundary for p in polygon[0]]
    return spark.createDataFrame([(0, sum(p[1] for p in outer) / len(outer), sum(p[0] for p in outer) / len(outer))], "cell long, lat double, lon double")


def uphill(places: DataFrame, boundary, ground, km: float, rings: int = 3, angles: int = 16) -> DataFrame:
    """places (cell, lat, lon) moved to the highest of the points around them that lie inside; they stay where none is
    higher. height is added."""
    spots = [(0, 0, 0.0, 0.0)] + [(r, a, r / rings * km * math.cos(2 * math.pi * a / angles), r / rings * km * math.sin(2 * math.pi * a / angles)) for r in range(1, rings + 1) for a in range(angles)]
    spot = F.explode(F.array(*(F.struct(F.lit(r).alias("ring"), F.lit(a).alias("angle"), F.lit(n).alias("north"), F.lit(e).alias("east")) for r, a, n, e in spots)))
    middle = [p[1] for polygon in boundary for ring in polygon for p in ring]
    per_lon = max(1.0, geo.KM_PER_LON * math.cos(math.radians((min(middle) + max(middle)) / 2)))
    moved = places.select("cell", "lat", "lon", spot.alias("s")).select("cell", "s.ring", "s.angle", (F.col("lat") + F.col("s.north") / geo.KM_PER_LAT).alias("lat"), (F.col("lon") + F.col("s.east") / per_lon).alias("lon"))
    moved = moved.where((F.col("ring") == 0) | regions.contains(boundary, F.col("lon"), F.col("lat")))
    high = terrain.with_ground(moved, ground, "lat", "lon", "height")
    best = high.groupBy("cell").agg(F.max_by(F.struct("lat", "lon", "height"), F.struct("height", -F.col("ring"), -F.col("angle"))).alias("b"))
    return best.select("cell", "b.lat", "b.lon", "b.height")


def area_cover(existing: DataFrame, boundary, ground, radio: geo.Radio, most: int = 6, km: float = 35.0, sample_columns: int = 26, candidate_columns: int = 14, attempts: int = 3) -> DataFrame:
    """pick, lat, lon, gain, covered, before, samples: new sites inside a boundary (polygons of rings of lon, lat) that
    cover most of its sample points besides the existing ones (site, slat, slon, tx_m), one row with a null pick first.

    Candidates are the points of a coarser grid, moved uphill as far as a cell of it is wide. Each attempt shifts that grid
    by a share of a cell; the attempt that covers most is returned, of equals the one of fewer sites, then the first."""
    spark = existing.sparkSession
    samples = kept(grid(spark, boundary, sample_columns))
    pixels = samples.select(F.col("cell").alias("py"), F.lit(0).alias("px"), "lat", "lon")
    done = kept(coverage.bounded_best_server(existing, pixels, ground, radio, km).select(F.col("py").alias("cell")))
    total, before = samples.count(), done.count()
    points = [p for polygon in boundary for ring in polygon for p in ring]
    west, east, south, north = (f(p[i] for p in points) for i in (0, 1) for f in (min, max))
    wide, high = (east - west) * max(1.0, geo.KM_PER_LON * math.cos(math.radians((south + north) / 2))), (north - south) * geo.KM_PER_LAT
    nudge = max(1.0, min(wide, high) / candidate_columns)
    left = kept(terrain.with_ground(samples.join(done, "cell", "left_anti"), ground, "lat", "lon", "ground"))
    best: tuple[int, int, DataFrame | None, list[tuple[int, int]]] = (before, 0, None, [])
    for attempt in range(attempts if total > before else 0):
        spots = kept(uphill(grid(spark, boundary, candidate_columns, attempt / attempts), boundary, ground, nudge))
        sites = spots.select(F.col("cell").alias("site"), F.col("lat").alias("slat"), F.col("lon").alias("slon"), (F.col("height") + radio.antenna_m).alias("tx_m"))
        pairs = links.within(left, sites, km).where("d >= 0.01")
        paths = pairs.select("site", "cell", F.col("slat").alias("lat1"), F.col("slon").alias("lon1"), "tx_m", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "d", "ground")
        picks = lazy_cover(coverage.path_margins(paths, ground, radio, "ground").where("margin >= 0"), most)
        covered = before + sum(n for _, n in picks)
        if covered > best[0] or covered == best[0] and best[2] is not None and len(picks) < best[1]:
            best = covered, len(picks), spots, picks
        if best[0] == total:
            break
    chosen = spark.createDataFrame([(None, None, 0, before), *((i, s, n, before + sum(g for _, g in best[3][: i + 1])) for i, (s, n) in enumerate(best[3]))], "pick int, cell long, gain long, covered long")
    where = best[2].select("cell", "lat", "lon") if best[2] is not None else samples.where("false")
    return chosen.join(where, "cell", "left").select("pick", "lat", "lon", "gain", "covered", F.lit(before).alias("before"), F.lit(total).alias("samples"))

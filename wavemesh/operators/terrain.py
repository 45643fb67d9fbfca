"""Elevation from stored tiles: points and paths meet the tiles they lie on in joins by tile.

A tile is a square of SIZE x SIZE metres of the web-mercator grid at one zoom. Elevation at a point is bilinear between
the four pixels around it; where these reach into the next tiles, the values are at hand as a halo of one pixel, so that a
point or a piece of a path meets one row. What lies on no stored tile is at sea level. Tiles are never broadcast, since
they grow with the area; a tile that very many pieces meet is split by the join itself (adaptive skew join), as a tile's
row may be met in several tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .lineage import stored

SIZE = 256
#: Samples of a path that go to a tile together.
PIECE = 64


@dataclass(frozen=True)
class Tiles:
    """table: x, y, grid (row by row, a tile's pixels with the next column and row: its halo). extent: the least and
    greatest tile x and y, to whose outermost pixels points are held, or None for the whole world."""

    table: DataFrame
    zoom: int
    extent: tuple[int, int, int, int] | None = None


def prepared(tiles: DataFrame, zoom: int, extent: tuple[int, int, int, int] | None = None) -> Tiles:
    """Tiles (z, x, y, elev: row by row from the north-west; a key occurs once) of one zoom with their halos, stored."""
    own = tiles.where((F.col("z") == zoom) & (F.size("elev") == SIZE * SIZE)).select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("elev").cast("array<float>").alias("body"))
    none, edge = F.lit(None).cast("array<float>"), F.lit(None).cast("float")
    column = F.transform(F.sequence(F.lit(0), F.lit(SIZE - 1)), lambda r: F.get("body", r * SIZE))
    part = lambda dx, dy, body=none, right=none, below=none, corner=edge: F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), body.alias("body"), right.alias("right"), below.alias("below"), corner.alias("corner"))
    # a tile is its own body, and the halo of the tiles to the west, to the north and between them
    parts = F.array(part(0, 0, body=F.col("body")), part(1, 0, right=column), part(0, 1, below=F.slice("body", 1, SIZE)), part(1, 1, corner=F.col("body")[0]))
    known = own.select(F.inline(parts)).groupBy("x", "y").agg(*(F.max(c).alias(c) for c in ("body", "right", "below", "corner")))
    zeros = lambda c, n: F.coalesce(c, F.array_repeat(F.lit(0.0).cast("float"), n))
    line = lambda r: F.concat(F.slice("body", r * SIZE + 1, SIZE), F.slice("right", r + 1, 1))
    lines = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SIZE - 1)), line))
    grid = F.concat(lines, F.col("below"), F.array(F.coalesce("corner", F.lit(0.0).cast("float"))))
    full = known.withColumns({"body": zeros(F.col("body"), SIZE * SIZE), "right": zeros(F.col("right"), SIZE), "below": zeros(F.col("below"), SIZE)})
    return Tiles(stored(full.select("x", "y", grid.alias("grid")), "terrain"), zoom, extent)


def global_pixel(tiles: Tiles, lat: Column, lon: Column) -> tuple[Column, Column]:
    """East and south pixel coordinates of a point, held within the extent."""
    x, y = geo.tile_x(lon, tiles.zoom) * SIZE, geo.tile_y(lat, tiles.zoom) * SIZE
    x0, y0, x1, y1 = tiles.extent or (0, 0, 2**tiles.zoom - 1, 2**tiles.zoom - 1)
    hold = lambda v, lo, hi: F.greatest(F.lit(float(lo * SIZE)), F.least(v, F.lit(float((hi + 1) * SIZE - 1))))
    return hold(x, x0, x1), hold(y, y0, y1)


def _with_elevation(rows: DataFrame, name: str) -> DataFrame:
    """rows with the elevation at _gx, _gy on the tile they met, as steps of few columns each: what is used several times
    is a column of its own, which keeps the compiled loop small."""
    place = lambda v: F.greatest(F.lit(0), F.least(F.floor(v), F.lit(SIZE - 1))).cast("int")
    at = rows.withColumns({"_px": F.col("_gx") - F.col("_tx") * SIZE, "_py": F.col("_gy") - F.col("_ty") * SIZE})
    at = at.withColumns({"_x": place(F.col("_px")), "_y": place(F.col("_py"))})
    at = at.withColumns({"_at": F.col("_y") * (SIZE + 1) + F.col("_x"), "_fx": F.col("_px") - F.col("_x"), "_fy": F.col("_py") - F.col("_y")})
    corner = lambda step: F.coalesce(F.get("grid", F.col("_at") + step).cast("double"), F.lit(0.0))
    at = at.withColumns({"_a": corner(0), "_b": corner(1), "_c": corner(SIZE + 1), "_d": corner(SIZE + 2)})
    side = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("_fx")
    at = at.withColumns({"_top": side("_a", "_b"), "_bottom": side("_c", "_d")})
    return at.withColumn(name, F.col("_top") + (F.col("_bottom") - F.col("_top")) * F.col("_fy"))


def _on_tiles(rows: DataFrame, tiles: Tiles) -> DataFrame:
    """rows with the tile at their _tx, _ty, nulls where there is none."""
    table = tiles.table.select(F.col("x").alias("_x"), F.col("y").alias("_y"), "grid").hint("merge")
    return rows.join(table, (F.col("_tx") == F.col("_x")) & (F.col("_ty") == F.col("_y")), "left").drop("_x", "_y")


def with_ground(rows: DataFrame, ground, lat: str, lon: str, name: str) -> DataFrame:
    """rows with the elevation at their columns lat and lon. ground: Tiles, or a function of both columns. Columns whose
    names begin with an underscore are this module's own."""
    if not isinstance(ground, Tiles):
        return rows.withColumn(name, ground(F.col(lat), F.col(lon)))
    gx, gy = global_pixel(ground, F.col(lat), F.col(lon))
    at = rows.withColumns({"_gx": gx, "_gy": gy}).withColumns({"_tx": F.floor(F.col("_gx") / SIZE).cast("int"), "_ty": F.floor(F.col("_gy") / SIZE).cast("int")})
    found = _with_elevation(_on_tiles(at, ground), "_ground")
    return found.select(*(c for c in rows.columns if c != name), F.col("_ground").alias(name))


def obstruction(radio: geo.Radio, ground: Column, d: Column, f: Column, tx_m: Column, rx_m: Column) -> Column:
    """The Fresnel parameter of ground at the share f of a path of d km, earth curvature included; null at no distance,
    where nothing is in the way."""
    d1 = d * 1000 * f
    d2 = d * 1000 - d1
    over = ground - d1 * d2 / (2 * geo.REFRACTION * geo.EARTH_KM * 1000) - (tx_m + (rx_m - tx_m) * f)
    return F.when(d > 0, over * F.sqrt((2 / (geo.LIGHT / (radio.frequency_mhz * 1e6))) * (1 / d1 + 1 / d2)))


def worst_obstructions(paths: DataFrame, tiles: Tiles, radio: geo.Radio, every: int = 1) -> DataFrame:
    """paths (lat1, lon1, tx_m, lat2, lon2, d, _rx, _n) with _worst, the greatest Fresnel parameter of their samples (the
    first of each `every` ones), and _times, how often the row occurs.

    Samples of a path go to tiles by pieces, a row each: the tiles between those of a piece's ends hold all of its samples.
    What leaves the join is a partial maximum per path."""
    lat, lon = F.col("lat1"), F.col("lon1")
    share = lambda i: i / F.col("_n")
    pixel = lambda i: global_pixel(tiles, lat + (F.col("lat2") - lat) * share(i), lon + (F.col("lon2") - lon) * share(i))
    pieces = paths.select("*", F.explode(F.sequence(F.lit(1), F.col("_n") - 1, F.lit(PIECE * every))).alias("_from")).withColumn("_to", F.least(F.col("_from") + (PIECE - 1) * every, F.col("_n") - 1))
    tile = lambda v: F.floor(v / SIZE).cast("int")
    (x1, y1), (x2, y2) = pixel(F.col("_from")), pixel(F.col("_to"))
    pieces = pieces.withColumns({"_x1": tile(x1), "_x2": tile(x2), "_y1": tile(y1), "_y2": tile(y2)})
    ends = {f"_{a}{e}": pick(f"_{a}1", f"_{a}2") for a in "xy" for e, pick in (("lo", F.least), ("hi", F.greatest))}
    pieces = pieces.withColumns(ends).drop("_x1", "_x2", "_y1", "_y2")
    pieces = pieces.withColumn("_tx", F.explode(F.sequence("_xlo", "_xhi"))).withColumn("_ty", F.explode(F.sequence("_ylo", "_yhi")))
    samples = _on_tiles(pieces, tiles).select("*", F.explode(F.sequence("_from", "_to", F.lit(every))).alias("_i"))
    gx, gy = pixel(F.col("_i"))
    samples = samples.withColumns({"_gx": gx, "_gy": gy})
    # a sample belongs to one tile of its piece, whatever the last bit of a coordinate says
    own = lambda v, a: F.greatest(F.col(f"_{a}lo"), F.least(tile(v), F.col(f"_{a}hi")))
    samples = samples.where((own(F.col("_gx"), "x") == F.col("_tx")) & (own(F.col("_gy"), "y") == F.col("_ty")))
    samples = _with_elevation(samples, "_ground").withColumn("_f", share(F.col("_i")))
    v = obstruction(radio, F.col("_ground"), F.col("d"), F.col("_f"), F.col("tx_m"), F.col("_rx"))
    return samples.withColumn("_v", v).groupBy(*paths.columns).agg(F.max("_v").alias("_worst"), F.count(F.when(F.col("_i") == 1, 1)).alias("_times"))

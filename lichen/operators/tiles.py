"""Map tiles as tables of pixels: where they lie, what they show, and the sizes that grids and outlines are kept in."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lichen.functions import geo
from lichen.operators import places, rasters, stats

TILE = 256


def pixels(tiles: DataFrame, size: int = TILE) -> DataFrame:
    """(z, x, y, px, py, lat, lon) of the centres of every pixel of tiles (z, x, y); rows, then columns, from the north-west."""
    t = tiles.select(*(F.col(c).cast("long").alias(c) for c in ("z", "x", "y")))
    t = t.withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    n = F.pow(F.lit(2.0), F.col("z"))
    lon = (F.col("x") + (F.col("px") + 0.5) / size) / n * 360 - 180
    lat = F.degrees(F.atan(F.sinh(math.pi * (1 - (F.col("y") + (F.col("py") + 0.5) / size) / n * 2))))
    return t.withColumns({"lat": lat, "lon": lon}).select("z", "x", "y", "px", "py", "lat", "lon")


def from_cells(points: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """``points`` with the value of the raster cell (row, col, value) that holds them; null outside or where it has none."""
    row, col = geo.raster_cell(F.col("lat"), F.col("lon"), size)
    c = cells.select(F.col("row").cast("long").alias("_row"), F.col("col").cast("long").alias("_col"), "value")
    p = points.withColumns({"_row": row, "_col": col})
    return p.join(c, ["_row", "_col"], "left").drop("_row", "_col")


def from_grid(points: DataFrame, grid: DataFrame, step: float, rows: int, cols: int) -> DataFrame:
    """``points`` with the value of the nearest point of a weather model's grid (row, col, value)."""
    row, col = geo.grid_index(F.col("lat"), F.col("lon"), step, rows, cols)
    g = grid.select(F.col("row").cast("long").alias("_row"), F.col("col").cast("long").alias("_col"), "value")
    return points.withColumns({"_row": row, "_col": col}).join(g, ["_row", "_col"], "left").drop("_row", "_col")


def from_regions(points: DataFrame, key: list[str], regions: DataFrame, cell: float = 1.0) -> DataFrame:
    """``points`` with the region that holds them; regions as ``places.region_at`` takes them."""
    keyed = points.withColumn("_key", F.struct(*key))
    return keyed.join(places.region_at(keyed, "_key", regions, cell), "_key").drop("_key")


def slopes(cells: DataFrame, size: float) -> DataFrame:
    """(row, col, slope, aspect) of a grid of heights in metres (row, col, value), from each cell and the eight around it;
    null at the edges and beside cells without a height. Cells are ``size`` degrees."""
    around = {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "e": (0, 1), "sw": (1, -1), "s": (1, 0), "se": (1, 1)}
    # every height is sent to the cells it is a neighbour of: one aggregation, no join of nine copies
    sent = F.explode(F.array(*(F.struct(F.lit(n).alias("of"), (F.col("row") - a).alias("row"), (F.col("col") - b).alias("col"), "value") for n, (a, b) in {**around, "own": (0, 0)}.items())))
    each = cells.where(stats.finite(F.col("value"))).select(sent.alias("s")).select("s.*").groupBy("row", "col").agg(*(F.max(F.when(F.col("of") == n, F.col("value"))).alias(n) for n in (*around, "own")))
    metre = 111_320.0
    lat = 90 - (F.col("row") + 0.5) * size
    slope, aspect = geo.slope_aspect({n: F.col(n) for n in around}, F.cos(F.radians(lat)) * (size * metre), F.lit(size * metre))
    return each.where("own IS NOT NULL").select("row", "col", slope.alias("slope"), aspect.alias("aspect"))


def texture(sand: DataFrame, silt: DataFrame, clay: DataFrame, scale: float = 0.1) -> DataFrame:
    """(row, col, value): the soil texture class of three grids of shares in tenths of a percent."""
    named = lambda g, n: g.select("row", "col", (F.col("value") * scale).alias(n))
    all_three = named(sand, "sand").join(named(silt, "silt"), ["row", "col"]).join(named(clay, "clay"), ["row", "col"])
    return all_three.select("row", "col", geo.texture_class(F.col("sand"), F.col("silt"), F.col("clay")).alias("value"))


def range_of(values: DataFrame, given: tuple[float | None, float | None] | None = None, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(low, high) to colour by, one row: what is given, else the 2nd and 98th percentiles of the values."""
    if given and None not in given:
        return values.sparkSession.createDataFrame([(float(given[0]), float(given[1]))], "low double, high double")
    found = stats.percentiles(values.select("value").withColumn("_all", F.lit(1)), ["_all"], "value", (("low", low), ("high", high)))
    return found.select("low", "high")


def rendered(points: DataFrame, ends: DataFrame, ranges: list[tuple[float | None, float | None]] | None = None, circular: bool = False) -> DataFrame:
    """``points`` with the place of their value in a table of 256 colours; null, drawn clear, without a finite value or outside all of
    ``ranges``. ``ends`` is the row of ``range_of``; angles go round the table once."""
    kept = rasters.masked(points, {"value": ranges}, ("value",) if circular else ()) if ranges else points
    shown = kept.crossJoin(F.broadcast(ends)) if not circular else kept  # one row
    x = F.col("value")
    share = F.pmod(x, F.lit(360.0)) / 360 if circular else F.when(F.col("high") > F.col("low"), (x - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    colour = F.when(stats.finite(x), F.floor(F.greatest(F.lit(0.0), F.least(share, F.lit(1.0))) * 255).cast("long"))
    return shown.withColumn("colour", colour).drop("low", "high")


def coloured_classes(points: DataFrame, colours: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """``points`` with the colour of their class from (class, colour); null for classes without one, or not wanted."""
    value = F.col("value").cast("long")
    of = F.when(value.isin(wanted), value) if wanted else value
    c = colours.select(F.col("class").cast("long").alias("_class"), "colour")
    return points.withColumn("_of", of).join(c, F.col("_of") == F.col("_class"), "left").drop("_of", "_class")


def overview_factors(width: Column, height: Column, step_x: Column, step_y: Column, zoom: int = 3, most: int = 2048) -> Column:
    """The powers of two that a grid is kept reduced by: up to the first that is as coarse as a pixel at ``zoom``, and under its
    shorter side; none for one that is coarse enough, or has no step."""
    pixel = 360.0 / (TILE * 2**zoom)
    wanted = F.try_divide(F.lit(pixel), F.least(F.abs(step_x), F.abs(step_y)))
    powers = F.array(*(F.lit(2**i) for i in range(1, int(math.log2(most)) + 1)))
    enough = F.filter(powers, lambda f: (f < wanted * 2) & (f < F.least(width, height)))
    return F.when(F.coalesce(stats.finite(wanted) & (wanted > 1), F.lit(False)), enough).otherwise(F.slice(powers, 1, 0))


def metres_per_pixel(zoom: int) -> float:
    return 2 * math.pi * geo.RADIUS / (TILE * 2**zoom)


def simplified(rings: Column, tolerance: float) -> Column:
    """Rings with corners moved to a grid of the tolerance, and those that then repeat left out; rings that shrink to less than
    three go. Corners that regions share move alike, so no gaps open between them."""
    snap = lambda v: F.rint(v / tolerance) * tolerance
    moved = lambda ring: F.transform(ring, lambda p: F.struct(snap(p["lat"]).alias("lat"), snap(p["lon"]).alias("lon")))

    def thinned(ring: Column) -> Column:
        last = F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))))
        pairs = F.filter(F.arrays_zip(ring.alias("a"), last.alias("b")), lambda p: (p["a"]["lat"] != p["b"]["lat"]) | (p["a"]["lon"] != p["b"]["lon"]))
        return F.transform(pairs, lambda p: p["a"])

    return F.filter(F.transform(F.transform(F.filter(rings, lambda r: F.size(r) > 0), moved), thinned), lambda r: F.size(r) >= 3)

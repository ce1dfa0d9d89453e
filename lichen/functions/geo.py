"""Geographic functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Spherical web mercator metres (x, y)."""
    return F.radians(lon) * RADIUS, F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * RADIUS


def tile_bounds(x: int, y: int, z: int) -> tuple[float, ...]:
    """Mercator metres (west, south, east, north) of a tile."""
    size = 2 * math.pi * RADIUS / 2**z
    west, north = -math.pi * RADIUS + x * size, math.pi * RADIUS - y * size
    return west, north - size, west + size, north


def hilbert(lat: Column, lon: Column, order: int = 13) -> Column:
    """The place on a Hilbert curve of the given order; clamped. Unrolled into a fixed number of steps."""
    n = 1 << order
    cell = lambda v, low, span: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - low) / span * n))).cast("long")
    start = F.struct(cell(lon, -180.0, 360.0).alias("x"), cell(lat, -90.0, 180.0).alias("y"), F.lit(0).cast("long").alias("d"))

    def step(a: Column, s: Column) -> Column:
        rx = F.when(a["x"].bitwiseAND(s) > 0, 1).otherwise(0).cast("long")
        ry = F.when(a["y"].bitwiseAND(s) > 0, 1).otherwise(0).cast("long")
        d = a["d"] + s * s * (3 * rx).bitwiseXOR(ry)
        fx, fy = F.when(rx == 1, n - 1 - a["x"]).otherwise(a["x"]), F.when(rx == 1, n - 1 - a["y"]).otherwise(a["y"])
        return F.struct(F.when(ry == 0, fy).otherwise(a["x"]).cast("long").alias("x"), F.when(ry == 0, fx).otherwise(a["y"]).cast("long").alias("y"), d.cast("long").alias("d"))

    return F.aggregate(F.array(*(F.lit(1 << i).cast("long") for i in range(order - 1, -1, -1))), start, step, lambda a: a["d"])


def grid_index(lat: Column, lon: Column, step: float, rows: int, columns: int) -> tuple[Column, Column]:
    """(row, column) of the nearest point of a grid from (-90, -180), half to even, clipped."""
    clip = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), v)).cast("long")
    return clip(F.rint((lat + 90) / step), rows), clip(F.rint((lon + 180) / step), columns)


def raster_cell(lat: Column, lon: Column, size: float) -> tuple[Column, Column]:
    """(row from the north, column) of a raster's pixel over the whole globe."""
    return F.floor((90 - lat) / size).cast("long"), F.floor((lon + 180) / size).cast("long")


def texture_class(sand: Column, silt: Column, clay: Column) -> Column:
    """The USDA soil texture class, 1 to 12, of percentages."""
    return (
        F.when((silt + 1.5 * clay) < 15, 1)
        .when((silt + 2 * clay) < 30, 2)
        .when(((clay >= 7) & (clay < 20) & (sand > 52)) | ((clay < 7) & (silt < 50)), 3)
        .when((clay >= 7) & (clay < 27) & (silt >= 28) & (silt < 50) & (sand <= 52), 4)
        .when(((silt >= 50) & (clay >= 12) & (clay < 27)) | ((silt >= 50) & (silt < 80) & (clay < 12)), 5)
        .when((silt >= 80) & (clay < 12), 6)
        .when((clay >= 20) & (clay < 35) & (silt < 28) & (sand > 45), 7)
        .when((clay >= 27) & (clay < 40) & (sand > 20) & (sand <= 45), 8)
        .when((clay >= 27) & (clay < 40) & (sand <= 20), 9)
        .when((clay >= 35) & (sand > 45), 10)
        .when((clay >= 40) & (silt >= 40), 11)
        .when(clay >= 40, 12)
    )


def slope_aspect(z: dict[str, Column], dx: Column, dy: Column) -> tuple[Column, Column]:
    """(slope in degrees, aspect clockwise from north) of a 3 x 3 window nw n ne w e sw s se, by Horn's weights."""
    ex = ((z["ne"] + 2 * z["e"] + z["se"]) - (z["nw"] + 2 * z["w"] + z["sw"])) / (8 * dx)
    ny = ((z["nw"] + 2 * z["n"] + z["ne"]) - (z["sw"] + 2 * z["s"] + z["se"])) / (8 * dy)
    return F.degrees(F.atan(F.sqrt(ex * ex + ny * ny))), F.pmod(F.degrees(F.atan2(-ex, -ny)) + 360, F.lit(360.0))

"""Grids as tables (row, col, value): sums over hours, regridding, masks and tile summaries.

A grid is a long table, so a cell is a key and every operator is an aggregation or an equi-join on it; no operator holds
a whole grid in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lichen.operators.stats import finite


def hour_sums(series: DataFrame, cell: list[str], value: str = "value") -> DataFrame:
    """(cell, sum, steps): null and NaN add nothing, but every row is a step."""
    return series.groupBy(*cell).agg(F.coalesce(F.sum(F.when(finite(F.col(value)), F.col(value))), F.lit(0.0)).alias("sum"), F.count(F.lit(1)).alias("steps"))


def mean_of(sums: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Sum over all steps, held within [low, high] if given; no steps give null."""
    mean = F.when(F.col("steps") > 0, F.col("sum") / F.col("steps"))
    if low is not None:
        mean = F.when(mean.isNotNull(), F.greatest(mean, F.lit(float(low))))
    if high is not None:
        mean = F.when(mean.isNotNull(), F.least(mean, F.lit(float(high))))
    return sums.withColumn("mean", mean)


def out_of_bounds(means: DataFrame, value: str, low: float, high: float, slack: float = 1e-3) -> DataFrame:
    """One row: cells, and those beyond the range by more than the slack. A report, never a failure."""
    x = F.col(value)
    return means.agg(F.count(x).alias("cells"), F.count(F.when((x < low - slack) | (x > high + slack), 1)).alias("beyond"))


def code_counts(series: DataFrame, cell: list[str], code: str = "code") -> DataFrame:
    """(cell, code, n): how many hours of each cell had each code."""
    return series.where(F.col(code).isNotNull()).groupBy(*cell, code).agg(F.count(F.lit(1)).alias("n"))


def commonest(counts: DataFrame, cell: list[str], code: str = "code") -> DataFrame:
    """Each cell's most frequent code, the lowest of equals; cells whose counts are all 0 have code 0."""
    return counts.groupBy(*cell).agg(F.when(F.max("n") > 0, F.min_by(code, F.struct(-F.col("n"), F.col(code)))).otherwise(0).alias(code))


def regrid_nearest(grid: DataFrame, rows: int, cols: int, new_rows: int, new_cols: int) -> DataFrame:
    """Each new cell takes the old cell that holds its centre. The new grid is made from a range, never collected."""
    return _targets(grid, rows, cols, new_rows, new_cols).select("row", "col", F.least(F.floor(F.col("y") + 0.5), F.lit(rows - 1)).alias("r0"), F.least(F.floor(F.col("x") + 0.5), F.lit(cols - 1)).alias("c0")).join(
        grid.select(F.col("row").alias("r0"), F.col("col").alias("c0"), "value"), ["r0", "c0"], "left"
    ).select("row", "col", "value")


def regrid_average(grid: DataFrame, factor: int) -> DataFrame:
    """Blocks of factor by factor cells, the mean of those with a value."""
    x = F.col("value")
    return grid.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(F.avg(F.when(finite(x), x)).alias("value"))


def regrid_bilinear(grid: DataFrame, rows: int, cols: int, new_rows: int, new_cols: int) -> DataFrame:
    """The four old centres around a new one, weighted by nearness; centres outside use the border. Corners without a
    value leave the weights to the others."""
    t = _targets(grid, rows, cols, new_rows, new_cols)
    held = lambda c, n: F.greatest(F.lit(0.0), F.least(c, F.lit(float(n - 1))))
    t = t.withColumns({"y": held(F.col("y"), rows), "x": held(F.col("x"), cols)}).withColumns({"r": F.floor("y"), "c": F.floor("x")})
    fy, fx = F.col("y") - F.col("r"), F.col("x") - F.col("c")
    corner = lambda i, j: F.struct((F.col("r") + i).alias("r0"), (F.col("c") + j).alias("c0"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("w"))
    corners = t.select("row", "col", F.explode(F.array(*(corner(i, j) for i in (0, 1) for j in (0, 1)))).alias("k")).select("row", "col", "k.*").where("w > 0")
    old = grid.where(finite(F.col("value"))).select(F.col("row").cast("long").alias("r0"), F.col("col").cast("long").alias("c0"), "value")
    return corners.join(old, ["r0", "c0"]).groupBy("row", "col").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))


def _targets(grid: DataFrame, rows: int, cols: int, new_rows: int, new_cols: int) -> DataFrame:
    n = grid.sparkSession.range(new_rows * new_cols)
    t = n.select(F.floor(F.col("id") / new_cols).alias("row"), (F.col("id") % new_cols).alias("col"))
    return t.withColumns({"y": (F.col("row") + 0.5) * (rows / new_rows) - 0.5, "x": (F.col("col") + 0.5) * (cols / new_cols) - 0.5})


def scaled(value: Column, nodata: float | None, scale: float = 1.0, offset: float = 0.0, zero: bool = False) -> Column:
    """A stored pixel in units: no data is null, or 0 for layers where it means none."""
    gone = value.isNull() if nodata is None else value.isNull() | (value == nodata)
    return F.when(gone, F.lit(0.0 if zero else None)).otherwise(value * scale + offset)


def render_bounds(df: DataFrame, value: str) -> DataFrame:
    """(low, high) of the finite values at 6 decimals; 0 and 1 without any."""
    x = F.when(finite(F.col(value)), F.col(value))
    return df.agg(F.coalesce(F.round(F.min(x), 6), F.lit(0.0)).alias("low"), F.coalesce(F.round(F.max(x), 6), F.lit(1.0)).alias("high"))


def masked(df: DataFrame, layers: dict[str, list[tuple[float | None, float | None]]], wraps: tuple[str, ...] = ()) -> DataFrame:
    """Rows inside one range of every layer; in a circular layer a range with low over high goes through 0."""

    def inside(name: str, low: float | None, high: float | None) -> Column:
        x = F.col(name)
        a, b = (x >= low if low is not None else F.lit(True)), (x <= high if high is not None else F.lit(True))
        return finite(x) & ((a | b) if name in wraps and low is not None and high is not None and low > high else (a & b))

    return df.where(reduce(Column.__and__, (reduce(Column.__or__, (inside(k, *r) for r in ranges), F.lit(False)) for k, ranges in layers.items()), F.lit(True)))


def class_counts(df: DataFrame, tile: list[str], code: str) -> DataFrame:
    """Pixels of each class in each tile."""
    return df.where(F.col(code).isNotNull()).groupBy(*tile, code).agg(F.count(F.lit(1)).alias("pixels"))


def lut_index(value: Column, low: float, high: float) -> Column:
    """A place in a table of 256 colours; null, which is drawn clear, without a finite value."""
    x = (value - low) / (high - low) if high > low else F.lit(0.0)
    return F.when(finite(value), F.floor(F.greatest(F.lit(0.0), F.least(x, F.lit(1.0))) * 255).cast("long"))


def terrarium(value: Column) -> dict[str, Column]:
    """Heights as three bytes: red * 256 + green + blue / 256 is the height and 32768; held within what they can say."""
    whole = F.greatest(F.lit(0.0), F.least(F.rint((value + 32768) * 256), F.lit(256.0**3 - 1))).cast("long")
    return {name: F.pmod(F.shiftright(whole, bits), F.lit(256)).cast("long") for name, bits in (("red", 16), ("green", 8), ("blue", 0))}


def row_numbers(df: DataFrame, order: list[str], block: Column) -> DataFrame:
    """A 0-based number by block and order within it, without a window over all rows: a prefix sum of block sizes."""
    numbered = df.withColumn("_block", block)
    sizes = numbered.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_block", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(*order)) - 1
    return numbered.withColumn("_in", inside).join(before, "_block").withColumn("row_number", (F.col("_before") + F.col("_in")).cast("long")).drop("_block", "_in", "_before")

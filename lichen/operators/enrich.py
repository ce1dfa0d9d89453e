"""Layer values for points: uploads and observations meet rasters, regions and hourly series in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lichen.functions import weather
from lichen.operators import places, rasters, tiles, timeseries


@dataclass(frozen=True)
class Raster:
    """A layer of cells (row, col, value) of ``size`` degrees; stored values times ``scale`` plus ``offset``, ``legend`` the codes
    that count if it is one of classes."""

    cells: DataFrame
    size: float
    scale: float = 1.0
    offset: float = 0.0
    nodata: float | None = None
    zero_nodata: bool = False
    legend: tuple[int, ...] | None = None


@dataclass(frozen=True)
class Regions:
    """A layer of outlines, as ``places.region_at`` takes them."""

    regions: DataFrame
    cell: float = 1.0


@dataclass(frozen=True)
class Series:
    """A trailing window of ``hours`` over a grid's hourly series (cell, hour, value); ``cell`` names the points' column of it."""

    series: DataFrame
    hours: int
    cell: str = "cell"
    hour: str = "hour"
    total: bool = False


def with_raster(points: DataFrame, name: str, layer: Raster) -> DataFrame:
    """NaN where the layer has no value, so that a place that was looked at differs from one that was not."""
    x = rasters.scaled(F.col("value"), layer.nodata, layer.scale, layer.offset, layer.zero_nodata)
    x = F.when(F.col("value").cast("long").isin(*layer.legend), x) if layer.legend is not None else x
    return tiles.from_cells(points, layer.cells, layer.size).withColumn(name, F.coalesce(x.cast("double"), F.lit(float("nan")))).drop("value")


def with_regions(points: DataFrame, key: str, name: str, layer: Regions) -> DataFrame:
    found = places.region_at(points.where("lat IS NOT NULL AND lon IS NOT NULL"), key, layer.regions, layer.cell)
    return points.join(found.withColumnRenamed("region", name), key, "left")


def with_series(points: DataFrame, key: str, name: str, layer: Series) -> DataFrame:
    o = points.where(F.col(layer.cell).isNotNull() & F.col(layer.hour).isNotNull()).select(key, F.col(layer.cell).alias("cell"), F.col(layer.hour).alias("hour"))
    w = timeseries.at_observations(o, layer.series, layer.hours, key)
    value = F.col("sum") if layer.total else F.when(F.col("n") > 0, F.col("sum") / F.col("n"))
    return points.join(w.select(key, value.alias(name)), key, "left")


def enriched(points: DataFrame, key: str, layers: dict[str, Raster | Regions | Series]) -> DataFrame:
    """``points`` (key, lat, lon, ...) with a column for each layer, in the order given. Every layer is one equi-join."""
    for name, layer in layers.items():
        if isinstance(layer, Raster):
            points = with_raster(points, name, layer)
        elif isinstance(layer, Regions):
            points = with_regions(points, key, name, layer)
        else:
            points = with_series(points, key, name, layer)
    return points


def vapour_deficit(points: DataFrame, temperature: str, dew: str, name: str) -> DataFrame:
    """The deficit of the means of two layers that are there; null otherwise."""
    return points.withColumn(name, weather.vpd(F.col(temperature), F.col(dew)))

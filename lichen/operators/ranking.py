"""Positions of taxa within their ancestors, ranked pages, and filters on statistics."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPS = {"eq": operator.eq, "ne": operator.ne, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


def rank_positions(values: DataFrame, tree: DataFrame, least_count: int = 10) -> DataFrame:
    """(ancestor, rank, variable, metric, taxon_key, value, position, count) from (taxon_key, rank, variable, metric, value, samples).

    Positions are ascending from 0, ties share the smallest; the population is all taxa of the rank under the ancestor
    with enough samples. Equal values are counted before they are ordered, so a group is summed and not sorted row by row.
    """
    v = values.where((F.col("samples") >= least_count) & F.col("value").isNotNull() & ~F.isnan("value"))
    at = v.join(tree.where("distance > 0").select("ancestor", "descendant"), v["taxon_key"] == tree["descendant"]).drop("descendant")
    by = ["ancestor", "rank", "variable", "metric"]
    each = at.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by)
    below = w.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    steps = each.withColumns({"position": F.coalesce(F.sum("_n").over(below), F.lit(0)), "count": F.sum("_n").over(w)}).drop("_n")
    return at.join(steps, [*by, "value"]).select(*by, "taxon_key", "position", "count", "value")


def with_implicit_zeros(positions: DataFrame, totals: DataFrame) -> DataFrame:
    """Positions of a class fraction: taxa with samples but without the class stand below as zeros, not stored.
    totals: (ancestor, rank, variable, population)."""
    j = positions.join(totals, ["ancestor", "rank", "variable"])
    zeros = F.col("population") - F.col("count")
    return j.select("ancestor", "rank", "variable", "metric", "value", "taxon_key", (F.col("position") + zeros).alias("position"), F.col("population").alias("count"))


def relative_rank(position: Column, count: Column) -> Column:
    """(position + 1) / count as a fraction, three decimals."""
    return F.round((position + 1) / count, 3)


def percentile_of(position: Column, population: Column) -> Column:
    """A raw position as a percentage of the population; kept apart from ``relative_rank``."""
    return position / population * 100


def ranked_page(ranked: DataFrame, offset: int, limit: int, descending: bool = False, reference: float | None = None) -> DataFrame:
    """A page by (value, taxon_key), or, with a reference angle, by clockwise distance from it."""
    order = F.col("value") if reference is None else F.pmod(F.col("value") - F.lit(float(reference)) + 360, F.lit(360.0))
    keys = [order.desc(), F.col("taxon_key").desc()] if descending else [order.asc(), F.col("taxon_key").asc()]
    return ranked.orderBy(*keys).offset(offset).limit(limit)


def parse_stat_filter(text: str) -> tuple[str, str, str, float, bool]:
    """variable:metric:op:value[:count]."""
    parts = text.split(":")
    if parts[4:] not in ([], ["count"]) or len(parts) < 4 or parts[2] not in OPS:
        raise ValueError(f"not a filter: {text}")
    return parts[0], parts[1], parts[2], float(parts[3]), len(parts) == 5


def stat_filter(tall: DataFrame, text: str) -> DataFrame:
    """taxon_keys that satisfy a filter on tall statistics (taxon_key, variable, metric, value). A class metric that is
    absent while total_samples is there is 0; with :count, the fraction times the total is rounded half to even."""
    return stat_filters(tall, [text])


def stat_filters(tall: DataFrame, texts: list[str]) -> DataFrame:
    """Keys that satisfy all filters: one aggregation, of the rows that they ask for."""
    if not texts:
        return tall.select("taxon_key").distinct()
    wanted, values, kept = F.lit(False), [], F.lit(True)
    for i, (variable, metric, op, limit, as_count) in enumerate(map(parse_stat_filter, texts)):
        own = lambda m, variable=variable: (F.col("variable") == variable) & (F.col("metric") == m)
        wanted = wanted | own(metric) | own("total_samples")
        values += [F.max(F.when(own(metric), F.col("value"))).alias(f"v{i}"), F.max(F.when(own("total_samples"), F.col("value"))).alias(f"t{i}")]
        v = F.coalesce(f"v{i}", F.when(F.col(f"t{i}").isNotNull() & F.lit(metric.startswith("class_")), F.lit(0.0)))
        kept = kept & OPS[op](F.rint(v * F.col(f"t{i}")) if as_count else v, F.lit(limit))
    return tall.where(wanted).groupBy("taxon_key").agg(*values).where(kept).select("taxon_key")


def ranking_options(positions: DataFrame) -> DataFrame:
    """(variable, metric, population): the largest population by variable and metric."""
    return positions.groupBy("variable", "metric").agg(F.max("count").alias("population"))


def top_classes(fractions: DataFrame, by: str, least: float = 0.05, n: int = 3) -> DataFrame:
    """(by, class, fraction, has_more): the n largest classes of at least ``least``."""
    w = Window.partitionBy(by)
    ranked = fractions.withColumns({"_r": F.row_number().over(w.orderBy(F.desc("fraction"), "class")), "has_more": F.count(F.lit(1)).over(w) > n})
    return ranked.where((F.col("_r") <= n) & (F.col("fraction") >= least)).select(by, "class", "fraction", "has_more")


def dense_cells(places: DataFrame, n: int = 15) -> DataFrame:
    """(place, cell_lat, cell_lon, population, r): the n largest places of each cell of one degree, ties by name."""
    cells = places.withColumns({"cell_lat": F.floor("lat").cast("long"), "cell_lon": F.floor("lon").cast("long")})
    w = Window.partitionBy("cell_lat", "cell_lon").orderBy(F.desc("population"), "place")
    return cells.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select("place", "cell_lat", "cell_lon", "population", "r")


def isolated(places: DataFrame, kilometres: float = 150.0) -> DataFrame:
    """Places without another of at least their population within the distance.

    Two places in a cube of half the distance are always near enough, so of each cube only its largest place is left to
    look further; that is a row a cube, or none. Those look for neighbours in cells of the distance's size, the own and the
    26 around it, by an equal join: a place meets at most eight names from each, however dense the cells are.
    """
    radius = 6371.0
    lat, lon = F.radians("lat"), F.radians("lon")
    p = places.select("place", "population", (F.cos(lat) * F.cos(lon) * radius).alias("_x"), (F.cos(lat) * F.sin(lon) * radius).alias("_y"), (F.sin(lat) * radius).alias("_z"))
    # places without a position are near none
    p = p.where(" AND ".join(f"NOT isnan({c}) AND {c} IS NOT NULL" for c in ("_x", "_y", "_z")) + " AND population IS NOT NULL")
    cell = lambda size, names: [F.floor(F.col(c) / size).alias(n) for c, n in zip(("_x", "_y", "_z"), names, strict=True)]
    cube, block = ["_a", "_b", "_c"], ["_i", "_j", "_k"]
    p = p.select("*", *cell(kilometres / 2, cube))
    # the names of a cube's largest places, the first and the last: others of the cube are beaten, and those too if there are two
    each = p.groupBy(*cube, "population").agg(F.min("place").alias("_first"), F.max("place").alias("_last"))
    top = each.groupBy(*cube).agg(F.max_by(F.struct("_first", "_last"), "population").alias("_t")).select(*cube, "_t.*")
    p = p.join(top, cube).withColumn("_beaten", (F.col("place") != F.col("_first")) | (F.col("place") != F.col("_last")))
    around = F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip((a, b, c), block, strict=True))) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1))))
    left = p.where("NOT _beaten").select("place", "population", "_x", "_y", "_z", *cell(kilometres, ["i", "j", "k"]), around.alias("s"))
    left = left.select("place", "population", "_x", "_y", "_z", *((F.col(n) + F.col(f"s.{b}")).alias(b) for n, b in zip("ijk", block, strict=True)))
    near = p.select(F.col("place").alias("other"), F.col("population").alias("pop2"), F.col("_x").alias("x2"), F.col("_y").alias("y2"), F.col("_z").alias("z2"), *cell(kilometres, block))
    apart = (F.col("_x") - F.col("x2")) ** 2 + (F.col("_y") - F.col("y2")) ** 2 + (F.col("_z") - F.col("z2")) ** 2
    beaten = left.join(near, block).where((F.col("place") != F.col("other")) & (F.col("pop2") >= F.col("population")) & (apart <= kilometres**2)).select("place")
    return places.join(p.where("_beaten").select("place").unionByName(beaten).distinct(), "place", "left_anti")


def bundle(fractions: DataFrame, by_fraction: list[str]) -> DataFrame:
    """(variable, place, class, fraction): classes by falling fraction for the variables named, by class for others."""
    order = F.when(F.col("variable").isin(by_fraction), -F.col("fraction")).otherwise(F.col("class"))
    return fractions.withColumn("place", F.row_number().over(Window.partitionBy("variable").orderBy(order, "class"))).select("variable", "place", "class", "fraction")

"""Administrative places: their hierarchy, lists and joins with points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parent_gid(gid: Column, level: Column) -> Column:
    """The gid one level up: without its last dotted part, and at level 2 with the suffix it had. None for level 0 or no dot."""
    base = F.substring_index(gid, "_", 1)
    suffix = F.regexp_extract(gid, "(_.+)$", 1)
    up = F.when(base.contains("."), F.regexp_replace(base, r"\.[^.]*$", ""))
    return F.when(level == 1, up).when(level > 1, F.concat(up, suffix))


def most_specific(*levels: Column) -> Column:
    """The first of the levels, the finest given first, that is not blank."""
    return F.coalesce(*(F.when(F.trim(x) != "", x) for x in levels))


def gid_counts(df: DataFrame, columns: dict[str, str], by: str = "taxon_key") -> DataFrame:
    """(scope, gid, taxon_key, n) for each location column; blank gids are left out, quality is not asked for."""
    pairs = F.explode(F.array(*(F.struct(F.lit(scope).alias("scope"), F.col(c).alias("gid")) for scope, c in columns.items())))
    return df.select(by, pairs.alias("p")).select(by, "p.*").where("trim(gid) <> ''").groupBy("scope", "gid", by).agg(F.count(F.lit(1)).alias("n"))


def listed(counts: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """Places by count, then name and gid, the first ``limit``."""
    return counts.join(names, "gid").orderBy(F.desc("n"), F.lower("name"), "gid").limit(limit)


def with_ancestors(places: DataFrame) -> DataFrame:
    """(gid, chain): the names from the top to the place itself, as JSON, for a table (gid, name, parent_gid) of three levels."""
    p = places.select("gid", "name", "parent_gid")
    up = p.select(F.col("gid").alias("g1"), F.col("name").alias("n1"), F.col("parent_gid").alias("g2"))
    top = p.select(F.col("gid").alias("g2"), F.col("name").alias("n2"))
    chain = F.to_json(F.filter(F.array("n2", "n1", "name"), lambda x: x.isNotNull()))
    return p.join(up, p["parent_gid"] == up["g1"], "left").join(top, "g2", "left").select("gid", chain.alias("chain"))


SLACK = 1e-9  # of a cell: what lies nearer to its edge may be put on either side of it
FINER = 4  # parts of a cell, each way, in which outlines are posted


def _at_places(points: DataFrame, key: str, cell: float, held: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, region): ``held`` finds the region of each place (lat, lon, i, j) once, however many points share it."""
    at = lambda c: F.floor(c / cell)
    spots = points.select("lat", "lon").distinct().select("lat", "lon", at(F.col("lat")).alias("i"), at(F.col("lon")).alias("j"))
    return points.select(key, "lat", "lon").join(held(spots).groupBy("lat", "lon").agg(F.min("region").alias("region")), ["lat", "lon"], "left").select(key, "region")


def _first_of_cells(posted: DataFrame) -> DataFrame:
    """Postings (i, j, region, whole, ...) without those that can't be the first of any place: in each cell, regions after the
    first one that holds the whole cell."""
    first = F.min(F.when(F.col("whole"), F.col("region"))).over(Window.partitionBy("i", "j"))
    return posted.withColumn("_first", first).where("_first IS NULL OR region <= _first").drop("_first")


def first_region(points: DataFrame, key: str, regions: DataFrame, cell: float) -> DataFrame:
    """(key, region): the first region, by name, whose box (south, west, north, east) holds a point strictly inside.

    Boxes are posted in every cell they meet, points in their own, so it is an equi-join on the cell and not a comparison
    of all points with all regions. Of equal boxes the first is posted, and a cell keeps none after the first that holds all
    of it, so what a point meets doesn't grow with the regions. ``region_at`` takes rings instead of boxes.
    """
    at = lambda c: F.floor(c / cell)
    box = ["south", "west", "north", "east"]
    boxes = regions.groupBy(*box).agg(F.min("region").alias("region"))
    posted = boxes.withColumn("i", F.explode(F.sequence(at(F.col("south")), at(F.col("north"))))).withColumn("j", F.explode(F.sequence(at(F.col("west")), at(F.col("east")))))
    low = lambda k: (F.col(k) - SLACK) * cell
    high = lambda k: (F.col(k) + 1 + SLACK) * cell
    whole = (F.col("south") < low("i")) & (F.col("north") > high("i")) & (F.col("west") < low("j")) & (F.col("east") > high("j"))
    posted = _first_of_cells(posted.withColumn("whole", F.coalesce(whole, F.lit(False))))
    # the place of a name in its cell, a number, is aggregated by hashing; names would have all that hold a point sorted
    posted = posted.withColumn("nth", F.row_number().over(Window.partitionBy("i", "j").orderBy(F.col("region").asc_nulls_last())))

    def held(p: DataFrame) -> DataFrame:
        hits = p.join(posted.drop("region"), ["i", "j"]).where("lat > south AND lat < north AND lon > west AND lon < east")
        return hits.groupBy("lat", "lon", "i", "j").agg(F.min("nth").alias("nth")).join(posted.select("i", "j", "nth", "region"), ["i", "j", "nth"])

    return _at_places(points, key, cell, held)


def edges(rings: Column) -> Column:
    """The sides (y1, x1, y2, x2) of rings of (lat, lon) corners, each closed; rings under three corners have none."""

    def of(ring: Column) -> Column:
        following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
        side = lambda a, b: F.struct(a["lat"].alias("y1"), a["lon"].alias("x1"), b["lat"].alias("y2"), b["lon"].alias("x2"))
        return F.zip_with(ring, following, side)

    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) >= 3), of))


def odd_crossings(sides: Column, lat: Column, lon: Column) -> Column:
    """A line to the east meets an odd number of sides: inside, by the even-odd rule, so holes are rings like others."""
    east = lambda e: lon < e["x1"] + (lat - e["y1"]) * ((e["x2"] - e["x1"]) / (e["y2"] - e["y1"]))
    met = F.filter(sides, lambda e: F.when((lat > e["y1"]) != (lat > e["y2"]), east(e)).otherwise(False))
    return F.size(met) % 2 == 1


def region_at(points: DataFrame, key: str, regions: DataFrame, cell: float) -> DataFrame:
    """(key, region): the first region, by name, whose rings hold the point; null where none does.

    ``regions`` is (region, rings: array<array<struct<lat, lon>>>). A region is posted in the cells of its box, each time with
    only those of its sides that the cell's band of latitude meets and that don't lie west of it: all that a line to the east can
    cross. Points look in their own cell, so it is an equi-join, and a coast of a million corners is never held whole against a
    point. Of equal outlines the first is posted. A cell that no side comes near lies in or out as a whole: it is posted
    without sides, or not, and nothing after the first that holds it is, so what a point meets doesn't grow with the regions."""
    cell = cell / FINER
    at = lambda c: F.floor(c / cell)
    r = regions.groupBy("rings").agg(F.min("region").alias("region")).select("region", edges(F.col("rings")).alias("sides")).where(F.size("sides") > 0)
    ends = lambda f, names: f(F.flatten(F.transform("sides", lambda e: F.array(*(e[n] for n in names)))))
    r = r.select("region", "sides", ends(F.array_min, ("y1", "y2")).alias("south"), ends(F.array_max, ("y1", "y2")).alias("north"), ends(F.array_min, ("x1", "x2")).alias("west"), ends(F.array_max, ("x1", "x2")).alias("east"))
    band = r.withColumn("i", F.explode(F.sequence(at(F.col("south")), at(F.col("north")))))
    low = lambda k: (F.col(k) - SLACK) * cell
    high = lambda k: (F.col(k) + 1 + SLACK) * cell
    band = band.withColumn("sides", F.filter("sides", lambda e: (F.least(e["y1"], e["y2"]) <= high("i")) & (F.greatest(e["y1"], e["y2"]) >= low("i"))))
    posted = band.withColumn("j", F.explode(F.sequence(at(F.col("west")), at(F.col("east")))))
    posted = posted.withColumn("sides", F.filter("sides", lambda e: F.greatest(e["x1"], e["x2"]) >= low("j")))
    # a side whose box misses the cell, or that has all four corners of it on one hand, doesn't come near

    def near(e: Column) -> Column:
        hand = lambda y, x: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        corners = [hand(y("i"), x("j")) for y in (low, high) for x in (low, high)]
        least = SLACK * cell * (F.abs(e["x2"] - e["x1"]) + F.abs(e["y2"] - e["y1"]))
        return (F.least(e["x1"], e["x2"]) <= high("j")) & (F.least(*corners) <= least) & (F.greatest(*corners) >= -least)

    met = F.coalesce(F.exists("sides", near), F.lit(True))
    inside = odd_crossings(F.col("sides"), (F.col("i") + 0.5) * cell, (F.col("j") + 0.5) * cell)
    posted = posted.withColumn("met", met).withColumn("whole", ~F.col("met") & inside).where("met OR whole")
    posted = posted.withColumn("sides", F.when(F.col("met"), F.col("sides"))).select("region", "i", "j", "sides", "whole", "south", "north", "west", "east")
    posted = _first_of_cells(posted)

    def held(p: DataFrame) -> DataFrame:
        near = p.join(posted, ["i", "j"]).where("lat BETWEEN south AND north AND lon BETWEEN west AND east")  # NaN is in none
        return near.where(F.col("whole") | odd_crossings(F.col("sides"), F.col("lat"), F.col("lon")))

    return _at_places(points, key, cell, held)


def zoom_of(population: Column, steps: list[tuple[int, int]]) -> Column:
    """The zoom from which a place is shown, by the largest of the (least population, zoom) steps it reaches, else the last's."""
    steps = sorted(steps, reverse=True)
    return F.coalesce(*(F.when(population >= least, zoom) for least, zoom in steps), F.lit(steps[-1][1]))


def top_per_cell(df: DataFrame, cell: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each cell."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*cell).orderBy(*order))).where(F.col("_r") <= n).drop("_r")

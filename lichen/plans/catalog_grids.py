"""Queries on grids and places: parts of a catalogue table are the pixels, orders the observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lichen.functions import geo, weather
from lichen.operators import places, rasters, timeseries
from lichen.plans.catalog import query, rounded
from lichen.sources.tables import SQL_HOURLY, SQL_OBS, hourly, observations, table

# a grid of 40 columns, its cells numbered by part
SQL_GRID = """grid AS (SELECT p_partkey // 40 AS "row", p_partkey % 40 AS col, p_retailprice AS value FROM part)"""
# the rows of that grid, 40 at least, and the cells of a new one with 55 for each 40
SQL_NEW = """n AS (SELECT greatest(40, max(p_partkey) // 40 + 1) AS h, CAST(ceil(h * 55e0 / 40) AS BIGINT) AS h2 FROM part),
t AS (SELECT i AS "row", j AS col, h, (i + 0.5e0) * (h / CAST(h2 AS DOUBLE)) AS y, (j + 0.5e0) * (40e0 / 55) AS x FROM n, (SELECT unnest(range(h2)) AS i FROM n), range(55) b(j))"""


def grid(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.floor(k / 40).alias("row"), (k % 40).alias("col"), F.col("p_retailprice").alias("value"))


def grid_rows(spark: SparkSession, d: str) -> tuple[int, int]:
    """The rows of the grid of all parts, 40 at least, and those of the new grid, which has 55 for each 40."""
    rows = max(40, (table(spark, d, "part").agg(F.max("p_partkey")).first()[0] or 0) // 40 + 1)
    return rows, -(-rows * 55 // 40)


def codes(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d).select("cell", (F.floor("value") % 13).alias("code"))


SQL_CODES = f"{SQL_HOURLY}, codes AS (SELECT cell, CAST(floor(value) AS BIGINT) % 13 AS code FROM hourly)"


@query(f"WITH {SQL_HOURLY} SELECT cell, fix(sum(value), 4) AS sum, count(*) AS steps FROM hourly GROUP BY 1")
def raster_sum(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rasters.hour_sums(hourly(spark, d), ["cell"]), 4)


@query(f"WITH {SQL_HOURLY} SELECT cell, fix(least(120e0, greatest(0e0, sum(value) / count(*))), 4) AS mean FROM hourly GROUP BY 1")
def raster_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rasters.mean_of(rasters.hour_sums(hourly(spark, d), ["cell"]), 0, 120).select("cell", "mean"), 4)


@query(f"WITH {SQL_HOURLY}, m AS (SELECT cell, sum(value) / count(*) AS mean FROM hourly GROUP BY 1) SELECT count(*) AS cells, count(*) FILTER (WHERE mean < 99.999e0 OR mean > 120.001e0) AS beyond FROM m")
def raster_bounds_check(spark: SparkSession, d: str) -> DataFrame:
    return rasters.out_of_bounds(rasters.mean_of(rasters.hour_sums(hourly(spark, d), ["cell"])), "mean", 100, 120)


@query("WITH v AS (SELECT user_id % 20 AS cell, value % 40 AS t, value % 40 - value % 7 AS td FROM events) SELECT cell, fix(sum(0.6108e0 * exp(17.27e0 * t / (t + 237.3e0)) - 0.6108e0 * exp(17.27e0 * td / (td + 237.3e0))), 4) AS sum, count(*) AS steps FROM v GROUP BY 1")
def raster_vpd_sum(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "events").select((F.col("user_id") % 20).alias("cell"), weather.vpd(F.col("value") % 40, F.col("value") % 40 - F.col("value") % 7).alias("value"))
    return rounded(rasters.hour_sums(v, ["cell"]), 4)


@query(f"WITH {SQL_CODES} SELECT cell, code, count(*) AS n FROM codes GROUP BY ALL")
def raster_mode_counts(spark: SparkSession, d: str) -> DataFrame:
    return rasters.code_counts(codes(spark, d), ["cell"])


@query(f"WITH {SQL_CODES}, c AS (SELECT cell, code, count(*) AS n FROM codes GROUP BY ALL) SELECT cell, arg_min(code, -n * 100 + code) AS code FROM c GROUP BY 1")
def raster_mode(spark: SparkSession, d: str) -> DataFrame:
    return rasters.commonest(rasters.code_counts(codes(spark, d), ["cell"]), ["cell"]).select("cell", F.col("code").cast("long").alias("code"))


@query(f'WITH {SQL_GRID} SELECT "row" // 2 AS "row", col // 2 AS col, fix(avg(value), 4) AS value FROM grid GROUP BY ALL')
def regrid_average(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rasters.regrid_average(grid(spark, d), 2), 4)


@query(f"""WITH {SQL_GRID}, {SQL_NEW} SELECT t."row", t.col, fix(value, 4) AS value FROM t LEFT JOIN grid g ON least(h - 1, CAST(floor(y) AS BIGINT)) = g."row" AND least(39, CAST(floor(x) AS BIGINT)) = g.col""")
def regrid_nearest(spark: SparkSession, d: str) -> DataFrame:
    rows, new_rows = grid_rows(spark, d)
    return rounded(rasters.regrid_nearest(grid(spark, d), rows, 40, new_rows, 55), 4)


@query(f"""WITH {SQL_GRID}, {SQL_NEW}, c AS (SELECT "row", col, greatest(0e0, least(y - 0.5e0, h - 1e0)) AS y, greatest(0e0, least(x - 0.5e0, 39e0)) AS x FROM t),
k AS (SELECT "row", col, y, x, CAST(floor(y) AS BIGINT) + a AS r, CAST(floor(x) AS BIGINT) + b AS q FROM c, range(2) u(a), range(2) v(b)),
w AS (SELECT k."row", k.col, greatest(0e0, 1 - abs(y - r)) * greatest(0e0, 1 - abs(x - q)) AS w, value FROM k JOIN grid g ON g."row" = r AND g.col = q)
SELECT "row", col, fix(sum(w * value) / sum(w), 4) AS value FROM w WHERE w > 0 GROUP BY ALL""")
def regrid_bilinear(spark: SparkSession, d: str) -> DataFrame:
    rows, new_rows = grid_rows(spark, d)
    return rounded(rasters.regrid_bilinear(grid(spark, d), rows, 40, new_rows, 55), 4)


@query("SELECT p_partkey, fix(CASE WHEN p_size = 7 THEN NULL ELSE p_size * 0.1e0 + 2 END, 6) AS scaled, fix(CASE WHEN p_size = 7 THEN 0 ELSE p_size * 0.1e0 + 2 END, 6) AS filled FROM part")
def nodata_scaling(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("p_size").cast("double")
    return rounded(table(spark, d, "part").select("p_partkey", rasters.scaled(v, 7, 0.1, 2).alias("scaled"), rasters.scaled(v, 7, 0.1, 2, zero=True).alias("filled")))


@query("SELECT round(min(p_retailprice), 6) AS low, round(max(p_retailprice), 6) AS high FROM part")
def render_bounds(spark: SparkSession, d: str) -> DataFrame:
    return rasters.render_bounds(table(spark, d, "part"), "p_retailprice")


_TILE = "CAST(floor((lon + 180) / 22.5e0) AS BIGINT) AS tx, CAST(floor((90 - lat) / 22.5e0) AS BIGINT) AS ty"


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).withColumns({"tx": F.floor((F.col("lon") + 180) / 22.5), "ty": F.floor((90 - F.col("lat")) / 22.5)})


@query(f"WITH {SQL_OBS} SELECT {_TILE}, nominal, count(*) AS pixels FROM obs GROUP BY ALL")
def tile_class_counts(spark: SparkSession, d: str) -> DataFrame:
    return rasters.class_counts(_tiles(spark, d), ["tx", "ty"], "nominal")


@query(f"WITH {SQL_OBS} SELECT {_TILE}, fix(min(ratio), 4) AS low, fix(max(ratio), 4) AS high FROM obs GROUP BY ALL")
def tile_value_range(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_tiles(spark, d).groupBy("tx", "ty").agg(F.min("ratio").alias("low"), F.max("ratio").alias("high")), 4)


@query(f"WITH {SQL_OBS} SELECT catalog_number FROM obs WHERE (ratio BETWEEN 1000 AND 60000 OR ratio >= 200000) AND (angle >= 300 OR angle <= 40)")
def tile_masks(spark: SparkSession, d: str) -> DataFrame:
    return rasters.masked(observations(spark, d), {"ratio": [(1000, 60000), (200000, None)], "angle": [(300, 40)]}, wraps=("angle",)).select("catalog_number")


@query("SELECT p_partkey, CAST(floor(greatest(0e0, least((p_retailprice - 950) / 100e0, 1e0)) * 255) AS BIGINT) AS i FROM part")
def colour_index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", rasters.lut_index(F.col("p_retailprice"), 950, 1050).alias("i"))


@query("WITH h AS (SELECT c_custkey, CAST(greatest(0e0, least(round_even((c_acctbal + 32768) * 256, 0), 16777215e0)) AS BIGINT) AS h FROM customer) SELECT c_custkey, h >> 16 AS red, (h >> 8) & 255 AS green, h & 255 AS blue FROM h")
def terrain_bytes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", *(c.alias(n) for n, c in rasters.terrarium(F.col("c_acctbal")).items()))


@query("SELECT p_partkey, CAST(p_size * 137 % 360 AS BIGINT) AS hue FROM part")
def fallback_hue(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", (F.col("p_size").cast("long") * 137 % 360).alias("hue"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_number FROM orders")
def row_numbering(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey")
    return rasters.row_numbers(o, ["o_orderkey"], F.floor(F.col("o_orderkey") / 4096)).select("o_orderkey", "row_number")


# places


@query("""WITH g AS (SELECT c_custkey, c_custkey % 3 AS level, CASE c_custkey % 3 WHEN 0 THEN 'AAA' WHEN 1 THEN 'AAA.' || c_nationkey || '_1' ELSE 'AAA.' || c_nationkey || '.' || c_custkey || '_1' END AS gid FROM customer)
SELECT c_custkey, CASE level WHEN 1 THEN 'AAA' WHEN 2 THEN 'AAA.' || regexp_extract(gid, '^AAA\\.([0-9]+)\\.', 1) || '_1' END AS parent FROM g""")
def gid_parent(spark: SparkSession, d: str) -> DataFrame:
    level, n = F.col("c_custkey") % 3, F.col("c_nationkey").cast("string")
    own = F.col("c_custkey").cast("string")
    gid = F.when(level == 0, "AAA").when(level == 1, F.concat(F.lit("AAA."), n, F.lit("_1"))).otherwise(F.concat(F.lit("AAA."), n, F.lit("."), own, F.lit("_1")))
    return table(spark, d, "customer").select("c_custkey", places.parent_gid(gid, level).alias("parent"))


@query(f"WITH {SQL_OBS} SELECT catalog_number, coalesce(nullif(level1, ''), nullif(level0, ''), nullif(region, '')) AS place FROM obs")
def most_specific_place(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).select("catalog_number", places.most_specific(F.col("level1"), F.col("level0"), F.col("region")).alias("place"))


_GIDS = "g AS (SELECT 'level0' AS scope, level0 AS gid, taxon_key FROM obs UNION ALL SELECT 'level1', level1, taxon_key FROM obs UNION ALL SELECT 'region', region, taxon_key FROM obs)"


@query(f"WITH {SQL_OBS}, {_GIDS} SELECT scope, gid, taxon_key, count(*) AS n FROM g WHERE coalesce(gid, '') <> '' GROUP BY ALL")
def gid_counts(spark: SparkSession, d: str) -> DataFrame:
    return places.gid_counts(observations(spark, d), {"level0": "level0", "level1": "level1", "region": "region"})


@query(f"WITH {SQL_OBS}, {_GIDS} SELECT taxon_key, count(*) AS n FROM g WHERE scope = 'level0' AND gid = 'g3' GROUP BY 1")
def location_keys(spark: SparkSession, d: str) -> DataFrame:
    return places.gid_counts(observations(spark, d), {"level0": "level0"}).where("gid = 'g3'").select("taxon_key", "n")


@query("SELECT n_nationkey AS gid, n_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name ORDER BY n DESC, lower(n_name), n_nationkey LIMIT 10")
def location_list(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("gid")).agg(F.count(F.lit(1)).alias("n"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("gid"), F.col("n_name").alias("name"))
    return places.listed(counts, names, 10)


@query("""SELECT 'r' || r_regionkey AS gid, '["' || r_name || '"]' AS chain FROM region UNION ALL SELECT 'n' || n_nationkey, '["' || r_name || '","' || n_name || '"]' FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'c' || c_custkey, '["' || r_name || '","' || n_name || '","' || c_name || '"]' FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def locations_table(spark: SparkSession, d: str) -> DataFrame:
    row = lambda name, letter, key, title, above, up: table(spark, d, name).select(F.concat(F.lit(letter), key).alias("gid"), F.col(title).alias("name"), (F.concat(F.lit(above), up) if up else F.lit(None).cast("string")).alias("parent_gid"))
    every = row("region", "r", "r_regionkey", "r_name", "", None).unionByName(row("nation", "n", "n_nationkey", "n_name", "r", "n_regionkey")).unionByName(row("customer", "c", "c_custkey", "c_name", "n", "c_nationkey"))
    return places.with_ancestors(every)


@query(f"""WITH {SQL_OBS}, b AS (SELECT 's' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS region, s_suppkey * 7 % 160 - 85e0 AS south, s_suppkey * 13 % 340 - 175e0 AS west FROM supplier)
SELECT catalog_number, min(b.region) AS region FROM obs LEFT JOIN b ON lat > south AND lat < south + 12 AND lon > west AND lon < west + 15 GROUP BY 1""")
def point_in_region(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    b = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.lpad(k.cast("string"), 6, "0")).alias("region"), (k * 7 % 160 - F.lit(85.0)).alias("south"), (k * 13 % 340 - F.lit(175.0)).alias("west"))
    b = b.withColumns({"north": F.col("south") + 12, "east": F.col("west") + 15})
    return places.first_region(observations(spark, d), "catalog_number", b, 5.0)


@query("WITH m(x, y, z) AS (SELECT n_nationkey % 8, n_regionkey, 3 FROM nation) SELECT DISTINCT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, fix(x * 45e0 - 180, 6) AS west FROM m")
def tile_bounds(spark: SparkSession, d: str) -> DataFrame:
    west = [geo.tile_bounds(x, 0, 3)[0] for x in range(8)]
    degrees = F.degrees(F.element_at(F.array(*map(F.lit, west)), (F.col("x") + 1).cast("int")) / 6378137.0)
    t = table(spark, d, "nation").select((F.col("n_nationkey") % 8).cast("long").alias("x"), F.col("n_regionkey").cast("long").alias("y")).distinct()
    return rounded(t.select("x", "y", degrees.alias("west")))


@query(f"""WITH {SQL_HOURLY}, o AS (SELECT o_orderkey, o_orderkey % 20 AS cell, CAST(473352 + o_orderkey * 17 % 720 AS BIGINT) AS hour FROM orders)
SELECT o_orderkey, fix(sum(value), 4) AS sum, count(value) AS n FROM o LEFT JOIN hourly h ON o.cell = h.cell AND h.hour BETWEEN o.hour - 23 AND o.hour GROUP BY 1""")
def cell_series_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 20).alias("cell"), (473352 + F.col("o_orderkey") * 17 % 720).cast("long").alias("hour"))
    return rounded(timeseries.at_observations(o, hourly(spark, d), 24, "o_orderkey"), 4)

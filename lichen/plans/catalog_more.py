"""Queries on tiles, outlines, enrichment, descriptions and exports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lichen.functions import geo
from lichen.operators import enrich, hierarchy, naming, places, profiles, rasters, stats, tiles, timeseries
from lichen.plans import jobs
from lichen.plans.catalog import _CLASS, _rolled, _rolled_sql, query, rounded
from lichen.sources import exports, layers
from lichen.sources.tables import SQL_HOURLY, SQL_OBS, SQL_TAXA, hourly, observations, table, taxa

# outlines: a five-cornered, not convex, region for each supplier
CORNERS = ((0.0, 0.0), (12.0, 4.0), (5.0, 7.0), (12.0, 15.0), (2.0, 12.0))
SQL_SIDES = "e(y1, x1, y2, x2) AS (VALUES " + ", ".join(f"({a}e0, {b}e0, {c}e0, {d}e0)" for (a, b), (c, d) in zip(CORNERS, (*CORNERS[1:], CORNERS[0]), strict=True)) + ")"
SQL_REGIONS = f"""b AS (SELECT 's' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS region, s_suppkey * 7 % 160 - 85e0 AS south, s_suppkey * 13 % 340 - 175e0 AS west FROM supplier), {SQL_SIDES},
sides AS (SELECT region, south + y1 AS y1, west + x1 AS x1, south + y2 AS y2, west + x2 AS x2, south, west FROM b, e)"""


def outlines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    south, west = k * 7 % 160 - F.lit(85.0), k * 13 % 340 - F.lit(175.0)
    ring = F.array(*(F.struct((south + a).alias("lat"), (west + b).alias("lon")) for a, b in CORNERS))
    return table(spark, d, "supplier").select(F.concat(F.lit("s"), F.lpad(k.cast("string"), 6, "0")).alias("region"), F.array(ring).alias("rings"))


def _held(points: str, key: str) -> str:
    """SQL of the regions that hold each point: an odd number of sides to the east of it."""
    return f"""held AS (SELECT {key}, min(region) AS region FROM (SELECT {key}, sides.region FROM {points} JOIN sides ON lat >= south AND lat <= south + 12 AND lon >= west AND lon <= west + 15
  WHERE (lat > y1) <> (lat > y2) AND lon < x1 + (lat - y1) * ((x2 - x1) / (y2 - y1)) GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY ALL)"""


@query(f"WITH {SQL_OBS}, {SQL_REGIONS}, {_held('obs', 'catalog_number')} SELECT catalog_number, held.region FROM obs LEFT JOIN held USING (catalog_number)")
def polygon_join(spark: SparkSession, d: str) -> DataFrame:
    return places.region_at(observations(spark, d), "catalog_number", outlines(spark, d), 5.0)


# tiles of 16 x 16 pixels at zoom 3, over a raster of all parts, twice as wide as high
SQL_PIXELS = """t AS (SELECT DISTINCT CAST(n_nationkey % 8 AS BIGINT) AS x, CAST(n_regionkey + 1 AS BIGINT) AS y FROM nation),
px AS (SELECT CAST(3 AS BIGINT) AS z, x, y, i AS px, j AS py, (x + (i + 0.5e0) / 16) / 8e0 * 360 - 180 AS lon, degrees(atan(sinh(pi() * (1 - (y + (j + 0.5e0) / 16) / 8e0 * 2)))) AS lat FROM t, range(16) a(i), range(16) b(j))"""
SQL_RASTER = """n AS (SELECT CAST(ceil(sqrt((max(p_partkey) + 1) / 2e0)) AS BIGINT) AS h FROM part),
r AS (SELECT CAST(p_partkey // (2 * h) AS BIGINT) AS "row", CAST(p_partkey % (2 * h) AS BIGINT) AS col, p_retailprice AS value FROM part, n)"""
SQL_SAMPLED = f"""{SQL_PIXELS}, {SQL_RASTER}, v AS (SELECT z, x, y, px, py, value FROM px, n LEFT JOIN r ON "row" = CAST(floor((90 - lat) / (180e0 / h)) AS BIGINT) AND col = CAST(floor((lon + 180) / (180e0 / h)) AS BIGINT))"""


def pixels(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nation").select(F.lit(3).alias("z"), (F.col("n_nationkey") % 8).alias("x"), (F.col("n_regionkey") + 1).alias("y")).distinct()
    return tiles.pixels(t, 16).withColumns({c: F.col(c).cast("long") for c in ("px", "py")})


def raster(spark: SparkSession, d: str, value: str = "p_retailprice") -> tuple[DataFrame, float]:
    part = table(spark, d, "part")
    h = math.ceil(math.sqrt(((part.agg(F.max("p_partkey")).first()[0] or 0) + 1) / 2))
    k = F.col("p_partkey")
    return part.select(F.floor(k / (2 * h)).cast("long").alias("row"), (k % (2 * h)).cast("long").alias("col"), F.col(value).cast("double").alias("value")), 180.0 / h


def _sampled(spark: SparkSession, d: str) -> DataFrame:
    return tiles.from_cells(pixels(spark, d), *raster(spark, d)).select("z", "x", "y", "px", "py", "value")


@query(f"WITH {SQL_SAMPLED} SELECT z, x, y, px, py, fix(value, 4) AS value FROM v")
def tile_sample(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_sampled(spark, d), 4)


@query(f"WITH {SQL_PIXELS}, {SQL_HOURLY}, g AS (SELECT cell // 5 AS r, cell % 5 AS c, avg(value) AS value FROM hourly GROUP BY ALL) SELECT z, x, y, px, py, fix(value, 4) AS value FROM px LEFT JOIN g ON r = least(3, CAST(round_even((lat + 90) / 60, 0) AS BIGINT)) AND c = least(4, CAST(round_even((lon + 180) / 60, 0) AS BIGINT))")
def tile_temporal(spark: SparkSession, d: str) -> DataFrame:
    g = hourly(spark, d).groupBy(F.floor(F.col("cell") / 5).alias("row"), (F.col("cell") % 5).alias("col")).agg(F.avg("value").alias("value"))
    return rounded(tiles.from_grid(pixels(spark, d), g, 60.0, 4, 5).select("z", "x", "y", "px", "py", "value"), 4)


@query(f"WITH {SQL_PIXELS}, {SQL_REGIONS}, {_held('px', 'z, x, y, px, py')} SELECT z, x, y, px, py, region FROM px LEFT JOIN held USING (z, x, y, px, py)")
def tile_regions(spark: SparkSession, d: str) -> DataFrame:
    return tiles.from_regions(pixels(spark, d), ["z", "x", "y", "px", "py"], outlines(spark, d), 5.0).select("z", "x", "y", "px", "py", "region")


@query(f"""WITH {SQL_SAMPLED}, q AS (SELECT fix(quantile_cont(value, 0.02), 4) AS a, fix(quantile_cont(value, 0.98), 4) AS b FROM v)
SELECT z, x, y, px, py, CAST(floor(greatest(0e0, least(1e0, (value - a) / (b - a))) * 255) AS BIGINT) AS colour FROM v, q WHERE value BETWEEN 900 AND 1000 OR value >= 1010""")
def tile_colours(spark: SparkSession, d: str) -> DataFrame:
    v = _sampled(spark, d)
    ends = rounded(tiles.range_of(v), 4)
    return tiles.rendered(v, ends, [(900.0, 1000.0), (1010.0, None)]).select("z", "x", "y", "px", "py", "colour")


# what a cell's height counts for in the slopes to the east and to the north of the cell that it is a neighbour of
SQL_HORN = "k(a, b, we, wn) AS (VALUES " + ", ".join(f"({a}, {b}, {b * (2 - abs(a))}, {-a * (2 - abs(b))})" for a in (-1, 0, 1) for b in (-1, 0, 1)) + ")"


@query(f"""WITH {SQL_RASTER}, {SQL_HORN}, w AS (SELECT "row" - a AS "row", col - b AS col, sum(value * we) AS e, sum(value * wn) AS n FROM r, k GROUP BY ALL HAVING count(*) = 9),
m AS (SELECT w.*, (180e0 / h) * 111320e0 AS size, 90 - ("row" + 0.5e0) * (180e0 / h) AS lat FROM w, n)
SELECT "row", col, fix(degrees(atan(sqrt((e / (8 * cos(radians(lat)) * size)) ** 2 + (n / (8 * size)) ** 2))), 6) AS slope FROM m""")
def slope_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tiles.slopes(*raster(spark, d)).where("slope IS NOT NULL").select("row", "col", "slope"), 6)


@query(f"""WITH {SQL_RASTER}, g AS (SELECT "row", col, value % 7 * 10 AS sand, value % 11 * 5 AS silt FROM r), s AS (SELECT "row", col, sand, silt, 100 - sand - silt AS clay FROM g WHERE sand + silt <= 100) SELECT "row", col, CAST({_CLASS} AS BIGINT) AS value FROM s""")
def soil_grid(spark: SparkSession, d: str) -> DataFrame:
    cells, _ = raster(spark, d)
    g = cells.select("row", "col", (F.col("value") % 7 * 10).alias("sand"), (F.col("value") % 11 * 5).alias("silt")).where("sand + silt <= 100")
    each = lambda c: g.select("row", "col", c.alias("value"))
    t = tiles.texture(each(F.col("sand")), each(F.col("silt")), each(100 - F.col("sand") - F.col("silt")), 1.0)
    return t.select("row", "col", F.col("value").cast("long").alias("value"))


@query("""WITH p AS (SELECT p_partkey, p_size * 40 AS w, p_size * 25 AS h, 1e0 / (p_size + 1) AS dx, 0.5e0 / (p_size + 1) AS dy FROM part), k AS (SELECT *, greatest((360e0 / 2048) / dx, (360e0 / 2048) / dy) AS want FROM p), f AS (SELECT unnest([2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048]) AS f)
SELECT p_partkey, CAST(count(f) AS BIGINT) AS n, CAST(coalesce(max(f), 0) AS BIGINT) AS largest FROM k LEFT JOIN f ON want > 1 AND f < want * 2 AND f < least(w, h) GROUP BY 1""")
def overview_factors(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    f = tiles.overview_factors(s * 40, s * 25, F.lit(1.0) / (s + 1), F.lit(0.5) / (s + 1))
    return table(spark, d, "part").select("p_partkey", F.size(f).cast("long").alias("n"), F.coalesce(F.array_max(f), F.lit(0)).cast("long").alias("largest"))


@query(f"WITH {SQL_REGIONS}, m AS (SELECT region, round_even(y1 / 8, 0) * 8 AS y1, round_even(x1 / 8, 0) * 8 AS x1, round_even(y2 / 8, 0) * 8 AS y2, round_even(x2 / 8, 0) * 8 AS x2 FROM sides), k AS (SELECT region, count(*) FILTER (WHERE y1 <> y2 OR x1 <> x2) AS corners, fix(sum(x1 * y2 - x2 * y1) / 2, 4) AS area FROM m GROUP BY 1) SELECT region, corners, area FROM k WHERE corners >= 3")
def outline_simplified(spark: SparkSession, d: str) -> DataFrame:
    """Corners left at a tolerance of 8 degrees, and the area they enclose."""
    r = outlines(spark, d).select("region", tiles.simplified(F.col("rings"), 8.0).alias("rings")).where(F.size("rings") > 0)
    e = r.select("region", F.size(F.element_at("rings", 1)).cast("long").alias("corners"), F.explode(places.edges(F.col("rings"))).alias("e"))
    return rounded(e.groupBy("region", "corners").agg((F.sum(F.col("e.x1") * F.col("e.y2") - F.col("e.x2") * F.col("e.y1")) / 2).alias("area")), 4)


@query(f"""WITH {SQL_OBS}, {SQL_RASTER}, {SQL_REGIONS}, {SQL_HOURLY}, o AS (SELECT catalog_number, lat, lon, catalog_number % 20 AS cell, CAST(473352 + catalog_number * 17 % 720 AS BIGINT) AS hour FROM obs), {_held('o', 'catalog_number')},
w AS (SELECT o.catalog_number, avg(h.value) AS mean FROM o JOIN hourly h ON o.cell = h.cell AND h.hour BETWEEN o.hour - 23 AND o.hour GROUP BY 1)
SELECT o.catalog_number, fix(r.value * 0.1e0 - 5, 4) AS price, region, fix(mean, 4) AS mean_24h FROM o CROSS JOIN n LEFT JOIN r ON "row" = CAST(floor((90 - lat) / (180e0 / h)) AS BIGINT) AND col = CAST(floor((lon + 180) / (180e0 / h)) AS BIGINT) LEFT JOIN held USING (catalog_number) LEFT JOIN w USING (catalog_number)""")
def upload_enrichment(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("catalog_number")
    o = observations(spark, d).select("catalog_number", "lat", "lon", (k % 20).alias("cell"), (473352 + k * 17 % 720).cast("long").alias("hour"))
    cells, size = raster(spark, d)
    wanted = {"price": enrich.Raster(cells, size, 0.1, -5.0), "region": enrich.Regions(outlines(spark, d), 5.0), "mean_24h": enrich.Series(hourly(spark, d), 24)}
    found = enrich.enriched(o, "catalog_number", wanted).select("catalog_number", F.when(~F.isnan("price"), F.col("price")).alias("price"), "region", "mean_24h")
    return rounded(found, 4)


@query(f"WITH {SQL_OBS}, {SQL_HOURLY}, o AS (SELECT catalog_number, least(3, CAST(round_even((lat + 90) / 60, 0) AS BIGINT)) * 5 + least(4, CAST(round_even((lon + 180) / 60, 0) AS BIGINT)) AS cell, CAST(473352 + catalog_number * 17 % 720 AS BIGINT) AS hour FROM obs) SELECT catalog_number, fix(value, 4) AS value FROM o LEFT JOIN hourly USING (cell, hour)")
def point_in_time(spark: SparkSession, d: str) -> DataFrame:
    row, col = geo.grid_index(F.col("lat"), F.col("lon"), 60.0, 4, 5)
    o = observations(spark, d).select("catalog_number", (row * 5 + col).alias("cell"), (473352 + F.col("catalog_number") * 17 % 720).cast("long").alias("hour"))
    return rounded(timeseries.value_at(o, hourly(spark, d), "catalog_number"), 4)


# descriptions


def _joined(names: str, last: str = "true") -> str:
    """SQL of a list of names as a text."""
    return f"CASE WHEN NOT ({last}) THEN array_to_string({names}, ', ') WHEN len({names}) < 3 THEN array_to_string({names}, ' and ') ELSE array_to_string({names}[:-2], ', ') || ', and ' || {names}[-1] END"


@query(f"""WITH {SQL_OBS}, p AS (SELECT DISTINCT level0 AS gid, 0 AS level, CASE level0 WHEN 'g3' THEN 'Netherlands' ELSE 'Land ' || level0 END AS name, NULL AS parent FROM obs WHERE level0 IS NOT NULL UNION SELECT DISTINCT level1, 1, 'Area ' || level1, level0 FROM obs WHERE level1 IS NOT NULL),
c AS (SELECT taxon_key, level0 AS gid, count(*) AS n FROM obs WHERE level0 IS NOT NULL AND catalog_number % 9 < 5 GROUP BY ALL UNION ALL SELECT taxon_key, level1, count(*) FROM obs WHERE level1 IS NOT NULL AND catalog_number % 9 < 5 GROUP BY ALL),
l AS (SELECT taxon_key, level, parent, list(gid ORDER BY n DESC, gid) AS g, list(name ORDER BY n DESC, gid) AS m FROM c JOIN p USING (gid) GROUP BY ALL),
a AS (SELECT taxon_key, g[1] AS gid, len(g) AS k, list_transform(m[:3], lambda x: CASE x WHEN 'Netherlands' THEN 'the Netherlands' ELSE x END) AS m FROM l WHERE level = 0), b AS (SELECT taxon_key, parent, len(g) AS k, m[:3] AS m FROM l WHERE level = 1)
SELECT a.taxon_key, CASE WHEN a.k > 3 THEN {_joined("a.m", "false")} || ' and other countries' WHEN a.k > 1 THEN {_joined("a.m")} WHEN b.k IS NULL THEN a.m[1] WHEN b.k = 1 THEN b.m[1] || ' in ' || a.m[1]
  WHEN b.k > 3 THEN {_joined("b.m", "false")} || ' and other regions in ' || a.m[1] ELSE {_joined("b.m")} || ' in ' || a.m[1] END AS text FROM a LEFT JOIN b ON a.k = 1 AND a.taxon_key = b.taxon_key AND b.parent = a.gid""")
def location_texts(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    known = o.where("level0 IS NOT NULL").select(F.col("level0").alias("gid"), F.lit(0).alias("level"), F.when(F.col("level0") == "g3", "Netherlands").otherwise(F.concat(F.lit("Land "), "level0")).alias("name"), F.lit(None).cast("string").alias("parent_gid"))
    known = known.unionByName(o.where("level1 IS NOT NULL").select(F.col("level1").alias("gid"), F.lit(1).alias("level"), F.concat(F.lit("Area "), "level1").alias("name"), F.col("level0").alias("parent_gid"))).distinct()
    seen = o.where("catalog_number % 9 < 5")  # which lands a taxon is found in: g0 to g4
    counts = places.gid_counts(seen, {"level0": "level0", "level1": "level1"})
    return profiles.location_texts(counts, known)


@query(_rolled_sql("ordinal") + f""", c AS (SELECT taxon_key, ordinal AS k, count(*) AS n FROM f GROUP BY ALL), p AS (SELECT taxon_key, k, n / sum(n) OVER (PARTITION BY taxon_key) AS x FROM c WHERE true),
l AS (SELECT taxon_key, count(*) AS m, list('region ' || k ORDER BY x DESC, k) FILTER (WHERE x >= 0.05e0) AS s FROM p WHERE k <= 4 GROUP BY 1)
SELECT taxon_key, {_joined("s[:3]", "m = len(s[:3])")} || CASE WHEN m > len(s[:3]) THEN ' and other ecoregions' ELSE '' END AS text FROM l WHERE len(s) > 0""")
def region_texts(spark: SparkSession, d: str) -> DataFrame:
    legend = spark.createDataFrame([(k, f"region {k}") for k in range(1, 5)], "class long, name string")
    return profiles.region_texts(stats.class_fractions(_rolled(spark, d, "ordinal"), ["taxon_key"], "ordinal"), legend)


def _steps(value: str, table_of: tuple[list[tuple[float, str]], str]) -> str:
    return "CASE " + " ".join(f"WHEN {value} < {a} THEN '{word}'" for a, word in table_of[0]) + f" WHEN {value} IS NOT NULL THEN '{table_of[1]}' END"


@query(f"""WITH p AS (SELECT p_partkey, p_size * 3e0 AS mean, p_size * 1e0 AS tenth, (p_partkey * 37 % 360) * 1e0 AS angle, p_size / 60e0 AS rbar, p_retailprice AS low, p_retailprice + p_size * 7 AS high FROM part),
w AS (SELECT *, {_steps("mean", profiles.SLOPES)} AS most, {_steps("tenth", profiles.SLOPES)} AS least, ['north', 'northeast', 'east', 'southeast', 'south', 'southwest', 'west', 'northwest'][CAST(floor(angle / 45 + 0.5e0) AS BIGINT) % 8 + 1] AS wind,
  round_even(low / 100, 0) * 100 AS a1, round_even(high / 100, 0) * 100 AS b1, round_even(low / 10, 0) * 10 AS a2, round_even(high / 10, 0) * 10 AS b2 FROM p),
t AS (SELECT *, CASE WHEN a1 <> b1 THEN a1 WHEN a2 <> b2 THEN a2 ELSE round_even(low, 0) END AS a, CASE WHEN a1 <> b1 THEN b1 WHEN a2 <> b2 THEN b2 ELSE round_even(high, 0) END AS b FROM w)
SELECT p_partkey, CASE WHEN a <> b THEN 'Found from ' || format('{{:,}}', CAST(a AS BIGINT)) || ' to ' || format('{{:,}}', CAST(b AS BIGINT)) ELSE 'Found at ' || format('{{:,}}', CAST(a AS BIGINT)) END || ' m elevation' AS elevation,
  'Often on ' || CASE WHEN least = most THEN CASE most WHEN 'flat' THEN 'flat areas' ELSE most || ' slopes' END ELSE CASE least WHEN 'flat' THEN 'flat areas' ELSE least END || ' to ' || most || ' slopes' END AS slope,
  CASE WHEN rbar > 0.15e0 THEN CASE WHEN rbar > 0.35e0 THEN 'Strongly prefers ' ELSE 'Prefers ' END || wind || '-facing slopes' END AS aspect FROM t""")
def terrain_texts(spark: SparkSession, d: str) -> DataFrame:
    s, low = F.col("p_size"), F.col("p_retailprice")
    p = table(spark, d, "part").withColumns({"high": low + s * 7, "mean": s * 3.0, "tenth": s * 1.0, "angle": (F.col("p_partkey") * 37 % 360) * 1.0, "rbar": s / 60.0})
    return p.select("p_partkey", profiles.elevation_line(low, F.col("high")).alias("elevation"), profiles.slope_line(F.col("mean"), F.col("tenth")).alias("slope"), profiles.aspect_line(F.col("rbar"), F.col("angle"), F.lit(101), F.lit(6.0)).alias("aspect"))


@query(f"""WITH p AS (SELECT p_partkey, p_size * 0.8e0 AS hot, p_size * 0.6e0 - 18 AS cold, p_retailprice / 4 AS wet, CASE WHEN p_size % 3 > 0 THEN p_size * 7e0 END AS snow, p_retailprice AS rain, p_size * 0.25e0 AS nitrogen, p_size * 0.1e0 + 3 AS ph FROM part),
w AS (SELECT *, CASE WHEN hot > 34 THEN 'scorching' WHEN hot > 31 THEN 'very hot' WHEN hot > 29 THEN 'hot' WHEN hot > 27.5e0 THEN 'warm' WHEN hot > 25 THEN 'temperate' WHEN hot > 10 THEN 'cool' ELSE 'cold' END AS h, {_steps("cold", profiles.COLD)} AS c, {_steps("wet * 4", profiles.RAIN)} AS q, {_steps("snow", profiles.SNOW)} AS s, {_steps("rain", profiles.RAIN)} AS r,
  CASE WHEN nitrogen < 1.5e0 THEN 'very nutrient poor' WHEN nitrogen < 2 THEN 'nutrient poor' WHEN nitrogen >= 10 THEN 'very nutrient rich' WHEN nitrogen >= 7 THEN 'nutrient rich' END AS nu, {_steps("ph", profiles.ACID)} AS ac FROM p)
SELECT p_partkey, 'Prefers ' || h || ', ' || q || ' summers and ' || c || ', ' || CASE WHEN s <> 'snow-free' THEN s ELSE q END || ' winters' AS seasons, 'Typically ' || r || ' locations overall' AS year, 'Usually ' || coalesce(nu || ' and ', '') || ac || ' soil' AS soil FROM w""")
def weather_texts(spark: SparkSession, d: str) -> DataFrame:
    s, price = F.col("p_size"), F.col("p_retailprice")
    snow = F.when(s % 3 > 0, s * 7.0)
    seasons, year = profiles.weather_lines(s * 0.8, s * 0.6 - 18, price / 4, price / 4, snow, price)
    return table(spark, d, "part").select("p_partkey", seasons.alias("seasons"), year.alias("year"), profiles.soil_line(s * 0.25, s * 0.1 + 3, F.lit(None).cast("string")).alias("soil"))


@query(None)
def description_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The sections of every taxon; tests hold their parts against what they must say."""
    wording = profiles.Wording([{"id": 1, "group": "forest", "attributes": ["boreal"], "solo": "taiga"}, {"id": 2, "group": "forest", "attributes": ["temperate"]}, {"id": 3, "group": "grassland"}, {"id": 4, "memberships": [{"group": "grassland"}, {"group": "savanna"}]}, {"id": 5, "group": "desert"}])
    f = stats.class_fractions(_rolled(spark, d, "ordinal"), ["taxon_key"], "ordinal")
    lines = profiles.class_lines(f, wording)
    texts = region_texts(spark, d)
    sections = {"locations": texts.select("taxon_key", profiles.text_lines(F.col("text")).alias("lines")), "habitat": lines}
    return profiles.profile(taxa(spark, d), sections)


# names, exports, jobs


@query("""WITH k AS (SELECT DISTINCT replace(lower(p_brand), '#', '_') AS id FROM part WHERE p_brand < 'Brand#4'), a AS (SELECT p_partkey, replace(lower(p_brand), '#', '_') AS id FROM part) SELECT p_partkey, coalesce(k.id, replace(a.id, '_', '')) AS resolved FROM a LEFT JOIN k USING (id)""")
def variable_ids(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")).alias("id"))
    return layers.variable_ids(p.select("p_partkey", "id"), p.where("p_brand < 'Brand#4'").select("id")).select("p_partkey", "resolved")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN 'p' || c_custkey WHEN c_custkey % 3 > 0 THEN 'b' || c_custkey END AS image, CASE WHEN c_custkey % 4 > 0 THEN 'CC BY 4.0' WHEN c_custkey % 3 > 0 THEN 'CC0 1.0' END AS license,
  CASE WHEN c_custkey % 4 > 0 THEN c_name WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS creator FROM customer""")
def image_fields(spark: SparkSession, d: str) -> DataFrame:
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    own = lambda there, letter, license, creator: F.struct(F.when(there, F.concat(F.lit(letter), k)).otherwise("").alias("image"), F.when(there, license).otherwise("").alias("license"), F.when(there, F.col(creator)).alias("creator"), none.alias("holder"), F.lit("").alias("reference"))
    f = naming.image_fields(own(k % 4 > 0, "p", "https://creativecommons.org/licenses/by/4.0/", "c_name"), own(k % 3 > 0, "b", "https://creativecommons.org/publicdomain/zero/1.0/", "c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", f.alias("f")).select("c_custkey", "f.image", "f.license", "f.creator")


@query("""WITH m AS (SELECT o_orderkey AS r, 'c' || o_custkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS id, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'u' || o_orderkey END AS url FROM orders),
l AS (SELECT k, max_by(id, r) AS id, max_by(url, r) FILTER (WHERE url <> ' ') AS url FROM m WHERE id <> '' GROUP BY 1) SELECT 'c' || c_custkey AS taxon_key, coalesce(l.id, c_mktsegment) AS outer_id, l.url AS outer_url FROM customer LEFT JOIN l ON l.k = 'c' || c_custkey""")
def mapping_apply(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    catalog = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("taxon_key"), F.col("c_mktsegment").alias("outer_id"), F.lit(None).cast("string").alias("outer_url"))
    m = table(spark, d, "orders").select(k.alias("row"), F.concat(F.lit("c"), "o_custkey").alias("taxon_key"), F.when(k % 5 == 0, "").otherwise(k.cast("string")).alias("outer_id"), F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit("u"), k)).alias("outer_url"))
    return naming.apply_mapping(catalog, m)


@query("""WITH r AS (SELECT p_type AS file, p_partkey AS r, p_brand AS id, p_name AS name, ['en', 'ENG', 'de'][p_size % 3 + 1] AS language FROM part), o AS (SELECT id, name, min((file, r)) AS place FROM r WHERE language <> 'de' GROUP BY ALL) SELECT id, array_to_string(list(name ORDER BY place), ';') AS names FROM o GROUP BY 1""")
def english_names(spark: SparkSession, d: str) -> DataFrame:
    language = F.element_at(F.array(F.lit("en"), F.lit("ENG"), F.lit("de")), (F.col("p_size") % 3 + 1).cast("int"))
    r = table(spark, d, "part").select(F.col("p_type").alias("file"), F.col("p_partkey").alias("row"), F.col("p_brand").alias("id"), F.col("p_name").alias("vernacularName"), language.alias("language"))
    return exports.english_names(r).select("id", F.array_join("names", ";").alias("names"))


@query(f"WITH {SQL_OBS} SELECT catalog_number, taxon_key, fix(lat, 6) AS lat, fix(lon, 6) AS lon FROM obs")
def catalog_index(spark: SparkSession, d: str) -> DataFrame:
    """As the index is laid out: in ranges of the number, sorted in each."""
    o = observations(spark, d).select("catalog_number", "taxon_key", "lat", "lon")
    return rounded(o.repartitionByRange("catalog_number").sortWithinPartitions("catalog_number"))


@query("WITH h AS (SELECT o_orderdate, o_orderkey FROM orders WHERE o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 1), e AS (SELECT DISTINCT c_mktsegment AS export, date '1995-01-01' + CAST(ascii(c_mktsegment) AS INTEGER) AS s FROM customer) SELECT export FROM e, h WHERE s <> CAST(o_orderdate AS DATE)")
def exports_due(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    history = o.select(F.col("o_orderkey").alias("place"), F.when(F.col("o_orderpriority") == "3-MEDIUM", "NORMAL").otherwise("ABORT").alias("finish_reason"), F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("finished"))
    kept = table(spark, d, "customer").select(F.col("c_mktsegment").alias("export"), F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), F.ascii("c_mktsegment")), "yyyy-MM-dd").alias("own")).distinct()
    both = kept.crossJoin(F.broadcast(exports.last_finished(history)))  # one row
    return exports.due(both.select("export", F.col("own").alias("stamp"), F.col("stamp").alias("last")), F.col("last"))


@query("""WITH i AS (SELECT p_brand AS variable, CAST(n AS BIGINT) AS number, n * 86400 AS s, (n + 1) * 86400 - 3600 AS e FROM (SELECT DISTINCT p_brand FROM part), range(0, 40) r(n)), t AS (SELECT p_brand AS variable, max(p_partkey) * 3600 % 3000000 // 3600 * 3600 AS newest FROM part GROUP BY 1),
a AS (SELECT variable, newest, newest - w * 3600 AS ts FROM t, (SELECT unnest([0, 24, 168, 720]) AS w)) SELECT variable, number, bool_or(ts = newest) AS frontier FROM a JOIN i USING (variable) WHERE ts BETWEEN s AND e GROUP BY ALL""")
def needed_chunks(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    n = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long")))
    index = p.select(F.col("p_brand").alias("variable")).distinct().select("variable", F.lit("chunk").alias("source"), n.alias("number"))
    index = index.select("variable", "source", "number", (F.col("number") * 86400).alias("start"), ((F.col("number") + 1) * 86400 - 3600).alias("end"))
    ends = p.groupBy(F.col("p_brand").alias("variable")).agg((F.floor(F.max("p_partkey") * 3600 % 3_000_000 / 3600) * 3600).alias("ts"))
    return jobs.needed_chunks(index, ends, [24, 168, 720])


@query(f"WITH {SQL_TAXA}, s AS (SELECT ancestor AS taxon_key, count(*) AS n FROM closure GROUP BY 1), u AS (SELECT descendant AS taxon_key, ancestor AS parent FROM closure WHERE distance = 1) SELECT s.taxon_key, s.n FROM s LEFT JOIN u USING (taxon_key) LEFT JOIN s q ON q.taxon_key = u.parent WHERE s.n <= 100 AND (q.n IS NULL OR q.n > 100)")
def fetch_plan(spark: SparkSession, d: str) -> DataFrame:
    t = taxa(spark, d)
    n = hierarchy.closure(t).groupBy(F.col("ancestor").alias("taxon_key")).agg(F.count(F.lit(1)).alias("n"))
    return hierarchy.fetch_plan(n.join(hierarchy.parents(t), "taxon_key"), 100)


@query(_rolled_sql("ratio, angle") + " SELECT taxon_key, fix(CAST(CAST(count(*) AS FLOAT) AS DOUBLE), 2) AS ratio_count, fix(CAST(CAST(max(ratio) AS FLOAT) AS DOUBLE), 2) AS ratio_max, fix(CAST(CAST(min(angle) AS FLOAT) AS DOUBLE), 2) AS angle_min FROM f GROUP BY 1")
def metric_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = stats.matrix(stats.tall(_rolled(spark, d, "ratio", "angle"), "taxon_key", ["ratio", "angle"]), [("ratio", "count"), ("ratio", "max"), ("angle", "min")])
    return rounded(m.select("taxon_key", *(F.col(c).cast("double").alias(c) for c in m.columns[1:])), 2)


@query("""WITH c AS (SELECT DISTINCT p_brand AS place, replace(lower(p_brand), '#', '') AS id, p_brand < 'Brand#3' AS timed FROM part), s AS (SELECT id, row_number() OVER (ORDER BY place) - 1 AS o FROM c WHERE NOT timed AND place > 'Brand#3'), t AS (SELECT id, row_number() OVER (ORDER BY place) - 1 AS i FROM c WHERE timed)
SELECT id, 'continuous' AS domain, o AS sort_order FROM s UNION ALL SELECT id || '_avg_' || w || 'h', 'continuous', 10000 + i * 2 + k FROM t, (VALUES (24, 0), (168, 1)) v(w, k)""")
def archive_metadata(spark: SparkSession, d: str) -> DataFrame:
    b, none = F.col("p_brand"), F.lit(None).cast("string")
    c = table(spark, d, "part").select(b).distinct().select(b.alias("place"), F.replace(F.lower(b), F.lit("#"), F.lit("")).alias("id"), none.alias("name"), F.lit("all").alias("category"), F.lit("ratio").alias("value_type"), F.when(b > "Brand#4", "x.tif").alias("filename"), (b == "Brand#4").alias("derived"), none.alias("aggregate"), F.when(b < "Brand#3", F.array(F.lit(24), F.lit(168))).alias("windows"))
    return layers.metadata(c).select("id", "domain", "sort_order")


@query("SELECT p_partkey, CAST(CASE WHEN p_retailprice >= 1500 THEN 4 WHEN p_retailprice >= 1000 THEN 6 WHEN p_retailprice >= 950 THEN 8 ELSE 9 END AS BIGINT) AS zoom FROM part")
def place_zoom(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", places.zoom_of(F.col("p_retailprice"), [(1500, 4), (1000, 6), (950, 8), (940, 9)]).cast("long").alias("zoom"))


@query(f"WITH {SQL_SAMPLED} SELECT z, x, y, px, py, CASE CAST(floor(value) AS BIGINT) % 5 WHEN 0 THEN 'red' WHEN 2 THEN 'blue' END AS colour FROM v")
def tile_classes(spark: SparkSession, d: str) -> DataFrame:
    colours = spark.createDataFrame([(0, "red"), (1, "green"), (2, "blue")], "class long, colour string")
    v = _sampled(spark, d).withColumn("value", F.col("value").cast("long") % 5)
    return tiles.coloured_classes(v, colours, [0, 2]).select("z", "x", "y", "px", "py", "colour")


@query(f"WITH {SQL_HOURLY}, g AS (SELECT cell, avg(value) AS m FROM hourly GROUP BY 1) SELECT cell, fix(least(50e0, m), 4) AS mean FROM g")
def raster_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rasters.mean_of(rasters.hour_sums(hourly(spark, d), ["cell"]), None, 50).select("cell", "mean"), 4)

"""Queries on the catalog of layers, chunk files, uploads, samples and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lichen.operators import filters, search, stats
from lichen.plans.catalog import _rolled, _rolled_sql, query, rounded
from lichen.sources import layers
from lichen.sources.tables import SQL_OBS, observations, table


@query("""WITH c AS (SELECT DISTINCT replace(lower(p_brand), '#', '') AS id, p_brand FROM part), w AS (SELECT id, unnest([1, 24, 168]) AS hours FROM c WHERE p_brand < 'Brand#3')
SELECT id || '_avg_' || hours || 'h' AS id, id AS variable, hours FROM w UNION ALL SELECT id, id, NULL FROM c WHERE p_brand >= 'Brand#3'""")
def layer_catalog(spark: SparkSession, d: str) -> DataFrame:
    windows = F.when(F.col("p_brand") < "Brand#3", F.array(F.lit(1), F.lit(24), F.lit(168)))
    c = table(spark, d, "part").select("p_brand").distinct()
    return layers.layers(c.select(F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")).alias("id"), F.lit(None).cast("string").alias("aggregate"), windows.alias("windows")))


@query("SELECT p_partkey, p_size % 4 AS class, CASE WHEN p_size % 4 < 3 THEN 'class ' || p_size % 4 END AS name FROM part")
def legend_lookup(spark: SparkSession, d: str) -> DataFrame:
    legend = spark.createDataFrame([("code", 0, "class 0"), ("code", 1, "class 1"), ("code_mode_24h", 2, "class 2"), ("code", 2, "not this")], "layer string, class int, name string")
    values = table(spark, d, "part").select("p_partkey", F.lit("code_mode_24h").alias("layer"), (F.col("p_size") % 4).cast("int").alias("class"))
    return layers.with_legend(values, legend).select("p_partkey", F.col("class").cast("long").alias("class"), "name")


@query("""WITH y AS (SELECT unnest([1995, 1996]) AS year), f AS (SELECT 'year' AS source, CAST(year AS BIGINT) AS number, CAST(epoch(make_date(year, 1, 1)) AS BIGINT) AS start, CAST(epoch(make_date(year + 1, 1, 1)) AS BIGINT) - 3600 AS "end", CAST(0 AS BIGINT) AS "offset" FROM y),
c AS (SELECT CAST(n AS BIGINT) AS number, CAST(n * 504 * 3600 AS BIGINT) AS s, CAST((n + 1) * 504 * 3600 - 3600 AS BIGINT) AS e FROM range(430, 490) r(n)),
k AS (SELECT number, s, e, greatest(s, coalesce((SELECT max("end") FROM f WHERE f.start <= e AND f."end" >= s) + 3600, s)) AS b FROM c)
SELECT * FROM f UNION ALL SELECT 'chunk', number, b, e, (b - s) // 3600 FROM k WHERE b <= e""")
def chunk_index(spark: SparkSession, d: str) -> DataFrame:
    years = spark.createDataFrame([(1995,), (1996,)], "year int")
    found = layers.chunk_index(spark.range(430, 490).withColumnRenamed("id", "number"), years, 504, 3600)
    return found.withColumn("number", F.col("number").cast("long"))


@query("SELECT o_orderkey, CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) + CASE o_orderkey % 4 WHEN 0 THEN 43200 WHEN 1 THEN 43200 WHEN 2 THEN 18000 ELSE NULL END AS ts FROM orders")
def upload_time(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "M/d/yyyy")).when(k == 2, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T05:00:00"))).otherwise("NaN")
    return table(spark, d, "orders").select("o_orderkey", layers.upload_time(text).alias("ts"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'Observation #' || row_number() OVER (ORDER BY c_custkey) END AS observation_name FROM customer")
def observation_names(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, " ").alias("given"))
    return layers.observation_names(c, "given", "c_custkey").select("c_custkey", "observation_name")


@query(f"WITH {SQL_OBS} SELECT catalog_number FROM obs WHERE (ratio BETWEEN 1000 AND 90000) AND (angle BETWEEN 350 AND 360 OR angle BETWEEN 0 AND 90) AND nominal IN (79, 70)")
def parsed_filters(spark: SparkSession, d: str) -> DataFrame:
    asked = '[{"variable": "ratio", "min": 90000, "max": 1000}, {"variable": "angle", "ranges": [{"min": 350, "max": 90}]}, {"variable": "nominal", "class_values": [79, 70]}]'
    return filters.chained(observations(spark, d), layers.conditions(asked, {"ratio": False, "angle": True, "nominal": False})).select("catalog_number")


@query(_rolled_sql("catalog_number") + " SELECT taxon_key, CAST(least(count(*), 20) AS BIGINT) AS n FROM f GROUP BY 1")
def group_samples(spark: SparkSession, d: str) -> DataFrame:
    s = stats.sample(_rolled(spark, d, "catalog_number"), ["taxon_key"], "catalog_number", 20)
    return s.groupBy("taxon_key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, fix(-((0.5e0 * ln(0.5e0) + 0.25e0 * ln(0.25e0)) / 2 * (n_nationkey + 1) + 0.25e0 * ln(0.25e0) / 2 * 2), 6) AS entropy FROM nation")
def curve_entropy(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("double")
    points, density = F.array(F.lit(0.0), k + 1, k + 3), F.array(F.lit(0.5), F.lit(0.25), F.lit(0.0))
    return rounded(table(spark, d, "nation").select("n_nationkey", stats.curve_entropy(points, density).alias("entropy")))


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("taxon_key"), F.col("p_name").alias("name"))


@query(None)
def text_page(spark: SparkSession, d: str) -> DataFrame:
    return search.text_page(_names(spark, d), "red wid", 5, 10)


@query(None)
def ranked_text_page(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("taxon_key"), F.col("p_retailprice").alias("value"))
    return search.ranked_text_page(_names(spark, d), values, "red wid", 0, 10, descending=True)

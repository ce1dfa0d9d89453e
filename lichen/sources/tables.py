"""Tables of a folder, and the star-schema stand-ins for taxa, observations and hourly series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def taxa(spark: SparkSession, folder: str) -> DataFrame:
    """(taxon_key, path, rank, name): region, nation and customer as three ranks; a path holds Name_key segments."""
    r, n, c = (table(spark, folder, t) for t in ("region", "nation", "customer"))
    seg = lambda name, letter, key: F.concat(F.col(name), F.lit(f"_{letter}"), F.col(key))
    rs = r.select("r_regionkey", "r_name", seg("r_name", "r", "r_regionkey").alias("rp"))
    ns = n.join(F.broadcast(rs), n["n_regionkey"] == rs["r_regionkey"]).withColumn("np", F.concat_ws("/", "rp", seg("n_name", "n", "n_nationkey")))
    cs = c.join(F.broadcast(ns), c["c_nationkey"] == ns["n_nationkey"]).withColumn("cp", F.concat_ws("/", "np", seg("c_name", "c", "c_custkey")))
    row = lambda d, letter, key, path, rank, name: d.select(F.concat(F.lit(letter), key).alias("taxon_key"), F.col(path).alias("path"), F.lit(rank).alias("rank"), F.col(name).alias("name"))
    return row(rs, "r", "r_regionkey", "rp", "KINGDOM", "r_name").unionByName(row(ns, "n", "n_nationkey", "np", "FAMILY", "n_name")).unionByName(row(cs, "c", "c_custkey", "cp", "SPECIES", "c_name"))


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as observations of customers: places by arithmetic on the key, one variable of each scale."""
    o = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("c"), "o_custkey").alias("taxon_key"),
        k.alias("catalog_number"),
        ((k * 37 % 18000) / F.lit(100.0) - 90).alias("lat"),
        ((k * 91 % 36000) / F.lit(100.0) - 180).alias("lon"),
        F.unix_timestamp("o_orderdate").alias("ts"),
        F.when(k % 7 == 0, "Obscured").when(k % 7 == 1, "Hidden").otherwise("No").alias("obscured"),
        F.when(k % 5 != 0, (k % 11 * 100).cast("double")).alias("uncertainty"),
        F.col("o_totalprice").alias("ratio"),
        F.floor(F.col("o_totalprice") / 10000).cast("long").alias("discrete"),
        F.ascii("o_orderstatus").cast("long").alias("nominal"),
        F.substring("o_orderpriority", 1, 1).cast("long").alias("ordinal"),
        (F.dayofyear("o_orderdate") * F.lit(360.0) / F.lit(365.0)).alias("angle"),
        F.concat(F.lower("o_orderstatus"), F.lit(" | "), F.col("o_orderpriority")).alias("states"),
        F.when(k % 4 != 0, F.concat(F.lit("g"), k % 9)).alias("level0"),
        F.when(k % 4 == 1, F.concat(F.lit("g"), k % 9, F.lit("."), k % 3)).alias("level1"),
        F.when(k % 8 != 0, F.concat(F.lit("area"), k % 3)).otherwise("").alias("region"),
    )


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """(cell, hour, value): events of 20 cells as an hourly series with gaps."""
    e = table(spark, folder, "events")
    hour = F.floor(F.unix_timestamp(F.date_trunc("hour", "ts")) / 3600).cast("long")
    return e.groupBy((F.col("user_id") % 20).alias("cell"), hour.alias("hour")).agg(F.round(F.sum("value"), 2).alias("value"))


SQL_TAXA = """taxa AS (
  SELECT 'r' || r_regionkey AS taxon_key, r_name || '_r' || r_regionkey AS path, 'KINGDOM' AS rank, r_name AS name FROM region
  UNION ALL SELECT 'n' || n_nationkey, r_name || '_r' || r_regionkey || '/' || n_name || '_n' || n_nationkey, 'FAMILY', n_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'c' || c_custkey, r_name || '_r' || r_regionkey || '/' || n_name || '_n' || n_nationkey || '/' || c_name || '_c' || c_custkey, 'SPECIES', c_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
closure AS (
  SELECT 'r' || r_regionkey AS ancestor, 'r' || r_regionkey AS descendant, 0 AS distance FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'n' || n_nationkey, 0 FROM nation
  UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 1 FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'c' || c_custkey, 0 FROM customer
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 1 FROM customer
  UNION ALL SELECT 'r' || n_regionkey, 'c' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

SQL_OBS = """obs AS (
  SELECT 'c' || o_custkey AS taxon_key, o_orderkey AS catalog_number, (o_orderkey * 37 % 18000) / 100e0 - 90 AS lat, (o_orderkey * 91 % 36000) / 100e0 - 180 AS lon,
    CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts, CASE o_orderkey % 7 WHEN 0 THEN 'Obscured' WHEN 1 THEN 'Hidden' ELSE 'No' END AS obscured,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 11 * 100 AS DOUBLE) END AS uncertainty, o_totalprice AS ratio, CAST(floor(o_totalprice / 10000e0) AS BIGINT) AS discrete,
    CAST(ascii(o_orderstatus) AS BIGINT) AS nominal, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS ordinal, dayofyear(o_orderdate) * 360e0 / 365e0 AS angle,
    lower(o_orderstatus) || ' | ' || o_orderpriority AS states, CASE WHEN o_orderkey % 4 <> 0 THEN 'g' || (o_orderkey % 9) END AS level0,
    CASE WHEN o_orderkey % 4 = 1 THEN 'g' || (o_orderkey % 9) || '.' || (o_orderkey % 3) END AS level1, CASE WHEN o_orderkey % 8 <> 0 THEN 'area' || (o_orderkey % 3) ELSE '' END AS region
  FROM orders)"""

SQL_HOURLY = """hourly AS (
  SELECT user_id % 20 AS cell, CAST(floor(epoch(date_trunc('hour', ts)) / 3600) AS BIGINT) AS hour, round(sum(value), 2) AS value FROM events GROUP BY 1, 2)"""

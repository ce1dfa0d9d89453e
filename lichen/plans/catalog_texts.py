"""Queries on texts, colours, point lookups and derived windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lichen.functions import geo, sentences, units, weather
from lichen.operators import hierarchy, stats, timeseries
from lichen.plans.catalog import _CLASS, _rolled, _rolled_sql, query, rounded
from lichen.sources.tables import SQL_HOURLY, SQL_OBS, SQL_TAXA, hourly, observations, table, taxa


@query(f"WITH {SQL_TAXA} SELECT taxon_key, CASE WHEN contains(path, '/') THEN regexp_replace(string_split(path, '/')[-2], '_[^_]*$', '') END AS parent FROM taxa")
def parent_name(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split("path", "/")
    parent = F.when(F.size(parts) > 1, F.regexp_replace(F.element_at(F.concat(F.array(F.lit("")), parts), -2), "_[^_]*$", ""))
    return taxa(spark, d).select("taxon_key", parent.alias("parent"))


@query(f"WITH {SQL_TAXA} SELECT a.rank AS rank, b.rank AS target, count(*) AS n FROM closure JOIN taxa a ON a.taxon_key = ancestor JOIN taxa b ON b.taxon_key = descendant WHERE distance > 0 GROUP BY ALL")
def rank_targets(spark: SparkSession, d: str) -> DataFrame:
    t = taxa(spark, d)
    c = hierarchy.closure(t).where("distance > 0")
    own, other = t.select(F.col("taxon_key").alias("ancestor"), "rank"), t.select(F.col("taxon_key").alias("descendant"), F.col("rank").alias("target"))
    return c.join(own, "ancestor").join(other, "descendant").groupBy("rank", "target").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SQL_TAXA} SELECT taxon_key, coalesce(nullif(name, ''), taxon_key) AS label FROM closure JOIN taxa ON taxon_key = descendant WHERE ancestor = 'n3' AND rank = 'SPECIES'")
def scope_members(spark: SparkSession, d: str) -> DataFrame:
    t = taxa(spark, d)
    members = hierarchy.closure(t).where("ancestor = 'n3'").select(F.col("descendant").alias("taxon_key"))
    return t.where("rank = 'SPECIES'").join(members, "taxon_key").select("taxon_key", F.coalesce(F.when(F.col("name") != "", F.col("name")), F.col("taxon_key")).alias("label"))


@query(f"WITH {SQL_OBS} SELECT catalog_number, taxon_key, fix(lat, 6) AS lat, fix(lon, 6) AS lon FROM obs WHERE catalog_number = 4711")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return rounded(observations(spark, d).where("catalog_number = 4711").select("catalog_number", "taxon_key", "lat", "lon"))


@query("SELECT o_orderkey, fix(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice WHEN o_orderkey % 5 = 0 THEN o_totalprice / 2 ELSE p_retailprice END, 4) AS value FROM orders LEFT JOIN part ON p_partkey = o_orderkey % 300")
def point_value(spark: SparkSession, d: str) -> DataFrame:
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    o = table(spark, d, "orders").select("o_orderkey", F.when(k % 3 == 0, v).alias("own"), F.when(k % 5 == 0, v / 2).alias("past"), (k % 300).alias("p_partkey"))
    raster = table(spark, d, "part").select(F.col("p_partkey"), F.col("p_retailprice").alias("cell_value"))
    return rounded(o.join(raster, "p_partkey", "left").select("o_orderkey", F.coalesce("own", "past", "cell_value").alias("value")), 4)


@query(f"""WITH {SQL_HOURLY}, m AS (SELECT a.cell, a.hour, avg(b.value) % 40 AS t FROM hourly a JOIN hourly b ON a.cell = b.cell AND b.hour BETWEEN a.hour - 23 AND a.hour GROUP BY ALL)
SELECT cell, hour, fix(0.6108e0 * exp(17.27e0 * t / (t + 237.3e0)) - 0.6108e0 * exp(17.27e0 * (t / 2) / (t / 2 + 237.3e0)), 5) AS vpd FROM m""")
def vpd_of_means(spark: SparkSession, d: str) -> DataFrame:
    m = timeseries.trailing(hourly(spark, d), 24).withColumn("t", F.col("sum") / F.col("n") % 40)
    return rounded(m.select("cell", "hour", weather.vpd(F.col("t"), F.col("t") / 2).alias("vpd")), 5)


@query(_rolled_sql("ordinal") + """, c AS (SELECT taxon_key, ordinal AS k, count(*) AS n FROM f GROUP BY ALL), p AS (SELECT taxon_key, k, n / sum(n) OVER (PARTITION BY taxon_key) AS x FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY taxon_key ORDER BY x DESC, k) AS r, count(*) OVER (PARTITION BY taxon_key) AS m FROM p),
s AS (SELECT taxon_key, max(m) AS m, list('class ' || k || ' (' || CAST(floor(x * 100 + 0.5e0) AS INTEGER) || ' %)' ORDER BY r) AS l FROM r WHERE r <= 3 GROUP BY 1)
SELECT taxon_key, 'Found mostly in ' || CASE len(l) WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' and ' || l[2] ELSE l[1] || ', ' || l[2] || ' and ' || l[3] END || CASE WHEN m > 3 THEN ', and ' || (m - 3) || ' more' ELSE '' END || '.' AS text FROM s""")
def class_sentence(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    x = stats.class_fractions(_rolled(spark, d, "ordinal"), ["taxon_key"], "ordinal")
    w = Window.partitionBy("taxon_key")
    r = x.withColumns({"r": F.row_number().over(w.orderBy(F.desc("fraction"), "class")), "m": F.count(F.lit(1)).over(w)}).where("r <= 3")
    named = F.struct("r", F.concat(F.lit("class "), F.col("class").cast("string")).alias("name"), "fraction")
    g = r.groupBy("taxon_key").agg(F.array_sort(F.collect_list(named)).alias("c"), F.max("m").alias("m"))
    return g.select("taxon_key", sentences.shares(F.col("c"), F.col("m") - 3).alias("text"))


@query("""WITH h AS (SELECT p_partkey, (p_size * 137 % 360) / 60e0 AS h FROM part), k AS (SELECT p_partkey, [(h + 5) % 6, (h + 3) % 6, (h + 1) % 6] AS k FROM h),
c AS (SELECT p_partkey, list_transform(k, lambda x: CAST(floor((0.92e0 - 0.598e0 * greatest(0e0, least(x, 4 - x, 1e0))) * 255 + 1e-9) AS BIGINT)) AS c FROM k) SELECT p_partkey, c[1] AS red, c[2] AS green, c[3] AS blue FROM c""")
def fallback_colour(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", *(c.alias(n) for n, c in sentences.fallback_rgb(F.col("p_size").cast("int")).items()))


@query(f"WITH g AS (SELECT i, j, i * 100e0 / 24 AS sand, j * 100e0 / 24 AS silt, (24 - i - j) * 100e0 / 24 AS clay FROM range(25) a(i), range(25) b(j) WHERE i + j <= 24) SELECT i, j, {_CLASS} AS class FROM g")
def ternary_classes(spark: SparkSession, d: str) -> DataFrame:
    i, j = spark.range(25).withColumnRenamed("id", "i"), F.explode(F.sequence(F.lit(0).cast("long"), 24 - F.col("i")))
    g = i.select("i", j.alias("j"))
    share = lambda c: c * 100.0 / 24
    return g.select("i", "j", geo.texture_class(share(F.col("i")), share(F.col("j")), share(24 - F.col("i") - F.col("j"))).alias("class"))


@query(_rolled_sql("catalog_number, ratio") + " SELECT taxon_key, fix(avg(ratio) * 1.8e0 + 32, 4) AS mean, fix(max(ratio) * 1.8e0 + 32, 4) AS max, fix((max(ratio) - min(ratio)) * 1.8e0, 4) AS range FROM f GROUP BY 1")
def summary_convert(spark: SparkSession, d: str) -> DataFrame:
    s = stats.continuous(_rolled(spark, d, "catalog_number", "ratio"), ["taxon_key"], "ratio")
    return rounded(s.select("taxon_key", *(units.convert(F.col(m), "°C", m).alias(m) for m in ("mean", "max", "range"))), 4)


@query(_rolled_sql("ordinal") + """, c AS (SELECT taxon_key, ordinal AS k, count(*) AS n FROM f GROUP BY ALL), p AS (SELECT taxon_key, k, n / sum(n) OVER (PARTITION BY taxon_key) AS x FROM c)
SELECT taxon_key, count(*) FILTER (WHERE x >= 0.05e0) AS common, count(*) AS present FROM p GROUP BY 1""")
def common_classes(spark: SparkSession, d: str) -> DataFrame:
    x = stats.class_fractions(_rolled(spark, d, "ordinal"), ["taxon_key"], "ordinal")
    return x.groupBy("taxon_key").agg(F.count(F.when(F.col("fraction") >= 0.05, 1)).alias("common"), F.count(F.lit(1)).alias("present"))


@query(f"WITH {SQL_OBS} SELECT taxon_key, min(ts) AS first, max(ts) AS last, count(*) AS n FROM obs WHERE obscured = 'No' AND (uncertainty IS NULL OR uncertainty <= 500) GROUP BY 1")
def species_occurrences(spark: SparkSession, d: str) -> DataFrame:
    from lichen.operators import filters

    return filters.good_quality(observations(spark, d)).groupBy("taxon_key").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))

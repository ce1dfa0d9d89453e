"""name -> (Spark query, DuckDB SQL or None)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lichen.functions import geo, text, units, weather
from lichen.operators import density, filters, hierarchy, incremental, ranking, search, stats, timeseries
from lichen.sources.session import ship
from lichen.sources.tables import SQL_HOURLY, SQL_OBS, SQL_TAXA, hourly, observations, table, taxa
from lichen.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}
GOOD = "obscured = 'No' AND (uncertainty IS NULL OR uncertainty <= 500)"


def query(sql: str | None, name: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return f(spark, folder)

        CATALOG[name or f.__name__] = (run, _spelled(sql) if sql else None)
        return f

    return add


def fixed(c: Column, places: int = 6) -> Column:
    """A double as compared: rounded with the border a little off the half, where no short decimal lies; last bits that
    differ between two ways of adding up don't move it then. ``fix(x, n)`` in the SQL is the same."""
    return F.floor(c * float(10**places) + 0.5003) / F.lit(float(10**places))


def rounded(df: DataFrame, places: int = 6, **own: int) -> DataFrame:
    return df.select(*(fixed(F.col(c), own.get(c, places)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _spelled(sql: str) -> str:
    """fix(x, n) written out, innermost last."""
    while (at := sql.rfind("fix(")) >= 0:
        depth, i = 1, at + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        x, places = sql[at + 4 : i - 1].rsplit(",", 1)
        scale = f"{10 ** int(places)}e0"
        sql = f"{sql[:at]}(floor(({x}) * {scale} + 0.5003e0) / {scale}){sql[i:]}"
    return sql


def _continuous_sql(rows: str, by: str, v: str) -> str:
    q = lambda p: f"quantile_cont({v}, {p})"
    sd = f"coalesce(stddev_samp({v}), 0)"
    parts = {name: q(p) for name, p in stats.POINTS} | {"min": f"min({v})", "max": f"max({v})", "mean": f"avg({v})", "std": sd, "variance": f"{sd} * {sd}", "iqr": f"{q(0.75)} - {q(0.25)}", "10_90_range": f"{q(0.9)} - {q(0.1)}", "range": f"max({v}) - min({v})"}
    return f"SELECT {by}, count(*) AS count, count(DISTINCT catalog_number) AS unique_samples, " + ", ".join(f'fix({e}, {0 if n == "variance" else 6}) AS "{n}"' for n, e in parts.items()) + f" FROM {rows} GROUP BY {by}"


@query(f"WITH {SQL_TAXA}, {SQL_OBS}, f AS (SELECT ancestor AS taxon_key, catalog_number, ratio FROM obs JOIN closure ON taxon_key = descendant WHERE {GOOD}) " + _continuous_sql("f", "taxon_key", "ratio"))
def stats_continuous_rollup(spark: SparkSession, d: str) -> DataFrame:
    facts = filters.good_quality(observations(spark, d)).select("taxon_key", "catalog_number", "ratio")
    return rounded(stats.continuous(stats.by_ancestor(facts, hierarchy.closure(taxa(spark, d))), ["taxon_key"], "ratio"), variance=0)


@query(f"WITH {SQL_OBS} " + _continuous_sql(f"(SELECT * FROM obs WHERE {GOOD})", "taxon_key", "ratio"))
def stats_leaf_continuous(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.continuous(filters.good_quality(observations(spark, d)), ["taxon_key"], "ratio"), variance=0)


def _rolled(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    facts = filters.good_quality(observations(spark, d)).select("taxon_key", *columns)
    return stats.by_ancestor(facts, hierarchy.closure(taxa(spark, d)))


def _rolled_sql(columns: str) -> str:
    return f"WITH {SQL_TAXA}, {SQL_OBS}, f AS (SELECT ancestor AS taxon_key, {columns} FROM obs JOIN closure ON taxon_key = descendant WHERE {GOOD})"


@query(_rolled_sql("discrete") + """, c AS (SELECT taxon_key, discrete AS k, count(*) AS n FROM f GROUP BY ALL), b AS (SELECT taxon_key, sum(n) AS t, unnest(range(min(k), max(k) + 1)) AS bin FROM c GROUP BY taxon_key)
SELECT b.taxon_key, CAST(b.bin AS BIGINT) AS bin, CAST(coalesce(n, 0) AS BIGINT) AS n, fix(coalesce(n, 0) / t, 6) AS fraction FROM b LEFT JOIN c ON b.taxon_key = c.taxon_key AND b.bin = c.k""")
def stats_discrete_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.histogram(_rolled(spark, d, "discrete"), ["taxon_key"], "discrete"))


@query(_rolled_sql("nominal") + """, c AS (SELECT taxon_key, nominal AS k, count(*) AS n FROM f GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY taxon_key) AS t FROM c)
SELECT taxon_key, CAST(sum(n) AS BIGINT) AS total_samples, count(*) AS unique_classes, fix(-sum(n / t * ln(n / t)), 6) + 0 AS entropy, arg_min(k, -n * 1000 + k) AS mode FROM t GROUP BY taxon_key""")
def stats_nominal(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.nominal(_rolled(spark, d, "nominal"), ["taxon_key"], "nominal"))


@query(_rolled_sql("nominal") + """, c AS (SELECT taxon_key, nominal AS k, count(*) AS n FROM f GROUP BY ALL)
SELECT taxon_key, k AS class, n, fix(n / sum(n) OVER (PARTITION BY taxon_key), 6) AS fraction FROM c""")
def stats_nominal_fractions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.class_fractions(_rolled(spark, d, "nominal"), ["taxon_key"], "nominal"))


@query(_rolled_sql("ordinal") + """, c AS (SELECT taxon_key, ordinal AS k, count(*) AS n FROM f GROUP BY ALL), e AS (SELECT *, sum(n) OVER (PARTITION BY taxon_key ORDER BY k) AS e, sum(n) OVER (PARTITION BY taxon_key) AS t FROM c)
SELECT taxon_key, CAST(max(t) AS BIGINT) AS total_samples, min(k) FILTER (WHERE e >= 0.1e0 * t) AS "10th_percentile", min(k) FILTER (WHERE e >= 0.25e0 * t) AS "25th_percentile", min(k) FILTER (WHERE e >= 0.5e0 * t) AS median,
min(k) FILTER (WHERE e >= 0.75e0 * t) AS "75th_percentile", min(k) FILTER (WHERE e >= 0.9e0 * t) AS "90th_percentile" FROM e GROUP BY taxon_key""")
def stats_ordinal(spark: SparkSession, d: str) -> DataFrame:
    return stats.ordinal(_rolled(spark, d, "ordinal"), ["taxon_key"], "ordinal")


@query(_rolled_sql("angle") + """, m AS (SELECT taxon_key, count(*) AS count, avg(cos(radians(angle))) AS c, avg(sin(radians(angle))) AS s FROM f GROUP BY 1), r AS (SELECT *, least(sqrt(c * c + s * s), 1) AS r FROM m)
SELECT taxon_key, count, fix(r, 6) AS rbar, fix(degrees(atan2(s, c)) - 360 * floor(degrees(atan2(s, c)) / 360), 6) AS circular_mean, fix(1 - r, 6) + 0 AS circular_var, fix(degrees(sqrt(-2 * ln(greatest(r, 1e-10)))), 2) AS circular_std FROM r""")
def stats_circular(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.circular(_rolled(spark, d, "angle"), ["taxon_key"], "angle"), circular_std=2)


@query(_rolled_sql("catalog_number, ratio") + " SELECT taxon_key, count(DISTINCT catalog_number) AS unique_samples FROM f WHERE ratio IS NOT NULL GROUP BY 1")
def unique_samples(spark: SparkSession, d: str) -> DataFrame:
    return _rolled(spark, d, "catalog_number", "ratio").where("ratio IS NOT NULL").groupBy("taxon_key").agg(F.count_distinct("catalog_number").alias("unique_samples"))


@query(_rolled_sql("states") + ", s AS (SELECT taxon_key, trim(unnest(string_split(lower(states), '|'))) AS value FROM f) SELECT taxon_key, value, count(*) AS n FROM s WHERE value <> '' GROUP BY ALL")
def phenology_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.list_counts(_rolled(spark, d, "states"), ["taxon_key"], "states")


@query(f"WITH {SQL_TAXA}, {SQL_OBS}, g AS (SELECT taxon_key, 'level0' AS scope, level0 AS gid FROM obs UNION ALL SELECT taxon_key, 'level1', level1 FROM obs UNION ALL SELECT taxon_key, 'region', region FROM obs) SELECT scope, gid, ancestor, CAST(count(*) AS BIGINT) AS n FROM g JOIN closure ON taxon_key = descendant WHERE coalesce(gid, '') <> '' GROUP BY ALL")
def location_rollup(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d).select("taxon_key", F.expr("stack(3, 'level0', level0, 'level1', level1, 'region', region) AS (scope, gid)")).where("coalesce(gid, '') <> ''").withColumn("n", F.lit(1).cast("long"))
    return hierarchy.roll_up(o, hierarchy.closure(taxa(spark, d)), ["scope", "gid"], "n")


@query(f"WITH {SQL_TAXA} SELECT ancestor, descendant, distance FROM closure")
def closure_table(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.closure(taxa(spark, d))


@query(f"WITH {SQL_TAXA} SELECT t.taxon_key, c.ancestor AS parent_key FROM taxa t LEFT JOIN closure c ON t.taxon_key = c.descendant AND c.distance = 1")
def self_child_join(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.parents(taxa(spark, d))


@query("SELECT 'r' || r_regionkey AS taxon_key, '' AS chain FROM region UNION ALL SELECT 'n' || n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'c' || c_custkey, r_name || ' > ' || n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def ancestor_chain(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.ancestor_names(taxa(spark, d))


@query(f"WITH {SQL_TAXA}, v AS (SELECT taxon_key AS descendant, name AS v FROM taxa WHERE rank = 'SPECIES' AND taxon_key LIKE '%3'), j AS (SELECT ancestor, v, distance, descendant FROM closure JOIN v USING (descendant)) SELECT ancestor AS taxon_key, v AS image FROM j QUALIFY row_number() OVER (PARTITION BY ancestor ORDER BY distance, descendant) = 1")
def image_propagation(spark: SparkSession, d: str) -> DataFrame:
    nodes = taxa(spark, d).withColumn("image", F.when((F.col("rank") == "SPECIES") & F.col("taxon_key").endswith("3"), F.col("name")))
    return hierarchy.propagate_up(nodes, hierarchy.closure(nodes), "image")


@query("SELECT 'n' || c_nationkey AS parent_key, 'x' || min(c_custkey % 3) AS inferred FROM customer WHERE c_custkey % 50 < 2 GROUP BY 1 HAVING count(DISTINCT c_custkey % 3) = 1")
def children_agree(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    ids = c.select(F.concat(F.lit("n"), "c_nationkey").alias("parent_key"), F.when(F.col("c_custkey") % 50 < 2, F.col("c_custkey")).alias("outer_id"))
    outer = c.select(F.col("c_custkey").alias("outer_id"), F.concat(F.lit("x"), F.col("c_custkey") % 3).alias("outer_parent"))
    return hierarchy.agreed_parent(ids, outer)


# filters


@query(f"WITH {SQL_OBS} SELECT catalog_number FROM obs WHERE {GOOD}")
def quality_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.good_quality(observations(spark, d)).select("catalog_number")


@query(f"WITH {SQL_TAXA} SELECT taxon_key FROM taxa WHERE path = 'AFRICA_r0' OR starts_with(path, 'AFRICA_r0/') OR path = 'ASIA_r2' OR starts_with(path, 'ASIA_r2/')")
def scope_subtree(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.subtree(taxa(spark, d), ["AFRICA_r0", "ASIA_r2"]).select("taxon_key")


@query(f"WITH {SQL_TAXA} SELECT taxon_key FROM taxa WHERE starts_with(path, 'AFRICA_r0/')")
def request_scope_by_rank(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.request_scope(taxa(spark, d), "AFRICA_r0", "KINGDOM")


@query(f"WITH {SQL_OBS} SELECT catalog_number FROM obs WHERE list_contains(list_transform(string_split(lower(states), '|'), lambda x: trim(x)), '2-high')")
def phenology_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.has_state(observations(spark, d), " 2-HIGH ").select("catalog_number")


@query(f"WITH {SQL_OBS} SELECT catalog_number, ts FROM obs WHERE ts >= 852076800 AND ts <= 883612800")
def time_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.in_time(observations(spark, d), 852076800, 883612800).select("catalog_number", "ts")


@query(f"WITH {SQL_OBS} SELECT catalog_number FROM obs WHERE (angle >= 300 AND angle <= 360) OR (angle >= 0 AND angle <= 45)")
def range_filter_wrap(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).where(filters.between("angle", 300, 45, wraps=True)).select("catalog_number")


@query(f"WITH {SQL_OBS} SELECT catalog_number FROM obs WHERE nominal IN (70, 79) AND ((ratio >= 1000 AND ratio <= 90000) OR (ratio >= 200000 AND ratio <= 300000)) AND ordinal >= 2 AND ordinal <= 4")
def chained_filters(spark: SparkSession, d: str) -> DataFrame:
    conditions = [{"variable": "nominal", "class_values": [70, 79]}, {"variable": "ratio", "ranges": [(1000, 90000), (200000, 300000)]}, {"variable": "ordinal", "min": 4, "max": 2}]
    return filters.chained(observations(spark, d), conditions).select("catalog_number")


@query(f"WITH {SQL_OBS} SELECT catalog_number FROM obs WHERE lat > 10.005 AND lat < 40.005 AND lon > -20.005 AND lon < 60.005")
def polygon_filter(spark: SparkSession, d: str) -> DataFrame:
    ring = [(10.005, -20.005), (10.005, 60.005), (40.005, 60.005), (40.005, -20.005)]
    return observations(spark, d).where(filters.in_polygon(F.col("lat"), F.col("lon"), [ring])).select("catalog_number")


@query(f"WITH {SQL_OBS} SELECT catalog_number, lat, lon, ratio AS value FROM obs WHERE level0 = 'g2' AND {GOOD} ORDER BY catalog_number LIMIT 200")
def slice_page(spark: SparkSession, d: str) -> DataFrame:
    return filters.page(filters.located(filters.good_quality(observations(spark, d)), "g2", 0), "ratio", 200)


@query(f"WITH {SQL_OBS} SELECT catalog_number, lat, lon, nominal AS value FROM obs WHERE nominal = 80 ORDER BY catalog_number LIMIT 100")
def class_samples(spark: SparkSession, d: str) -> DataFrame:
    return filters.page(filters.chained(observations(spark, d), [{"variable": "nominal", "class_value": 80}]), "nominal", 100)


@query(f"WITH {SQL_OBS} SELECT count(*) > 0 AND NOT coalesce(bool_or(obscured = 'No'), false) AS all_obscured FROM obs WHERE taxon_key = 'c3'")
def all_obscured(spark: SparkSession, d: str) -> DataFrame:
    return filters.all_obscured(taxa(spark, d).where("taxon_key = 'c3'").select("taxon_key"), observations(spark, d))


@query(f"WITH {SQL_TAXA}, {SQL_OBS}, f AS (SELECT 'AFRICA' AS scope, obs.* FROM obs JOIN closure ON taxon_key = descendant WHERE ancestor = 'r0' AND {GOOD} AND region = 'area1' AND ts >= 852076800 AND ordinal >= 2) " + _continuous_sql("f", "scope", "ratio"))
def filtered_stats(spark: SparkSession, d: str) -> DataFrame:
    scope = hierarchy.subtree(taxa(spark, d), ["AFRICA_r0"]).select("taxon_key")
    rows = filters.in_time(filters.located(filters.good_quality(observations(spark, d)), "area1", None), 852076800)
    rows = filters.chained(rows, [{"variable": "ordinal", "min": 2}]).join(scope, "taxon_key", "left_semi")
    return rounded(stats.continuous(rows.withColumn("scope", F.lit("AFRICA")), ["scope"], "ratio"), variance=0)


@query(f"WITH {SQL_OBS} SELECT taxon_key, arg_min(catalog_number, ts * 1000000 + catalog_number) AS catalog_number FROM obs GROUP BY 1")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    return filters.first_of_each(observations(spark, d), "taxon_key", ["ts", "catalog_number"]).select("taxon_key", "catalog_number")


# ranking

_VALUES = f"v AS (SELECT taxon_key, 'SPECIES' AS rank, 'ratio' AS variable, 'median' AS metric, round(quantile_cont(ratio, 0.5), 6) AS value, count(*) AS samples FROM obs WHERE {GOOD} GROUP BY 1)"
_POSITIONS = f"WITH {SQL_TAXA}, {SQL_OBS}, {_VALUES}, p AS (SELECT ancestor, rank, variable, metric, taxon_key, value, rank() OVER (PARTITION BY ancestor ORDER BY value) - 1 AS position, count(*) OVER (PARTITION BY ancestor) AS count FROM v JOIN closure ON taxon_key = descendant AND distance > 0 WHERE samples >= 5)"


def _positions(spark: SparkSession, d: str) -> DataFrame:
    v = filters.good_quality(observations(spark, d)).groupBy("taxon_key").agg(F.round(F.percentile("ratio", F.lit(0.5)), 6).alias("value"), F.count(F.lit(1)).alias("samples"))
    v = v.withColumns({"rank": F.lit("SPECIES"), "variable": F.lit("ratio"), "metric": F.lit("median")})
    return ranking.rank_positions(v, hierarchy.closure(taxa(spark, d)), 5)


@query(_POSITIONS + " SELECT * FROM p")
def rank_positions(spark: SparkSession, d: str) -> DataFrame:
    return _positions(spark, d)


@query(_POSITIONS + " SELECT ancestor, taxon_key, round((position + 1) / count, 3) AS relative FROM p")
def relative_ranks(spark: SparkSession, d: str) -> DataFrame:
    return _positions(spark, d).select("ancestor", "taxon_key", ranking.relative_rank(F.col("position"), F.col("count")).alias("relative"))


_FRACTIONS = f"cf AS (SELECT taxon_key, count(*) FILTER (WHERE nominal = 80) / count(*) AS value, count(*) AS samples FROM obs WHERE {GOOD} GROUP BY 1 HAVING count(*) >= 5)"


@query(f"WITH {SQL_TAXA}, {SQL_OBS}, {_FRACTIONS}, p AS (SELECT ancestor, taxon_key, round(value, 6) AS value, rank() OVER (PARTITION BY ancestor ORDER BY round(value, 6)) - 1 AS position, count(*) OVER (PARTITION BY ancestor) AS count FROM cf JOIN closure ON taxon_key = descendant AND distance > 0) SELECT * FROM p WHERE value > 0")
def rank_class_implicit_zero(spark: SparkSession, d: str) -> DataFrame:
    rows = filters.good_quality(observations(spark, d))
    each = rows.groupBy("taxon_key").agg(F.round(F.mean((F.col("nominal") == 80).cast("double")), 6).alias("value"), F.count(F.lit(1)).alias("samples")).where("samples >= 5").withColumns({"rank": F.lit("SPECIES"), "variable": F.lit("nominal"), "metric": F.lit("class_80")})
    tree = hierarchy.closure(taxa(spark, d))
    totals = each.join(tree.where("distance > 0"), F.col("taxon_key") == F.col("descendant")).groupBy("ancestor", "rank", "variable").agg(F.count(F.lit(1)).alias("population"))
    return ranking.with_implicit_zeros(ranking.rank_positions(each.where("value > 0"), tree, 5), totals).select("ancestor", "taxon_key", "position", "count", "value")


@query(_POSITIONS + " SELECT taxon_key, value, position, count, position / count * 100 AS percentile FROM p WHERE ancestor = 'r1' ORDER BY value, taxon_key LIMIT 25 OFFSET 10")
def ranked_page_asc(spark: SparkSession, d: str) -> DataFrame:
    p = _positions(spark, d).where("ancestor = 'r1'").select("taxon_key", "position", "count", "value", ranking.percentile_of(F.col("position"), F.col("count")).alias("percentile"))
    return ranking.ranked_page(p, 10, 25)


@query(_POSITIONS + " SELECT taxon_key, value FROM p WHERE ancestor = 'r1' ORDER BY value DESC, taxon_key DESC LIMIT 25")
def ranked_page_desc(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ranked_page(_positions(spark, d).where("ancestor = 'r1'").select("taxon_key", "value"), 0, 25, descending=True)


@query(f"WITH {SQL_OBS}, m AS (SELECT taxon_key, max(round(angle, 4)) AS value FROM obs GROUP BY 1) SELECT taxon_key, value FROM m ORDER BY value - 90 + 360 - 360 * floor((value - 90 + 360) / 360), taxon_key LIMIT 30")
def ranked_circular(spark: SparkSession, d: str) -> DataFrame:
    m = observations(spark, d).groupBy("taxon_key").agg(F.max(F.round("angle", 4)).alias("value"))
    return ranking.ranked_page(m, 0, 30, reference=90)


def _tall(spark: SparkSession, d: str) -> DataFrame:
    c = stats.class_counts(observations(spark, d), ["taxon_key"], "nominal")
    # a taxon's classes are few: its fractions and its total come from one row
    each = c.groupBy("taxon_key").agg(F.sum("n").alias("total"), F.collect_list(F.struct("class", "n")).alias("c"))
    rows = F.transform("c", lambda x: F.struct(F.concat(F.lit("class_"), x["class"]).alias("metric"), (x["n"] / F.col("total")).alias("value")))
    total = F.array(F.struct(F.lit("total_samples").alias("metric"), F.col("total").cast("double").alias("value")))
    return each.select("taxon_key", F.lit("nominal").alias("variable"), F.inline(F.concat(rows, total)))


_TALL = f"WITH {SQL_OBS}, t AS (SELECT taxon_key, count(*) AS n, count(*) FILTER (WHERE nominal = 80) AS k, count(*) FILTER (WHERE nominal = 70) AS f FROM obs GROUP BY 1)"


@query(_TALL + " SELECT taxon_key FROM t WHERE k / n <= 0.01e0")
def stat_filter_tall(spark: SparkSession, d: str) -> DataFrame:
    return ranking.stat_filter(_tall(spark, d), "nominal:class_80:lte:0.01")


@query(_TALL + " SELECT taxon_key FROM t WHERE f >= 6")
def stat_filter_count(spark: SparkSession, d: str) -> DataFrame:
    return ranking.stat_filter(_tall(spark, d), "nominal:class_70:gte:6:count")


@query(_TALL + " SELECT taxon_key FROM t WHERE k / n <= 0.05e0 AND f >= 6")
def stat_filter_chain(spark: SparkSession, d: str) -> DataFrame:
    return ranking.stat_filters(_tall(spark, d), ["nominal:class_80:lte:0.05", "nominal:class_70:gte:6:count"])


@query(f"WITH {SQL_OBS} SELECT taxon_key FROM (SELECT taxon_key, round(quantile_cont(ratio, 0.5), 6) AS m FROM obs GROUP BY 1) WHERE m > 250000")
def stat_filter_wide(spark: SparkSession, d: str) -> DataFrame:
    wide = observations(spark, d).groupBy("taxon_key").agg(F.round(F.percentile("ratio", F.lit(0.5)), 6).alias("value"))
    return ranking.stat_filter(wide.select("taxon_key", F.lit("ratio").alias("variable"), F.lit("median").alias("metric"), "value"), "ratio:median:gt:250000")


@query(_POSITIONS + " SELECT variable, metric, max(count) AS population FROM p GROUP BY ALL")
def ranking_options(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ranking_options(_positions(spark, d))


@query(f"WITH {SQL_OBS} SELECT min(ratio) AS min, max(ratio) AS max, fix(quantile_cont(ratio, 0.001), 6) AS p_low, fix(quantile_cont(ratio, 0.999), 6) AS p_high FROM obs")
def value_range_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.value_range(observations(spark, d), "catalog_number", "ratio"))


@query(_rolled_sql("nominal") + """, c AS (SELECT taxon_key, nominal AS k, count(*) AS n FROM f GROUP BY ALL), r AS (SELECT taxon_key, k, n / sum(n) OVER w AS fraction, count(*) OVER w > 2 AS has_more FROM c WINDOW w AS (PARTITION BY taxon_key))
SELECT taxon_key, k AS class, fix(fraction, 6) AS fraction, has_more FROM r QUALIFY row_number() OVER (PARTITION BY taxon_key ORDER BY fraction DESC, k) <= 2 AND fraction >= 0.3e0""")
def top_classes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.top_classes(stats.class_fractions(_rolled(spark, d, "nominal"), ["taxon_key"], "nominal"), "taxon_key", 0.3, 2))


@query(f"WITH {SQL_OBS}, p AS (SELECT 'p' || catalog_number AS place, CAST(floor(lat / 10) AS BIGINT) AS cell_lat, CAST(floor(lon / 10) AS BIGINT) AS cell_lon, ratio AS population FROM obs) SELECT place, cell_lat, cell_lon, population, row_number() OVER (PARTITION BY cell_lat, cell_lon ORDER BY population DESC, place) AS r FROM p QUALIFY r <= 5")
def dense_cell_topn(spark: SparkSession, d: str) -> DataFrame:
    p = observations(spark, d).select(F.concat(F.lit("p"), "catalog_number").alias("place"), (F.col("lat") / 10).alias("lat"), (F.col("lon") / 10).alias("lon"), F.col("ratio").alias("population"))
    return ranking.dense_cells(p, 5).withColumn("r", F.col("r").cast("long"))


# incremental


def _pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = observations(spark, d).select("catalog_number", "lat", "lon", "ts", "ratio", "angle")
    k = F.col("catalog_number")
    old = o.where(k % 13 != 0).withColumns({"lat": F.when(k % 10 == 0, F.col("lat") + 1).otherwise(F.col("lat")), "ts": F.when(k % 10 == 1, F.col("ts") + 60).when(k % 10 == 2, None).otherwise(F.col("ts"))})
    new = o.drop("ratio", "angle").withColumn("ts", F.when(k % 10 == 2, None).otherwise(F.col("ts")))
    return new, old


_PAIR = f"WITH {SQL_OBS}, new AS (SELECT catalog_number, lat, lon, CASE WHEN catalog_number % 10 <> 2 THEN ts END AS ts FROM obs), old AS (SELECT catalog_number, CASE WHEN catalog_number % 10 = 0 THEN lat + 1 ELSE lat END AS lat, lon, CASE catalog_number % 10 WHEN 1 THEN ts + 60 WHEN 2 THEN NULL ELSE ts END AS ts, ratio, angle FROM obs WHERE catalog_number % 13 <> 0), j AS (SELECT n.*, o.catalog_number IS NOT NULL AS found, coalesce(n.lat = o.lat AND n.lon = o.lon, false) AS place, n.ts IS NOT DISTINCT FROM o.ts AS time, o.ratio, o.angle FROM new n LEFT JOIN old o USING (catalog_number))"


@query(_PAIR + " SELECT catalog_number, lat, lon, ts, CASE WHEN place THEN ratio END AS ratio, fix(CASE WHEN place AND time THEN angle END, 6) AS angle FROM j")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    return incremental.carry_forward(*_pair(spark, d), ["ratio"], ["angle"]).withColumn("angle", fixed(F.col("angle")))


@query(_PAIR + " SELECT count(*) FILTER (WHERE place) AS carried, count(*) FILTER (WHERE found AND NOT place) AS changed, count(*) FILTER (WHERE NOT found) AS new FROM j")
def carry_forward_counts(spark: SparkSession, d: str) -> DataFrame:
    return incremental.carry_counts(*_pair(spark, d))


@query(f"WITH {SQL_OBS} SELECT catalog_number, CASE WHEN catalog_number % 3 = 0 THEN ratio * 2 WHEN catalog_number % 4 = 0 THEN NULL ELSE ratio END AS ratio, CASE WHEN catalog_number % 3 = 0 THEN ordinal END AS layer2 FROM obs")
def coalesce_merge(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    k = F.col("catalog_number")
    base = o.select("catalog_number", F.when(k % 4 != 0, F.col("ratio")).alias("ratio"))
    updates = o.where(k % 3 == 0).select("catalog_number", (F.col("ratio") * 2).alias("ratio"), F.col("ordinal").alias("layer2"))
    return incremental.coalesce_merge(base, updates, ["ratio", "layer2"])


@query(f"WITH {SQL_OBS} SELECT catalog_number, CASE WHEN catalog_number % 6 = 0 THEN 'ratio,angle' WHEN catalog_number % 2 = 0 THEN 'ratio' ELSE 'angle' END AS missing FROM obs WHERE catalog_number % 2 = 0 OR catalog_number % 3 = 0")
def worklist_missing(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("catalog_number")
    o = observations(spark, d).withColumns({"ratio": F.when(k % 2 != 0, F.col("ratio")), "angle": F.when(k % 3 != 0, F.col("angle"))})
    return incremental.worklist(o, ["ratio", "angle"], "lat").withColumn("missing", F.array_join("missing", ","))


# weather and time


@query(f"WITH {SQL_HOURLY} SELECT cell, hour, fix(sum(value) OVER w, 4) AS sum, count(value) OVER w AS n, fix(avg(value) OVER w, 4) AS avg FROM hourly WINDOW w AS (PARTITION BY cell ORDER BY hour RANGE BETWEEN 71 PRECEDING AND CURRENT ROW)")
def window_sum_avg(spark: SparkSession, d: str) -> DataFrame:
    return rounded(timeseries.trailing(hourly(spark, d), 72, days=7), 4)


@query("WITH h AS (SELECT user_id % 20 AS cell, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, CAST(min(floor(value)) AS BIGINT) % 4 AS code FROM events GROUP BY 1, 2), w AS (SELECT a.cell, a.hour, b.code, count(*) AS n FROM h a JOIN h b ON a.cell = b.cell AND b.hour BETWEEN a.hour - 23 AND a.hour GROUP BY ALL) SELECT cell, hour, code AS mode FROM w QUALIFY row_number() OVER (PARTITION BY cell, hour ORDER BY n DESC, code) = 1")
def window_mode(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("cell"), F.floor(F.unix_timestamp("ts") / 3600).cast("long").alias("hour")).agg((F.min(F.floor("value")) % 4).alias("code"))
    return timeseries.trailing_mode(e, 24, days=7)


@query(f"WITH {SQL_HOURLY}, n AS (SELECT max(hour) - 200 AS now FROM hourly) SELECT cell, horizon, fix(avg(value), 4) AS avg FROM hourly, n, (SELECT unnest([1, 8, 24, 72, 168]) AS horizon) WHERE hour > now + horizon - 24 AND hour <= now + horizon GROUP BY ALL")
def forecast_window(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d)
    now = h.agg(F.max("hour")).first()[0] - 200
    return rounded(timeseries.forecast(h, now, 24), 4)


_PRECEDENCE = "f AS (SELECT user_id % 20 AS cell, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, event_id % 3 AS source_rank, event_id AS version, value FROM events)"


@query(f"WITH {_PRECEDENCE} SELECT cell, hour, value FROM f QUALIFY row_number() OVER (PARTITION BY cell, hour ORDER BY source_rank DESC, version DESC) = 1")
def source_precedence(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "events").select((F.col("user_id") % 20).alias("cell"), F.floor(F.unix_timestamp("ts") / 3600).cast("long").alias("hour"), (F.col("event_id") % 3).alias("source_rank"), F.col("event_id").alias("version"), "value")
    return timeseries.latest(f, ["cell", "hour"], "value", ["source_rank", "version"])


@query(f"WITH {SQL_OBS}, t AS (SELECT catalog_number, ts FROM obs), c AS (SELECT i AS chunk, 788918400 + i * 4320000 AS first, 788918400 + i * 4320000 + 4000000 AS last FROM range(60) r(i)) SELECT t.catalog_number, t.ts, c.chunk, t.ts - c.first AS into FROM t ASOF JOIN c ON t.ts >= c.first WHERE t.ts <= c.last")
def chunk_lookup_asof(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    chunks = spark.range(60).select(i.alias("chunk"), (788918400 + i * 4320000).alias("first"), (788918400 + i * 4320000 + 4000000).alias("last"))
    return timeseries.chunk_of(observations(spark, d).select("catalog_number", "ts"), chunks)


def _li(spark: SparkSession, d: str, **columns: Column) -> DataFrame:
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in columns.items())))


@query("SELECT l_orderkey, l_linenumber, fix(0.6108e0 * exp(17.27e0 * l_quantity / (l_quantity + 237.3e0)) - 0.6108e0 * exp(17.27e0 * (l_discount * 100) / (l_discount * 100 + 237.3e0)), 6) AS vpd FROM lineitem")
def vpd(spark: SparkSession, d: str) -> DataFrame:
    return _li(spark, d, vpd=weather.vpd(F.col("l_quantity"), F.col("l_discount") * 100))


@query("SELECT l_orderkey, l_linenumber, fix(243.04e0 * g / (17.625e0 - g), 6) AS dew FROM (SELECT *, ln(greatest(1, least(100, l_discount * 1200e0)) / 100) + 17.625e0 * l_quantity / (243.04e0 + l_quantity) AS g FROM lineitem)")
def dew_point(spark: SparkSession, d: str) -> DataFrame:
    return _li(spark, d, dew=weather.dew_point(F.col("l_quantity"), F.col("l_discount") * 1200))


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, l_quantity * 2 AS cloud, l_discount * 100 AS rain, l_tax * 100 AS snow, CASE WHEN l_linenumber <> 3 THEN l_quantity - 25 END AS t FROM lineitem),
c AS (SELECT *, CASE WHEN snow / 10 >= 0.8 THEN 75 WHEN snow / 10 >= 0.2 THEN 73 WHEN snow / 10 >= 0.01 THEN 71 WHEN rain >= 7.6 THEN 65 WHEN rain >= 2.5 THEN 63 WHEN rain >= 1.3 THEN 61 WHEN rain >= 1 THEN 55 WHEN rain >= 0.5 THEN 53
  WHEN rain >= 0.01 THEN 51 WHEN cloud >= 80 THEN 3 WHEN cloud >= 50 THEN 2 WHEN cloud >= 20 THEN 1 ELSE 0 END AS code FROM w)
SELECT l_orderkey, l_linenumber, CASE WHEN t > 0 AND code IN (71, 73, 75) THEN code - 10 WHEN t < 0 AND code IN (61, 63, 65) THEN code + 10 ELSE code END AS code FROM c""")
def weather_code(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return _li(spark, d, code=weather.weather_code(q * 2, F.col("l_discount") * 100, F.col("l_tax") * 100, F.when(F.col("l_linenumber") != 3, q - 25)))


@query(f"WITH {_PRECEDENCE}, m AS (SELECT cell, avg(value - 10) AS u, avg(source_rank - 1.5e0) AS v FROM f GROUP BY 1) SELECT cell, fix(sqrt(u * u + v * v), 6) AS speed, fix(degrees(atan2(-u, -v)) + 360 - 360 * floor((degrees(atan2(-u, -v)) + 360) / 360), 6) AS direction FROM m")
def wind_vector_mean(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("cell")).agg(F.avg(F.col("value") - 10).alias("u"), F.avg(F.col("event_id") % 3 - 1.5).alias("v"))
    return rounded(m.select("cell", weather.wind_speed(F.col("u"), F.col("v")).alias("speed"), weather.wind_from(F.col("u"), F.col("v")).alias("direction")))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_quantity AS v, CASE WHEN l_linenumber <> 2 THEN l_extendedprice END / 50 AS model, CASE l_linenumber WHEN 3 THEN -9999e0 ELSE l_discount * 1000 END AS own FROM lineitem)
SELECT l_orderkey, l_linenumber, fix(CASE WHEN model IS NOT NULL AND own > -9000 THEN v + (model - own) * 0.0065e0 ELSE v END, 6) AS t FROM e""")
def elevation_correction(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    model, own = F.when(n != 2, F.col("l_extendedprice")) / 50, F.when(n == 3, -9999.0).otherwise(F.col("l_discount") * 1000)
    return _li(spark, d, t=weather.elevation_corrected(F.col("l_quantity"), model, own))


@query(f"WITH {SQL_OBS} SELECT catalog_number, CAST(greatest(0, least(720, round_even((lat + 90) / 0.25e0, 0))) AS BIGINT) AS i, CAST(greatest(0, least(1439, round_even((lon + 180) / 0.25e0, 0))) AS BIGINT) AS j FROM obs")
def grid_index(spark: SparkSession, d: str) -> DataFrame:
    i, j = geo.grid_index(F.col("lat"), F.col("lon"), 0.25, 721, 1440)
    return observations(spark, d).select("catalog_number", i.alias("i"), j.alias("j"))


@query(f"WITH {SQL_OBS} SELECT catalog_number, fix(radians(lon) * 6378137e0, 3) AS x, fix(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137e0, 3) AS y FROM obs WHERE abs(lat) < 85")
def mercator(spark: SparkSession, d: str) -> DataFrame:
    x, y = geo.mercator(F.col("lat"), F.col("lon"))
    return rounded(observations(spark, d).where(F.abs("lat") < 85).select("catalog_number", x.alias("x"), y.alias("y")), 3)


def _hilbert_sql(order: int) -> str:
    n = 1 << order
    sql = f"SELECT catalog_number, CAST(greatest(0, least({n - 1}, floor((lon + 180) / 360e0 * {n}))) AS BIGINT) AS x, CAST(greatest(0, least({n - 1}, floor((lat + 90) / 180e0 * {n}))) AS BIGINT) AS y, CAST(0 AS BIGINT) AS d FROM obs"
    for i in range(order - 1, -1, -1):
        s = 1 << i
        sql = f"SELECT catalog_number, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN {n - 1} - y ELSE y END ELSE x END AS x, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN {n - 1} - x ELSE x END ELSE y END AS y, d + {s} * {s} * xor(3 * rx, ry) AS d FROM (SELECT *, CASE WHEN x & {s} > 0 THEN 1 ELSE 0 END AS rx, CASE WHEN y & {s} > 0 THEN 1 ELSE 0 END AS ry FROM ({sql}))"
    return f"WITH {SQL_OBS} SELECT catalog_number, CAST(d AS BIGINT) AS d FROM ({sql})"


@query(_hilbert_sql(13))
def hilbert_index(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).select("catalog_number", geo.hilbert(F.col("lat"), F.col("lon")).alias("d"))


_CLASS = "CASE WHEN (silt + 1.5e0 * clay) < 15 THEN 1 WHEN (silt + 2 * clay) < 30 THEN 2 WHEN (clay >= 7 AND clay < 20 AND sand > 52) OR (clay < 7 AND silt < 50) THEN 3 WHEN clay >= 7 AND clay < 27 AND silt >= 28 AND silt < 50 AND sand <= 52 THEN 4 WHEN (silt >= 50 AND clay >= 12 AND clay < 27) OR (silt >= 50 AND silt < 80 AND clay < 12) THEN 5 WHEN silt >= 80 AND clay < 12 THEN 6 WHEN clay >= 20 AND clay < 35 AND silt < 28 AND sand > 45 THEN 7 WHEN clay >= 27 AND clay < 40 AND sand > 20 AND sand <= 45 THEN 8 WHEN clay >= 27 AND clay < 40 AND sand <= 20 THEN 9 WHEN clay >= 35 AND sand > 45 THEN 10 WHEN clay >= 40 AND silt >= 40 THEN 11 WHEN clay >= 40 THEN 12 END"


@query(f"SELECT p_partkey, {_CLASS} AS class FROM (SELECT p_partkey, CAST(p_size * 2 AS DOUBLE) AS sand, (100 - p_size * 2) * (p_partkey % 11) / 10e0 AS silt, 100 - p_size * 2 - (100 - p_size * 2) * (p_partkey % 11) / 10e0 AS clay FROM part)")
def soil_class(spark: SparkSession, d: str) -> DataFrame:
    sand = (F.col("p_size") * 2).cast("double")
    silt = (100 - F.col("p_size") * 2) * (F.col("p_partkey") % 11) / F.lit(10.0)
    return table(spark, d, "part").select("p_partkey", geo.texture_class(sand, silt, 100 - F.col("p_size") * 2 - silt).alias("class"))


@query("""WITH g AS (SELECT CAST(p_partkey // 40 AS BIGINT) AS i, CAST(p_partkey % 40 AS BIGINT) AS j, p_retailprice + p_size AS z FROM part), w AS (SELECT a.i, a.j, max(CASE WHEN b.i = a.i - 1 AND b.j = a.j - 1 THEN b.z END) AS nw, max(CASE WHEN b.i = a.i - 1 AND b.j = a.j THEN b.z END) AS n, max(CASE WHEN b.i = a.i - 1 AND b.j = a.j + 1 THEN b.z END) AS ne,
max(CASE WHEN b.i = a.i AND b.j = a.j - 1 THEN b.z END) AS w, max(CASE WHEN b.i = a.i AND b.j = a.j + 1 THEN b.z END) AS e, max(CASE WHEN b.i = a.i + 1 AND b.j = a.j - 1 THEN b.z END) AS sw, max(CASE WHEN b.i = a.i + 1 AND b.j = a.j THEN b.z END) AS s, max(CASE WHEN b.i = a.i + 1 AND b.j = a.j + 1 THEN b.z END) AS se, count(*) AS k
FROM g a JOIN g b ON b.i BETWEEN a.i - 1 AND a.i + 1 AND b.j BETWEEN a.j - 1 AND a.j + 1 GROUP BY 1, 2), x AS (SELECT i, j, ((ne + 2 * e + se) - (nw + 2 * w + sw)) / 240e0 AS ex, ((nw + 2 * n + ne) - (sw + 2 * s + se)) / 240e0 AS ny FROM w WHERE k = 9)
SELECT i, j, fix(degrees(atan(sqrt(ex * ex + ny * ny))), 5) AS slope, fix(degrees(atan2(-ex, -ny)) + 360 - 360 * floor((degrees(atan2(-ex, -ny)) + 360) / 360), 5) AS aspect FROM x""")
def slope_aspect(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 40).cast("long").alias("i"), (F.col("p_partkey") % 40).alias("j"), (F.col("p_retailprice") + F.col("p_size")).alias("z"))
    names = {(-1, -1): "nw", (-1, 0): "n", (-1, 1): "ne", (0, -1): "w", (0, 0): "own", (0, 1): "e", (1, -1): "sw", (1, 0): "s", (1, 1): "se"}
    # each value goes to the nine windows it is in: one shuffle and no join
    sent = F.explode(F.array(*(F.struct((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j"), F.lit(n).alias("at"), F.col("z").alias("z")) for (a, b), n in names.items())))
    w = g.select(sent.alias("x")).select("x.*").groupBy("i", "j").agg(*(F.max(F.when(F.col("at") == n, F.col("z"))).alias(n) for n in names.values()), F.count(F.lit(1)).alias("k")).where("k = 9")
    slope, aspect = geo.slope_aspect({n: F.col(n) for n in names.values()}, F.lit(30.0), F.lit(30.0))
    return rounded(w.select("i", "j", slope.alias("slope"), aspect.alias("aspect")), 5)


@query(f"""WITH {SQL_OBS}, n AS (SELECT CAST(ceil(sqrt((max(p_partkey) + 1) / 2e0)) AS BIGINT) AS h FROM part),
r AS (SELECT CAST(p_partkey // (2 * h) AS BIGINT) AS row, CAST(p_partkey % (2 * h) AS BIGINT) AS col, CASE WHEN p_size <> 7 THEN p_size END AS raw FROM part, n)
SELECT o.catalog_number, fix(r.raw * 0.1e0 - 5, 6) AS value FROM obs o, n LEFT JOIN r ON r.row = CAST(floor((90 - o.lat) / (180e0 / h)) AS BIGINT) AND r.col = CAST(floor((o.lon + 180) / (180e0 / h)) AS BIGINT)""")
def raster_cell_join(spark: SparkSession, d: str) -> DataFrame:
    """Parts are the pixels of a raster twice as wide as high, all of them."""
    part = table(spark, d, "part")
    h = math.ceil(math.sqrt(((part.agg(F.max("p_partkey")).first()[0] or 0) + 1) / 2))
    k = F.col("p_partkey")
    cells = part.select(F.floor(k / (2 * h)).cast("long").alias("row"), (k % (2 * h)).cast("long").alias("col"), F.when(F.col("p_size") != 7, F.col("p_size")).alias("raw"))
    row, col = geo.raster_cell(F.col("lat"), F.col("lon"), 180.0 / h)
    o = observations(spark, d).select("catalog_number", row.alias("row"), col.alias("col"))
    return rounded(o.join(cells, ["row", "col"], "left").select("catalog_number", (F.col("raw") * 0.1 - 5).alias("value")))


# names, catalogue, units


@query("SELECT p_partkey, trim(regexp_replace(lower(replace('  ' || p_name || '_' || p_type || '  X', '_', ' ')), '\\s+', ' ', 'g')) AS name FROM part")
def normalize_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.normalized(F.concat(F.lit("  "), "p_name", F.lit("_"), "p_type", F.lit("  X"))).alias("name"))


@query("SELECT p_partkey, replace(lower(p_name || ' ' || p_type), ' ', '-') AS slug FROM part")
def slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


@query("""WITH w AS (SELECT p_partkey, upper(p_name[1]) || lower(split_part(p_name, ' ', 1)[2:]) AS a, upper(split_part(p_name, ' ', 2)[1]) || lower(split_part(p_name, ' ', 2)[2:]) AS b FROM part)
SELECT p_partkey, a || ' ' || b || ' King''s-crown Blue-Eyed O''brien Cows USA X-Ray' AS title FROM w""")
def title_case(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit(" "), "p_name", F.lit(" KING'S-crown blue-eyed o'BRIEN cows' USA x-ray "))
    return table(spark, d, "part").select("p_partkey", text.title_case(name).alias("title"))


@query("WITH n AS (SELECT p_partkey, p_brand, lower(p_name || ' ' || p_type || ' ' || p_size) AS name FROM part), idx AS (SELECT name, min(p_brand) AS brand FROM n GROUP BY 1 HAVING count(DISTINCT p_brand) = 1) SELECT p_partkey, brand FROM n JOIN idx USING (name)")
def name_match_unique(spark: SparkSession, d: str) -> DataFrame:
    """Names of all parts, long enough for most to have one brand."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", text.matching(F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string"))).alias("name"))
    index = p.groupBy("name").agg(F.count_distinct("p_brand").alias("k"), F.min("p_brand").alias("brand")).where("k = 1")
    return p.join(index, "name").select("p_partkey", "brand")


@query("""WITH k AS (SELECT p_partkey, p_name, p_type, CASE WHEN p_size % 2 = 0 THEN 'Brand#00' ELSE p_brand END AS b FROM part), m AS (SELECT p_type, p_name, p_brand, min(p_partkey) AS id FROM part GROUP BY ALL),
s AS (SELECT p_type, p_name, min(p_partkey) AS id FROM part GROUP BY ALL HAVING count(DISTINCT p_brand) = 1)
SELECT k.p_partkey, coalesce(m.id, s.id) AS outer_id FROM k LEFT JOIN m ON k.p_type = m.p_type AND k.p_name = m.p_name AND k.b = m.p_brand LEFT JOIN s ON k.p_type = s.p_type AND k.p_name = s.p_name""")
def mapping_exact_stripped(spark: SparkSession, d: str) -> DataFrame:
    """All parts against an outer catalogue of all parts; every other one has lost its brand and must do without."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    exact = p.groupBy("p_type", "p_name", "p_brand").agg(F.min("p_partkey").alias("exact"))
    loose = p.groupBy("p_type", "p_name").agg(F.min("p_partkey").alias("loose"), F.count_distinct("p_brand").alias("k")).where("k = 1").drop("k")
    own = p.select("p_partkey", "p_name", "p_type", F.when(F.col("p_size") % 2 == 0, "Brand#00").otherwise(F.col("p_brand")).alias("p_brand"))
    return own.join(exact, ["p_type", "p_name", "p_brand"], "left").join(loose, ["p_type", "p_name"], "left").select("p_partkey", F.coalesce("exact", "loose").alias("outer_id"))


@query(f"WITH {SQL_OBS} SELECT taxon_key, arg_min(catalog_number, (CASE WHEN nominal = 70 THEN 0 ELSE 1 END) * 1000000000 + ordinal * 100000000 + catalog_number) AS image FROM obs WHERE obscured = 'No' GROUP BY 1")
def best_image(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d).where("obscured = 'No'")
    return o.groupBy("taxon_key").agg(F.min_by("catalog_number", F.struct((F.col("nominal") != 70), "ordinal", "catalog_number")).alias("image"))


@query("WITH n AS (SELECT p_brand, p_name AS name, min(p_partkey) AS ord FROM part GROUP BY ALL) SELECT p_brand, arg_min(name, ord) AS common_name, string_agg(name, '; ' ORDER BY ord) AS names FROM n GROUP BY 1")
def vernacular_merge(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part").groupBy("p_brand", F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"))
    names = F.array_sort(F.collect_list(F.struct("ord", "name")))["name"]
    return n.groupBy("p_brand").agg(names.alias("n")).select("p_brand", F.element_at("n", 1).alias("common_name"), F.array_join("n", "; ").alias("names"))


@query("SELECT c_custkey, fix(c_acctbal * 1.8e0 + 32, 6) AS value, fix(c_acctbal * 1.8e0, 6) AS std, fix(c_acctbal * 3.24e0, 6) AS variance, fix(c_acctbal, 6) AS back FROM customer")
def unit_convert(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("c_acctbal")
    return rounded(table(spark, d, "customer").select("c_custkey", units.convert(v, "°C").alias("value"), units.convert(v, "°C", "std").alias("std"), units.convert(v, "°C", "variance").alias("variance"), units.invert(units.convert(v, "°C"), "°C").alias("back")))


@query("SELECT c_custkey, fix(c_acctbal + ln(1 / 25.4e0 * 1), 6) AS entropy FROM customer")
def unit_convert_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table(spark, d, "customer").select("c_custkey", units.convert(F.col("c_acctbal"), "mm", "entropy", "ratio").alias("entropy")))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def evidence_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SQL_OBS}, p AS (SELECT 'p' || catalog_number AS place, lat, lon, ratio AS population FROM obs), c AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) * 6371e0 AS x, cos(radians(lat)) * sin(radians(lon)) * 6371e0 AS y, sin(radians(lat)) * 6371e0 AS z FROM p) SELECT place FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE a.place <> b.place AND b.population >= a.population AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 22500e0)")
def isolated_places(spark: SparkSession, d: str) -> DataFrame:
    p = observations(spark, d).select(F.concat(F.lit("p"), "catalog_number").alias("place"), "lat", "lon", F.col("ratio").alias("population"))
    return ranking.isolated(p).select("place")


@query(_rolled_sql("nominal") + ", c AS (SELECT taxon_key, nominal AS k, count(*) AS n FROM f GROUP BY ALL) SELECT taxon_key, count(*) AS classes, max(k) AS largest_class FROM c WHERE n > 0 GROUP BY 1")
def class_fraction_map(spark: SparkSession, d: str) -> DataFrame:
    c = stats.class_fractions(_rolled(spark, d, "nominal"), ["taxon_key"], "nominal").where("fraction > 0")
    m = c.groupBy("taxon_key").agg(F.map_from_entries(F.collect_list(F.struct("class", "fraction"))).alias("m"))
    return m.select("taxon_key", F.size("m").cast("long").alias("classes"), F.array_max(F.map_keys("m")).alias("largest_class"))


@query("SELECT c_custkey, fix(c_acctbal * 1.8e0 + 32, 6) AS point, fix(abs(c_acctbal) / 1.8e0, 6) AS density FROM customer")
def density_convert(spark: SparkSession, d: str) -> DataFrame:
    points, values = units.convert_density(F.array("c_acctbal"), F.array(F.abs("c_acctbal")), "°C")
    return rounded(table(spark, d, "customer").select("c_custkey", points[0].alias("point"), values[0].alias("density")))


@query("WITH w AS (SELECT user_id % 20 AS cell, date_trunc('hour', ts) - to_hours(CAST(i AS BIGINT)) AS first, value FROM events, range(6) r(i)) SELECT cell, first, first + INTERVAL 6 HOUR AS last, fix(sum(value), 4) AS sum, count(value) AS n, fix(avg(value), 4) AS avg FROM w GROUP BY ALL")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("cell"), "ts", "value")
    return rounded(windows.sliding(e, 6), 4)


# numeric results without SQL: rows only


@query(None)
def kde_gaussian(spark: SparkSession, d: str) -> DataFrame:
    return density.density(_rolled(spark, d, "ratio"), "taxon_key", "ratio", "ratio")


@query(None)
def kde_circular(spark: SparkSession, d: str) -> DataFrame:
    return density.density(_rolled(spark, d, "angle"), "taxon_key", "angle", "circular")


@query(None)
def ternary_density(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_discount") * 100).alias("b"), (F.col("l_tax") * 100).alias("c"))
    return density.ternary(rows, "l_returnflag", ("l_quantity", "b", "c"))


@query(None)
def von_mises_entropy(spark: SparkSession, d: str) -> DataFrame:
    c = stats.circular(_rolled(spark, d, "angle"), ["taxon_key"], "angle")

    def run(frames):  # noqa: ANN001, ANN202
        for f in frames:
            yield f.assign(entropy=stats.von_mises_entropies(f["rbar"].to_numpy()))

    return c.select("taxon_key", "rbar").mapInPandas(run, "taxon_key string, rbar double, entropy double")


@query(None)
def stats_continuous_sketch(spark: SparkSession, d: str) -> DataFrame:
    return stats.continuous_sketch(_rolled(spark, d, "ratio"), ["taxon_key"], "ratio")


@query(None)
def fuzzy_search(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("taxon_key"), F.col("p_name").alias("name"))
    return search.fuzzy_top(names, "red wid", 50)

"""Queries over whole tables against SQL without a filter on ids, or brute force; the registered SQL of some keeps one."""

import math
from pathlib import Path

import numpy as np
import pytest

from lichen.operators import ranking
from lichen.plans import CATALOG
from lichen.plans.catalog import _spelled
from lichen.sources.tables import SQL_HOURLY, SQL_OBS


def agree(spark, name, sql, sf="sf0.001"):
    import duckdb

    d = f"/root/testdata/{sf}"
    if not Path(d).exists():
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in "supplier part orders events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got, want = CATALOG[name][0](spark, d), con.execute(_spelled(sql))
    names, have = sorted(got.columns), [x[0] for x in want.description]
    assert names == sorted(have), name
    cell = lambda v: float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v
    pick = lambda rows, columns: sorted((tuple(cell(r[columns.index(n)]) for n in names) for r in rows), key=repr)
    found = pick(map(tuple, got.collect()), got.columns)
    assert found == pick(want.fetchall(), have), name
    return found


def test_cell_series_join_takes_every_order(spark):
    sql = f"""WITH {SQL_HOURLY}, o AS (SELECT o_orderkey, o_orderkey % 20 AS cell, CAST(473352 + o_orderkey * 17 % 720 AS BIGINT) AS hour FROM orders)
    SELECT o_orderkey, fix(sum(value), 4) AS sum, count(value) AS n FROM o LEFT JOIN hourly h ON o.cell = h.cell AND h.hour BETWEEN o.hour - 23 AND o.hour GROUP BY 1"""
    assert len(agree(spark, "cell_series_join", sql)) == 1500


def test_isolated_places_takes_every_place(spark):
    sql = f"""WITH {SQL_OBS}, p AS (SELECT 'p' || catalog_number AS place, lat, lon, ratio AS population FROM obs), c AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) * 6371e0 AS x, cos(radians(lat)) * sin(radians(lon)) * 6371e0 AS y, sin(radians(lat)) * 6371e0 AS z FROM p)
    SELECT place FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE a.place <> b.place AND b.population >= a.population AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 22500e0)"""
    found = agree(spark, "isolated_places", sql)
    assert any(int(p[1:]) % 5 for (p,) in found)


def test_isolated_places_by_brute_force(spark):
    r = np.random.default_rng(3)
    # dense, with equal populations, names that come twice, and rows without a position or a population
    p = [(f"p{i if i % 9 else 0}", float(r.uniform(40, 56)), float(r.uniform(-5, 18)), float(r.integers(0, 300))) for i in range(900)]
    p += [("q1", None, 1.0, 5.0), ("q2", math.nan, 1.0, 5.0), ("q3", 45.0, math.nan, 5.0), ("q4", 45.0, 5.0, None), ("q5", 45.0, 5.0, 1.0)]
    at = [None if a is None else np.array([math.cos(math.radians(a)) * math.cos(math.radians(o)), math.cos(math.radians(a)) * math.sin(math.radians(o)), math.sin(math.radians(a))]) * 6371 for _, a, o, _ in p]
    beaten = {x[0] for x, u in zip(p, at, strict=True) for y, v in zip(p, at, strict=True) if x[0] != y[0] and None not in (x[3], y[3]) and u is not None and v is not None and y[3] >= x[3] and ((u - v) ** 2).sum() <= 150**2}
    got = ranking.isolated(spark.createDataFrame(p, "place string, lat double, lon double, population double"))
    assert sorted(r["place"] for r in got.collect()) == sorted(x[0] for x in p if x[0] not in beaten)
    assert 5 < got.count() < 100


def test_point_in_region_takes_every_region(spark):
    sql = f"""WITH {SQL_OBS}, b AS (SELECT 's' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS region, s_suppkey * 7 % 160 - 85e0 AS south, s_suppkey * 13 % 340 - 175e0 AS west FROM supplier)
    SELECT catalog_number, min(b.region) AS region FROM obs LEFT JOIN b ON lat > south AND lat < south + 12 AND lon > west AND lon < west + 15 GROUP BY 1"""
    found = agree(spark, "point_in_region", sql, "sf0.01")
    assert any(region and region > "s000060" for _, region in found)


def test_regrids_take_every_part(spark):
    # 2,000 parts: 50 rows of 40; the new grid has 69 of 55
    grid = """WITH grid AS (SELECT p_partkey // 40 AS "row", p_partkey % 40 AS col, p_retailprice AS value FROM part), n AS (SELECT greatest(40, max(p_partkey) // 40 + 1) AS h, CAST(ceil(h * 55e0 / 40) AS BIGINT) AS h2 FROM part),
    t AS (SELECT i AS "row", j AS col, h, (i + 0.5e0) * (h / CAST(h2 AS DOUBLE)) AS y, (j + 0.5e0) * (40e0 / 55) AS x FROM n, range(100) a(i), range(55) b(j) WHERE i < h2)"""
    found = agree(spark, "regrid_average", grid + ' SELECT "row" // 2 AS "row", col // 2 AS col, fix(avg(value), 4) AS value FROM grid GROUP BY ALL', "sf0.01")
    assert len(found) == 500
    near = grid + """ SELECT t."row", t.col, fix(value, 4) AS value FROM t LEFT JOIN grid g ON least(h - 1, CAST(floor(y) AS BIGINT)) = g."row" AND least(39, CAST(floor(x) AS BIGINT)) = g.col"""
    assert len(agree(spark, "regrid_nearest", near, "sf0.01")) == 69 * 55
    smooth = grid + """, c AS (SELECT "row", col, greatest(0e0, least(y - 0.5e0, h - 1e0)) AS y, greatest(0e0, least(x - 0.5e0, 39e0)) AS x FROM t),
    w AS (SELECT c."row", c.col, greatest(0e0, 1 - abs(y - g."row")) * greatest(0e0, 1 - abs(x - g.col)) AS w, value FROM c JOIN grid g ON abs(y - g."row") < 1 AND abs(x - g.col) < 1)
    SELECT "row", col, fix(sum(w * value) / sum(w), 4) AS value FROM w GROUP BY ALL"""
    assert len(agree(spark, "regrid_bilinear", smooth, "sf0.01")) == 69 * 55


def test_names_index_and_resolve_every_part(spark):
    unique = "WITH n AS (SELECT p_partkey, p_brand, lower(concat_ws(' ', p_name, p_type, p_size)) AS name FROM part) SELECT a.p_partkey, a.p_brand AS brand FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE a.name = b.name AND a.p_brand <> b.p_brand)"
    assert agree(spark, "name_match_unique", unique, "sf0.01")
    synonyms = "SELECT a.p_partkey AS taxon_key, count(DISTINCT b.p_partkey) AS n, min(b.p_partkey) AS first FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey <> b.p_partkey GROUP BY 1"
    assert len(agree(spark, "synonym_ids", synonyms, "sf0.01")) == 2000


@pytest.mark.parametrize("name", ["cell_series_join", "isolated_places", "point_in_region", "regrid_average", "regrid_nearest", "regrid_bilinear", "raster_cell_join", "mapping_exact_stripped"])
def test_registered_sql_reads_whole_tables(spark, name):
    agree(spark, name, CATALOG[name][1])

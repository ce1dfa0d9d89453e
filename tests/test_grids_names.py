from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lichen.functions import text
from lichen.operators import incremental, naming, places, rasters, stats, timeseries

GRID = "row long, col long, value double"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_hour_sums_and_codes(spark):
    h = spark.createDataFrame([(1, 2.0), (1, None), (1, float("nan")), (2, None)], "cell int, value double")
    sums = rasters.hour_sums(h, ["cell"])
    assert rows(sums, "cell", "sum", "steps") == [(1, 2.0, 3), (2, 0.0, 1)]
    assert rows(rasters.mean_of(sums, 0.7), "cell", "mean") == [(1, 0.7), (2, 0.7)]
    assert rasters.out_of_bounds(rasters.mean_of(sums), "mean", 0.5, 1).first() == (2, 1)
    c = spark.createDataFrame([(1, 3, 2), (1, 2, 2), (1, 9, 1), (2, 5, 0)], "cell int, code int, n long")
    assert rows(rasters.commonest(c, ["cell"]), "cell", "code") == [(1, 2), (2, 0)]
    empty = h.where("false")
    assert rasters.hour_sums(empty, ["cell"]).count() == 0 and rasters.render_bounds(empty, "value").first() == (0.0, 1.0)


def test_regrid(spark):
    g = spark.createDataFrame([(i, j, float(10 * i + j)) for i in range(4) for j in range(4)], GRID)
    assert rows(rasters.regrid_average(g, 2), "row", "col", "value")[0] == (0, 0, 5.5)
    assert rows(rasters.regrid_nearest(g, 4, 4, 4, 4), "row", "col", "value") == rows(g, "row", "col", "value")
    fine = {(r["row"], r["col"]): r["value"] for r in rasters.regrid_bilinear(g, 4, 4, 8, 8).collect()}
    assert len(fine) == 64 and fine[0, 0] == 0 and fine[1, 1] == pytest.approx(2.75) and fine[7, 7] == 33
    holes = g.withColumn("value", F.when(F.col("col") > 0, F.col("value")))
    assert rasters.regrid_bilinear(holes, 4, 4, 8, 8).where("col = 0").count() == 0


def test_masks_and_bytes(spark):
    df = spark.createDataFrame([(1, 5.0, 350.0), (2, 50.0, 10.0), (3, 5.0, 100.0), (4, None, 1.0), (5, float("nan"), 1.0)], "id int, v double, a double")
    assert rows(rasters.masked(df, {"v": [(0, 9), (40, None)], "a": [(300, 20)]}, wraps=("a",)), "id") == [(1,), (2,)]
    assert rows(rasters.masked(df, {}), "id") == [(1,), (2,), (3,), (4,), (5,)] and rasters.masked(df, {"v": []}).count() == 0
    b = df.where("id = 1").select(*(c.alias(n) for n, c in rasters.terrarium(F.col("v") + 0.5).items())).first()
    assert b["red"] * 256 + b["green"] + b["blue"] / 256 - 32768 == 5.5
    assert rows(df.select(rasters.lut_index(F.col("v"), 0, 10).alias("i")), "i") == sorted([(127,), (255,), (127,), (None,), (None,)], key=repr)
    n = rasters.row_numbers(spark.createDataFrame([(x,) for x in (9, 4, 2, 30, 31)], "k long"), ["k"], F.floor(F.col("k") / 5))
    assert rows(n, "k", "row_number") == [(2, 0), (30, 3), (31, 4), (4, 1), (9, 2)]


def test_places(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    gid = lambda g, n: one(places.parent_gid(F.lit(g), F.lit(n)))
    assert [gid("A.1.2_1", 2), gid("A.1_1", 1), gid("A", 0), gid("A", 1), gid("A.1.2", 2)] == ["A.1_1", "A", None, None, "A.1"]
    assert one(places.most_specific(F.lit(" "), F.lit(None), F.lit("x"))) == "x"
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, -4.0, 9.0), (3, 0.0, 0.0), (4, None, 1.0)], "id int, lat double, lon double")
    r = spark.createDataFrame([("b", -5.0, 0.0, 5.0, 10.0), ("a", 0.0, 0.0, 5.0, 5.0)], "region string, south double, west double, north double, east double")
    assert rows(places.first_region(p, "id", r, 2.0), "id", "region") == [(1, "a"), (2, "b"), (3, None), (4, None)]
    c = spark.createDataFrame([("t", "x", None), ("t", "x", " "), ("u", "", "r")], "taxon_key string, l0 string, reg string")
    assert rows(places.gid_counts(c, {"level0": "l0", "region": "reg"}), "scope", "gid", "taxon_key", "n") == [("level0", "x", "t", 2), ("region", "r", "u", 1)]


def test_names(spark):
    n = spark.createDataFrame([("2", "Blue_Tit"), ("1", "blue  tit"), ("3", ""), ("3", None), ("4", "Oak")], "taxon_key string, name string")
    assert rows(naming.name_index(n), "name", "keys") == [("blue tit", ["1", "2"]), ("oak", ["4"])]
    assert rows(naming.unique_lookup(n.where("name > ''"), text.slug(F.col("name"))), "value", "taxon_key") == [("oak", "4")]
    key = lambda *v: tuple(spark.range(1).select(naming.image_key(*map(F.lit, v)).alias("k")).first()["k"])
    assert key("alive", "organism", "flowers", "cc0") == (0, 0, 0, 0) and key("dead", "scat|organism", "seeds", "http://x/by-nc/4.0/") == (2, 3, 1, 3)
    assert key(None, None, None, None) == (1, 1, 3, 99) and key("", "gall", "flower buds", "/by-nd/4") == (1, 2, 2, 99)
    lic = spark.createDataFrame([("PD",), ("cc-by-nc",), ("http://creativecommons.org/licenses/by-sa/4.0/",), ("updated",), (None,)], "l string")
    assert rows(lic.select(text.license_usable(F.col("l")).alias("u"), text.license_label(text.license_url(F.col("l"))).alias("x")), "u", "x") == sorted(
        [(True, "CC0 1.0"), (True, "CC BY-NC 4.0"), (True, "CC BY-SA 4.0"), (False, "updated"), (False, None)], key=repr
    )
    t = spark.createDataFrame([("g", 1, ["a", "b", "a"]), ("h", None, ["b"])], "taxon_key string, id long, synonyms array<string>")
    ids = spark.createDataFrame([("a", 1), ("a", 7), ("b", 3)], "name string, id long")
    assert rows(naming.synonym_ids(t, ids), "taxon_key", "ids") == [("g", [3, 7]), ("h", [3])]


def test_state(spark):
    base = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "catalog_number long, v double")
    up = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0), (3, 1, None)], "catalog_number long, n int, v double")
    assert rows(incremental.write_back(base, up, "v", "n"), "catalog_number", "v") == [(1, 6.0), (2, None), (3, None)]
    df = spark.createDataFrame([(1, 0.0, 0.0, 9, None), (2, 0.0, 0.0, 9, float("nan")), (3, None, 0.0, 9, None), (4, 0.0, 0.0, 1, None)], "catalog_number long, lat double, lon double, ts long, a double")
    assert rows(incremental.pending(df, ["a"], 5), "catalog_number") == [(1,)]
    state = spark.createDataFrame([(1, 1, 2, 1.0), (1, 5, 2, 2.0), (1, 6, 1, 3.0)], "cell int, hour long, source_rank int, value double")
    new = spark.createDataFrame([(1, 5, 1, 9.0), (1, 6, 2, 8.0), (1, 7, 2, 4.0)], state.schema)
    assert rows(timeseries.window_state(state, new, 7, 4), "hour", "value") == [(5, 9.0), (6, 3.0), (7, 4.0)]
    points = spark.createDataFrame([(1, 1, 10), (2, 3, 10)], "id int, cell int, hour long")
    series = spark.createDataFrame([(1, h, 1.0 if h % 2 else None) for h in range(20)], "cell int, hour long, value double")
    assert rows(timeseries.at_observations(points, series, 4, "id"), "id", "sum", "n") == [(1, 2.0, 2), (2, None, 0)]


def test_lookups(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, float("nan")), ("b", None, 4.0)], "taxon_key string, x double, y double")
    t = stats.tall(df, "taxon_key", ["x", "y"])
    assert rows(stats.wide(t, "count", ["x", "y"]), "taxon_key", "x", "y") == [("a", 2, None), ("b", None, 1)]
    totals = spark.createDataFrame([("a", 9), ("c", 4)], "taxon_key string, total_samples long")
    assert rows(stats.sample_counts(t, totals), "taxon_key", "n") == [("a", 2), ("b", 1), ("c", 4)]


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_percentiles_by_selection(spark, accuracy):
    r = np.random.default_rng(3)
    groups = {"skew": r.lognormal(0, 3, 4001), "ties": r.integers(0, 4, 3000).astype(float), "one": np.array([7.0]), "two": np.array([1.0, 2.0]), "same": np.zeros(500)}
    groups[None] = r.normal(0, 1, 50)
    data = [(g, float(x)) for g, v in groups.items() for x in v] + [("none", None), ("none", float("nan"))]
    points = (("min", 0.0), ("p0.1", 0.001), *stats.POINTS, ("max", 1.0))
    got = {x["g"]: x for x in stats.percentiles(spark.createDataFrame(data, "g string, v double"), ["g"], "v", points, accuracy).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert [got[g][n] for n, _ in points] == pytest.approx([np.percentile(v, 100 * p) for _, p in points]), g


def test_summaries_agree_at_any_size(spark, tmp_path):
    r = np.random.default_rng(4)
    spark.createDataFrame([(f"g{i % 3}" if i % 7 else None, i % 90, float(x)) for i, x in enumerate(r.normal(0, 9, 2000))], "g string, catalog_number int, v double").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    small, large = (sorted(map(tuple, stats.continuous(df, ["g"], "v", small_groups=m).select("g", "count", "unique_samples", "median", "iqr", "std").collect()), key=repr) for m in (True, False))
    assert len(small) == 4 and [x[:3] for x in small] == [x[:3] for x in large]
    assert np.allclose([x[3:] for x in small], [x[3:] for x in large])


def test_new_queries_agree_with_sql(spark):
    import duckdb

    from lichen.plans import CATALOG

    d = "/root/testdata/sf0.001"
    if not Path(d).exists():
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name in ("raster_mean", "raster_mode", "regrid_average", "point_in_region", "image_quality", "catalog_build", "sample_counts", "window_swap"):
        f, sql = CATALOG[name]
        got, want = f(spark, d), con.sql(sql)
        names = sorted(got.columns)
        assert names == sorted(want.columns), name
        cell = lambda v: float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v
        pick = lambda found, have: sorted((tuple(cell(r[have.index(n)]) for n in names) for r in found), key=repr)
        assert pick(map(tuple, got.collect()), got.columns) == pick(want.fetchall(), want.columns), name


def test_sketch_is_near(spark):
    r = np.random.default_rng(5)
    x = r.normal(0, 1, 20_000)
    got = stats.continuous_sketch(spark.createDataFrame([("a", float(v)) for v in x], "g string, v double"), ["g"], "v").first()
    for name, p in stats.POINTS:
        assert abs((x < got[name]).mean() - p) < 2e-3, name
    assert got["std"] == pytest.approx(x.std(ddof=1)) and got["count"] == len(x)

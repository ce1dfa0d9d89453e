import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lichen.functions import text, units, weather
from lichen.operators import density, filters, hierarchy, incremental, ranking, search, stats, timeseries
from lichen.sources import readers, sinks
from lichen.streaming import windows


@pytest.fixture
def tree(spark):
    nodes = [("1", "A_1", "KINGDOM", "A"), ("2", "A_1/F_2", "FAMILY", "F"), ("3", "A_1/F_2/S a_3", "SPECIES", "S a"), ("4", "A_1/F_2/S a_3/v_4", "VARIETY", "v"), ("9", "B_9", "KINGDOM", "B")]
    return spark.createDataFrame(nodes, "taxon_key string, path string, rank string, name string")


def keys(df):
    return sorted(r[0] for r in df.collect())


def test_tree(tree):
    c = {(r["ancestor"], r["descendant"]): r["distance"] for r in hierarchy.closure(tree).collect()}
    assert c == {("1", "1"): 0, ("1", "2"): 1, ("1", "3"): 2, ("1", "4"): 3, ("2", "2"): 0, ("2", "3"): 1, ("2", "4"): 2, ("3", "3"): 0, ("3", "4"): 1, ("4", "4"): 0, ("9", "9"): 0}
    assert keys(hierarchy.subtree(tree, ["A_1/F_2"])) == ["2", "3", "4"] and keys(hierarchy.subtree(tree, [])) == []
    assert keys(hierarchy.request_scope(tree, "A_1/F_2", "FAMILY")) == ["3", "4"]
    assert keys(hierarchy.request_scope(tree, "A_1/F_2/S a_3", "SPECIES")) == ["3", "4"]
    assert keys(hierarchy.request_scope(tree, "A_1/F_2/S a_3/v_4", "VARIETY")) == ["4"]


def test_filters(spark):
    df = spark.createDataFrame([(1, "No", 10.0, 5, 350.0, "a | B"), (2, "Hidden", None, None, float("nan"), None), (3, "No", 900.0, 9, 10.0, ""), (4, "No", None, 7, None, "b")], "catalog_number long, obscured string, uncertainty double, ts long, angle double, states string")
    ids = lambda d: sorted(r["catalog_number"] for r in d.collect())
    assert ids(filters.good_quality(df)) == [1, 4]
    assert ids(filters.has_state(df, " b ")) == [1, 4] and ids(filters.has_state(df.drop("states"), "b")) == []
    assert ids(filters.in_time(df, 5, 7)) == [1, 4] and ids(filters.in_time(df)) == [1, 2, 3, 4]
    assert ids(df.where(filters.between("angle", 340, 20, wraps=True))) == [1, 3]
    assert ids(df.where(filters.between("angle", 340, 5))) == [3]
    assert ids(filters.chained(df, [{"variable": "nowhere", "min": 1}])) == []


def test_polygons(spark):
    def encoded(points):
        out, last = "", (0, 0)
        for p in points:
            now = tuple(round(x * 1e5) for x in p)
            for d in (a - b for a, b in zip(now, last, strict=True)):
                v = ~(d << 1) if d < 0 else d << 1
                while v >= 32:
                    out, v = out + chr((32 | v & 31) + 63), v >> 5
                out += chr(v + 63)
            last = now
        return out

    ring = [(1.5, -2.25), (-80.00001, 179.5), (3.0, 3.0)]
    assert filters.decode_polyline(encoded(ring)) == ring
    assert filters.parse_rings(f"{encoded(ring)};{encoded(ring[:1])}") == [ring]
    with pytest.raises(ValueError):
        filters.decode_polyline(encoded(ring)[:-1] + "_")
    star = [(0.0, 0.0), (4.0, 2.0), (0.0, 4.0), (1.0, 2.0)]
    df = spark.createDataFrame([(0.5, 0.5), (2.0, 2.0), (0.5, 2.0), (5.0, 5.0)], "lat double, lon double")
    assert [r[0] for r in df.select(filters.in_polygon(F.col("lat"), F.col("lon"), [star, [(1, 1)]])).collect()] == [True, True, False, False]


def test_statistics(spark):
    x = [1.0, 2.0, 2.0, 7.0, float("nan"), None]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(x)] + [("one", 9, 5.0)], "g string, catalog_number int, v double")
    r = {r["g"]: r for r in stats.continuous(df, ["g"], "v").collect()}
    assert r["k"]["count"] == 4 and r["k"]["median"] == 2 and r["k"]["90th_percentile"] == pytest.approx(np.percentile([1, 2, 2, 7], 90))
    assert r["one"]["std"] == 0 and r["k"]["std"] == pytest.approx(np.std([1, 2, 2, 7], ddof=1))
    n = {r["g"]: r for r in stats.nominal(df, ["g"], "v").collect()}
    assert n["k"]["mode"] == 2 and n["k"]["entropy"] == pytest.approx(-(0.5 * math.log(0.5) + 0.5 * math.log(0.25)))
    h = [(r["bin"], r["n"]) for r in stats.histogram(df.where("g = 'k'"), ["g"], "v").orderBy("bin").collect()]
    assert h == [(1, 1), (2, 2), (3, 0), (4, 0), (5, 0), (6, 0), (7, 1)]
    assert stats.von_mises_entropy(0) == pytest.approx(math.log(2 * math.pi)) and stats.von_mises_entropy(1) == -math.inf
    lengths = np.array([0.0, 1e-6, 0.01, 0.3, 0.7, 0.9, 0.99, 0.998, 0.99899, 0.9991, 0.99999, 1 - 1e-8])
    many = stats.von_mises_entropies(lengths)
    assert np.all(np.diff(many) < 1e-9) and many == pytest.approx([stats.von_mises_entropy(r) for r in lengths])
    assert many[-1] == pytest.approx(0.5 * math.log(2 * math.pi * math.e * 2e-8), abs=1e-6)  # nearly normal: variance 2 (1 - r)
    a = np.linspace(-np.pi, np.pi, 20_001)
    f = np.exp(1.5 * np.cos(a))
    f /= np.trapezoid(f, a)
    assert stats.von_mises_entropy(np.trapezoid(f * np.cos(a), a)) == pytest.approx(-np.trapezoid(f * np.log(f), a), abs=1e-6)
    c = stats.circular(spark.createDataFrame([("a", 350.0), ("a", 10.0)], "g string, v double"), ["g"], "v").first()
    assert min(c["circular_mean"], 360 - c["circular_mean"]) < 1e-9 and c["rbar"] == pytest.approx(math.cos(math.radians(10)))


def test_ranks(spark, tree):
    v = spark.createDataFrame([("3", "SPECIES", "x", "m", 2.0, 10), ("4", "SPECIES", "x", "m", 2.0, 12), ("2", "SPECIES", "x", "m", 1.0, 9)], "taxon_key string, rank string, variable string, metric string, value double, samples int")
    p = {(r["ancestor"], r["taxon_key"]): (r["position"], r["count"]) for r in ranking.rank_positions(v, hierarchy.closure(tree)).collect()}
    assert p == {("1", "3"): (0, 2), ("1", "4"): (0, 2), ("2", "3"): (0, 2), ("2", "4"): (0, 2), ("3", "4"): (0, 1)}
    with pytest.raises(ValueError):
        ranking.parse_stat_filter("a:b:like:3")
    tall = spark.createDataFrame([("1", "v", "class_3", 0.25), ("1", "v", "total_samples", 10.0), ("2", "v", "total_samples", 4.0), ("3", "w", "class_3", 1.0)], "taxon_key string, variable string, metric string, value double")
    assert keys(ranking.stat_filter(tall, "v:class_3:lt:0.5")) == ["1", "2"]
    assert keys(ranking.stat_filter(tall, "v:class_3:eq:2:count")) == ["1"]  # 2.5 to even


def test_snapshots(spark):
    schema = "catalog_number long, lat double, lon double, ts long"
    new = spark.createDataFrame([(1, 1.0, 1.0, 5), (2, 1.0, 1.0, None), (3, 2.0, 1.0, 5), (4, 1.0, 1.0, 6), (5, 0.0, 0.0, 1)], schema)
    old = spark.createDataFrame([(1, 1.0, 1.0, 5, 10.0, 20.0), (2, 1.0, 1.0, None, 11.0, 21.0), (3, 1.0, 1.0, 5, 12.0, 22.0), (4, 1.0, 1.0, 5, 13.0, 23.0)], schema + ", s double, t double")
    got = {r["catalog_number"]: (r["s"], r["t"]) for r in incremental.carry_forward(new, old, ["s"], ["t"]).collect()}
    assert got == {1: (10.0, 20.0), 2: (11.0, 21.0), 3: (None, None), 4: (13.0, None), 5: (None, None)}
    assert tuple(incremental.carry_counts(new, old).first()) == (3, 1, 1)
    assert incremental.stale_columns(["a", "s", "t_avg_24h", "zz"], ["a"], ["s"], ["t"]) == ["zz"]


def test_windows_and_streams(spark, tmp_path):
    r = np.random.default_rng(0)
    hours = sorted(r.choice(4000, 900, replace=False).tolist())
    data = [(c, h, float(c + h % 7)) for c in (1, 2) for h in hours]
    got = {(x["cell"], x["hour"]): (x["sum"], x["n"]) for x in timeseries.trailing(spark.createDataFrame(data, "cell int, hour long, value double"), 100, days=2).collect()}
    for c, h, _ in data[::37]:
        own = [v for d, k, v in data if d == c and h - 100 < k <= h]
        assert got[c, h] == (pytest.approx(sum(own)), len(own))
    schema = "cell int, ts timestamp, source_rank int, version int, value double"
    one = spark.createDataFrame([(1, h * 3600, 0, 0, 1.0) for h in range(10)], "cell int, t long, source_rank int, version int, value double").withColumn("ts", F.timestamp_seconds("t")).select("cell", "ts", "source_rank", "version", "value")
    one.write.parquet(f"{tmp_path}/in")
    run = lambda: windows.maintain(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/out", 3, f"{tmp_path}/cp").awaitTermination()
    run()
    one.where("hour(ts) = 4").withColumns({"value": F.lit(5.0), "source_rank": F.lit(1)}).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    state = {x["hour"]: x["sum"] for x in windows.current(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert [state[h] for h in range(2, 8)] == [3, 3, 7, 7, 7, 3] and len(state) == 10
    late = one.where("hour(ts) = 9").withColumns({"ts": F.expr("ts + INTERVAL 72 HOUR"), "value": F.lit(2.0)})
    late.write.mode("append").parquet(f"{tmp_path}/in")
    run()
    state = {x["hour"]: x["sum"] for x in windows.current(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert state[81] == 2 and [state[h] for h in range(2, 8)] == [3, 3, 7, 7, 7, 3] and len(state) == 11
    assert windows.sliding(one, 3).where("n = 3 AND sum = 3").count() == 8


def test_density(spark):
    r = np.random.default_rng(1)
    df = spark.createDataFrame([("a", float(x)) for x in np.abs(r.normal(3, 1, 3000))] + [("b", 2.0)], "g string, v double")
    d = {x["g"]: x for x in density.density(df, "g", "v", "ratio").collect()}
    area = np.trapezoid(d["a"]["density"], d["a"]["points"])  # of 1 from 0 up, what lies between the extremes
    assert 0.99 < area < 1 and d["a"]["mode"] == pytest.approx(3, abs=0.3)
    assert d["b"]["points"] == [] and d["b"]["mode"] is None
    c = density.density(df.withColumn("v", F.col("v") * 10 + 340), "g", "v", "circular").where("g = 'a'").first()
    assert c["mode"] == pytest.approx(10, abs=6) and sum(c["density"]) * 360 / 128 == pytest.approx(1, abs=0.02)
    t = spark.createDataFrame([("a", 0.6, 0.3, 0.1), ("a", 0.5, 0.3, 0.2), ("a", 0.6, 0.2, 0.2)], "g string, x double, y double, z double")
    assert len(density.ternary(t, "g", ("x", "y", "z")).first()["density"]) == 325


def test_names(spark):
    row = lambda c: spark.range(1).select(c).first()[0]
    assert row(text.title_case(F.lit("o'brien BLUE-winged TEAL USA"))) == "O'brien Blue-Winged TEAL USA"
    assert row(text.cleaned(F.lit("Poa annua var. minor L."), F.lit("VARIETY"))) == "Poa_annua_var._minor"
    assert row(text.cleaned(F.lit("Poa × annua L."), F.lit("SPECIES"))) == "Poa_×_annua"
    assert row(text.observation_id(F.lit("https://x/observations/123"))) == 123 and row(text.observation_id(F.lit("12 34"))) is None
    assert row(units.invert(units.convert(F.lit(10.0), "°C"), "°C")) == pytest.approx(10)
    assert row(weather.weather_code(F.lit(90.0), F.lit(2.0), F.lit(0.0), F.lit(-3.0))) == 71
    names = spark.createDataFrame([("1", "Blue_Winged Teal"), ("1", "teal"), ("2", "Blue tit"), ("3", "oak")], "taxon_key string, name string")
    assert [(r["taxon_key"], r["name"]) for r in search.fuzzy_top(names, "blue t").collect()][0][0] == "2"
    assert search.fuzzy_top(names, "").count() == 0


def test_readers_and_sinks(spark, tmp_path):
    head = "gbifID\ttaxonRank\tscientificName\tdecimalLatitude\tdecimalLongitude\tcatalogNumber\tcoordinateUncertaintyInMeters\teventDate\teventTime\tinformationWithheld\tdynamicProperties\treproductiveCondition\tgbifRegion\tlevel0Gid\tlevel1Gid\tlevel2Gid"
    good = '1\tSPECIES\tPoa annua L.\t10.5\t20\tc1\t30\t2020-01-02\t03:04:05Z\t\t{"evidenceOfPresence":["organism","scat"]}\tflowers\tEU\tg\t\t'
    bad = "2\tGENUS\tPoa\t10\t20\tc2\t\t2020\t\t\t\t\t\t\t\t"
    odd = "3\tSPECIES\tPoa annua\tx\t20\tc3\t\tlong ago\tNA\tby taxon\t\t\t\t\t\t"
    (tmp_path / "o.txt").write_text("\n".join([head, good, bad, odd, odd.replace("\tx\t", "\t1\t")]) + "\n")
    got = {r["catalogNumber"]: r for r in readers.occurrences(readers.delimited(spark, str(tmp_path / "o.txt"))).collect()}
    assert set(got) == {"c1", "c3"} and got["c1"]["eventTimestamp"] == 1577934245 and got["c1"]["dp"] == "organism|scat"
    assert got["c3"]["eventTimestamp"] is None and got["c3"]["obscured"] == "Hidden"
    (tmp_path / "u.csv").write_text("Latitude,Long itude,x\n1,2,a\n3,400,b\n")
    with pytest.raises(ValueError, match="1 rows"):
        readers.upload(spark, str(tmp_path / "u.csv"))
    df = spark.createDataFrame([(str(i), i) for i in range(20)], "taxon_key string, v int")
    sinks.by_taxon(df, str(tmp_path / "t"), 2)
    plan = readers.projected(spark, str(tmp_path / "t"), ["v"], [("taxon_key", "in", ["3", "4"])])
    assert sorted(r["v"] for r in plan.collect()) == [3, 4]
    assert sinks.union_all([df, df.select("v")]).where("taxon_key IS NULL").count() == 20


def test_catalog_agrees_with_sql(spark):
    """Some whole queries of the catalogue on the smallest tables; the driver compares all of them."""
    from pathlib import Path

    import duckdb

    from lichen.plans.catalog import CATALOG

    d = "/root/testdata/sf0.001"
    if not Path(d).exists():
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in "region nation customer part orders lineitem events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name in ("stats_continuous_rollup", "stats_nominal", "rank_positions", "carry_forward_counts", "polygon_filter", "hilbert_index", "top_classes"):
        f, sql = CATALOG[name]
        got, want = f(spark, d), con.sql(sql)
        names = sorted(got.columns)
        assert names == sorted(want.columns), name
        cell = lambda v: float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v
        pick = lambda rows, have: sorted((tuple(cell(r[have.index(n)]) for n in names) for r in rows), key=repr)
        assert pick(map(tuple, got.collect()), got.columns) == pick(want.fetchall(), want.columns), name

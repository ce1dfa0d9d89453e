"""Work that must not grow faster than the input: what the plans make, and that the results are those of the plain way."""

import math
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from lichen.operators import density, naming, places, ranking, stats, timeseries


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_bin(v, low, high):
    """Values replaced by the mean of their bin of 512."""
    at = np.minimum(511, np.floor((v - low) / (high - low) * 512))
    return np.array([v[at == b].mean() for b in at])


def plain_circle(degrees):
    degrees = by_bin(np.array(degrees) % 360, 0, 360)
    a, k = np.radians(degrees), np.arange(1, 256)
    spread = math.sqrt(-2 * math.log(max(min(1.0, abs(np.exp(1j * a).mean())), 1e-10)))
    h = max((4 / (3 * len(a))) ** 0.2 * spread, 0.05)
    c = np.exp(-1j * np.outer(k, a)).mean(1) * np.exp(-0.5 * (k * h) ** 2)
    return math.degrees(h), [max(0.0, (1 + 2 * (np.exp(1j * k * math.radians(p)) @ c).real) / 360) for p in np.linspace(0, 360, 128, endpoint=False)]


def plain_line(v):
    v = np.array(v)
    h = 1.06 * v.std(ddof=1) * len(v) ** -0.2
    low, high = v.min(), v.max()
    v = by_bin(v, low, high)
    bump = lambda p, c: math.exp(-0.5 * ((p - c) / h) ** 2) / (len(v) * h * math.sqrt(2 * math.pi))
    return h, [sum(bump(p, c) + (bump(p, -c) if low >= 0 else 0) for c in v) for p in np.linspace(low, high, 128)]


@pytest.mark.parametrize("scale", ["circular", "ratio"])
def test_curves_of_many_groups_are_taken_by_batch(spark, scale):
    r = np.random.default_rng(5)
    groups = {g: [float(x) for x in r.uniform(-40 if g % 3 == 0 else 5, r.choice([8, 60, 300]), 1 + g % 7)] for g in range(1100)}
    groups |= {2000: [7.0] * 4, 2001: [float(x) for x in r.normal(50, 9, 3000)]}
    df = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v] + [(3000, None), (3000, math.nan), (None, 1.0)], "g long, v double")
    found = density.density(df, "g", "v", scale)
    assert "FlatMapGroups" not in plan_of(found)  # a call of Python for each group
    got = {x["g"]: x for x in found.collect()}
    assert set(got) == set(groups) and all(got[g]["count"] == len(v) for g, v in groups.items())
    for g in [*range(0, 1100, 13), 2000, 2001]:
        v, x = groups[g], got[g]
        if len(v) < 2 or (scale == "circular" and len(set(by_bin(np.array(v) % 360, 0, 360))) < 2):
            assert (x["points"], x["density"], x["mode"], x["bandwidth"], x["entropy"]) == ([], [], None, 0.0, 0.0)
        elif g != 2000:
            h, d = plain_circle(v) if scale == "circular" else plain_line(v)
            assert x["bandwidth"] == pytest.approx(h)
            assert np.abs(np.array(d) - x["density"]).max() < 1e-12
            assert x["mode"] == pytest.approx(x["points"][int(np.argmax(x["density"]))])


def test_a_circular_mean_a_last_bit_under_zero_is_that_of_sql(spark):
    import duckdb

    values = [("a", 360.0), ("b", 0.0), ("c", 350.0), ("c", 10.0), ("d", 270.0), ("e", 359.0), ("e", 1.0), ("f", 720.0), ("g", 180.0)]
    got = {r["g"]: r["circular_mean"] for r in stats.circular(spark.createDataFrame(values, "g string, v double"), ["g"], "v").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (g VARCHAR, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", values)
    want = con.execute("SELECT g, degrees(atan2(s, c)) - 360 * floor(degrees(atan2(s, c)) / 360) FROM (SELECT g, avg(cos(radians(v))) AS c, avg(sin(radians(v))) AS s FROM t GROUP BY 1)").fetchall()
    assert got == pytest.approx(dict(want), abs=1e-9) and got["a"] == 360


def test_synonyms_are_counted_without_pairs(spark):
    r = np.random.default_rng(7)
    ids = [(f"n{r.integers(0, 12)}", int(i)) for i in r.integers(0, 300, 700)] + [(None, 5), ("n1", None), ("only", 7)]
    pick = lambda: [f"n{i}" for i in r.integers(0, 14, r.integers(0, 4))]
    taxa = [(k, None if k % 11 == 0 else k, pick()) for k in range(400)] + [(900, 7, ["only"]), (901, 8, ["only", None]), (902, 1, None)]
    t, i = spark.createDataFrame(taxa, "taxon_key long, id long, synonyms array<string>"), spark.createDataFrame(ids, "name string, id long")
    listed = {x["taxon_key"]: (len(x["ids"]), x["ids"][0]) for x in naming.synonym_ids(t, i).collect()}
    found = [tuple(x) for x in naming.synonym_counts(t, i).collect()]
    assert len(found) == len(listed) > 250 and {k: (n, a) for k, n, a in found} == listed and 900 not in listed and listed[901] == (1, 7)


def test_synonym_ids_of_one_name_take_no_square(spark, tmp_path):
    from lichen.plans import CATALOG

    # 60,000 parts of a name are 3.6e9 pairs
    spark.range(60_000).select(F.col("id").alias("p_partkey"), F.when(F.col("id") == 9, "rare").otherwise("red ring").alias("p_name")).write.parquet(str(tmp_path / "part.parquet"))
    got = CATALOG["synonym_ids"][0](spark, str(tmp_path)).groupBy("n", "first").agg(F.count("*").alias("k")).collect()
    assert sorted(map(tuple, got)) == [(59998, 0, 59998), (59998, 1, 1)]


ODD = [(1000, None, 4.0), (1001, math.nan, 4.0), (1002, 4.0, math.nan), (1003, 2.0, 2.0), (1004, 2.0, 2.0), (1005, 89.0, 170.0)]


def check_found(monkeypatch, find, want, most):
    """Results as wanted, and half of the cells have at most ``most`` regions to compare a point with."""
    kept, prune = [], places._first_of_cells
    monkeypatch.setattr(places, "_first_of_cells", lambda x: kept.append(prune(x)) or kept[-1])
    assert sorted(map(tuple, find().collect())) == sorted(want.items())
    assert kept[0].groupBy("i", "j").count().agg(F.percentile("count", F.lit(0.5))).first()[0] <= most


def test_boxes_of_one_cell_are_not_all_met(spark, monkeypatch):
    r = np.random.default_rng(11)
    corner, size = r.uniform(-8, 4, (3000, 2)), r.uniform(3, 12, (3000, 2))
    boxes = [(f"r{i:05}", *map(float, corner[i]), *map(float, corner[i] + size[i])) for i in range(3000)]
    boxes += [("r99999", *boxes[5][1:]), ("r00000", 0.0, 0.0, 5.0, 5.0)]
    pts = [(k, float(a), float(o)) for k, (a, o) in enumerate(r.uniform(-12, 14, (300, 2)))] + [(500, 0.0, 0.0), (501, 5.0, 5.0)] + ODD
    inside = lambda a, o: min((b[0] for b in boxes if a is not None and b[1] < a < b[3] and b[2] < o < b[4]), default=None)
    got = lambda: places.first_region(spark.createDataFrame(pts, "k long, lat double, lon double"), "k", spark.createDataFrame(boxes, "region string, south double, west double, north double, east double"), 2.0)
    check_found(monkeypatch, got, {k: inside(a, o) for k, a, o in pts}, 120)


def test_boxes_that_hold_a_point_are_not_sorted(spark):
    # no box holds a whole cell, some have a name in common and some none
    boxes = [(None if i % 50 == 7 else f"r{(i * 37) % 251:03}", i % 7 * 0.1, i % 11 * 0.1, i % 7 * 0.1 + 1 + i % 13 * 0.01, i % 11 * 0.1 + 1 + i % 17 * 0.01) for i in range(1500)]
    boxes.append((None, 5.0, 5.0, 5.5, 5.5))
    pts = [(k, k % 40 * 0.05, k % 37 * 0.06) for k in range(600)] + [(700, 5.2, 5.2)] + ODD
    got = places.first_region(spark.createDataFrame(pts, "k long, lat double, lon double"), "k", spark.createDataFrame(boxes, "region string, south double, west double, north double, east double"), 9.0)
    inside = lambda a, o: min((b[0] for b in boxes if b[0] is not None and a is not None and b[1] < a < b[3] and b[2] < o < b[4]), default=None)
    assert sorted(map(tuple, got.collect())) == sorted((k, inside(a, o)) for k, a, o in pts)
    assert re.search(r" HashAggregate\(keys=\[[^]]*i#\d+L, j#\d+L\]", plan_of(got))  # of names it would be a SortAggregate


def test_outlines_of_one_cell_are_not_all_met(spark, monkeypatch):
    r = np.random.default_rng(12)
    shapes = []
    for i in range(600):
        turn = np.sort(r.uniform(0, 2 * math.pi, int(r.integers(3, 9))))
        ring = [(float(a), float(o)) for a, o in zip(r.uniform(-5, 5) + np.sin(turn) * r.uniform(3, 9), r.uniform(-5, 5) + np.cos(turn) * r.uniform(3, 9), strict=True)]
        shapes.append((f"r{i:04}", [ring, [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]] if i % 4 == 0 else [ring]))  # a hole, or a place of its own
    shapes.append(("r9999", shapes[3][1]))

    def holds(rings, a, o):
        sides = [(p, q) for x in rings for p, q in zip(x, [*x[1:], x[0]], strict=True)]
        return sum((a > p[0]) != (a > q[0]) and o < p[1] + (a - p[0]) * ((q[1] - p[1]) / (q[0] - p[0])) for p, q in sides) % 2 == 1

    pts = [(k, float(a), float(o)) for k, (a, o) in enumerate(r.uniform(-12, 12, (300, 2)))] + [(500, 0.5, 0.5), (501, 5.0, 5.0)] + ODD
    want = {k: min((n for n, rings in shapes if a is not None and not math.isnan(a + o) and holds(rings, a, o)), default=None) for k, a, o in pts}
    regions = spark.createDataFrame([(n, [[{"lat": a, "lon": o} for a, o in x] for x in rings]) for n, rings in shapes], "region string, rings array<array<struct<lat: double, lon: double>>>")
    got = lambda: places.region_at(spark.createDataFrame(pts, "k long, lat double, lon double"), "k", regions, 2.0)
    check_found(monkeypatch, got, want, 120)


def test_a_window_is_added_up_once_for_the_points_that_share_it(spark):
    series = [(c, h, float(h * (c + 1) % 17) if h % 7 else None) for c in range(2) for h in range(200)]
    pts = [(k, k % 3, 100 + k % 2) for k in range(4000)] + [(9000, None, 5)]
    got = timeseries.at_observations(spark.createDataFrame(pts, "k long, cell long, hour long"), spark.createDataFrame(series, "cell long, hour long, value double"), 24, "k")
    sums = lambda c, h: [v for x, y, v in series if x == c and h - 24 < y <= h and v is not None]
    want = {k: (sum(s) if (s := sums(c, h)) else None, len(s)) for k, c, h in pts}
    assert {r["k"]: (r["sum"], r["n"]) for r in got.collect()} == want and got.count() == len(pts)
    assert "keys=[k#" not in plan_of(got)  # no sum for each point


def test_a_chain_of_filters_is_one_aggregation(spark):
    tall = spark.createDataFrame([("a", "n", "class_1", 0.25), ("a", "n", "total_samples", 10.0), ("b", "n", "total_samples", 3.0), ("c", "n", "class_1", 0.9), ("d", "m", "class_1", 0.9), (None, "n", "total_samples", 9.0)], "taxon_key string, variable string, metric string, value double")
    keys = lambda *texts: {r["taxon_key"] for r in ranking.stat_filters(tall, list(texts)).collect()}
    assert keys("n:class_1:lte:0.5") == {"a", "b", None} and keys("n:class_1:eq:2:count") == {"a"} and keys() == {"a", "b", "c", "d", None}
    assert keys("n:class_1:lte:0.5", "n:class_2:lt:1:count") == {"a", "b", None} and keys("n:class_1:gt:0.5", "m:class_1:gt:0.5") == set()
    assert "Join" not in plan_of(ranking.stat_filters(tall, ["n:class_1:lte:0.5", "n:class_2:lt:1:count"]))

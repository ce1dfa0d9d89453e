"""Tiles, outlines, descriptions, exports and jobs on small tables, against plain Python."""

import math
import os
import random
import sqlite3
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lichen.functions import text, weather
from lichen.operators import density, naming, places, profiles, stats, tiles
from lichen.plans import jobs
from lichen.sources import exports, layers, sinks
from lichen.sources.session import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_weather_codes_at_their_limits(spark):
    # (cloud %, rain mm, snow mm of water, hours, degrees) -> code
    cases = [((0, 0, 0, 1, None), 0), ((19.9, 0, 0, 1, None), 0), ((20, 0, 0, 1, None), 1), ((50, 0, 0, 1, None), 2), ((80, 0, 0, 1, None), 3)]
    cases += [((90, r, 0, 1, None), c) for r, c in ((0.009, 3), (0.01, 51), (0.49, 51), (0.5, 53), (1.0, 55), (1.29, 55), (1.3, 61), (2.5, 63), (7.6, 65))]
    cases += [((90, 0, s, 1, None), c) for s, c in ((0.09, 3), (0.1, 71), (2.0, 73), (8.0, 75))]
    cases += [((90, 3.9, 0, 3, None), 61), ((90, 2, 0, 1, -3), 71), ((90, 3, 0, 1, -0.1), 73), ((90, 8, 0, 1, -1), 75), ((90, 0.7, 0, 1, -9), 53), ((90, 0, 8, 1, 0.1), 65), ((90, 0, 2, 1, 5), 63), ((90, 0, 0.1, 1, 5), 61)]
    cases += [((90, 2, 0, 1, 0), 61), ((90, 2, 0, 1, math.nan), 61), ((None, 2, 0, 1, 5), None), ((90, math.nan, 0, 1, 5), None), ((90, 1, None, 1, 5), None)]
    lit = lambda v: F.lit(v).cast("double")
    got = one(spark, *(weather.weather_code(lit(c), lit(r), lit(s), lit(t), h).alias(f"c{i}") for i, ((c, r, s, h, t), _) in enumerate(cases)))
    assert got == tuple(x for _, x in cases)


def test_elevations_that_stand_for_none(spark):
    lit = lambda v: F.lit(v).cast("double")
    at = lambda m, o: weather.elevation_corrected(lit(10), lit(m), lit(o))
    got = one(spark, at(1200, 200).alias("a"), at(math.nan, 200).alias("b"), at(1200, math.nan).alias("c"), at(1200, -9000).alias("d"), at(None, 1).alias("e"))
    assert got == (16.5, 10, 10, 10, 10)


def test_title_case_of_odd_words(spark):
    cases = {"king's-crown": "King's-crown", "BLUE-winged teal": "Blue-Winged Teal", "NW usa USA": "NW Usa USA", "cows' milk": "Cows Milk", "  x  ": "X", "o'BRIEN's": "O'brien's", "": "", "a-": "A-"}
    assert one(spark, *(text.title_case(F.lit(k)).alias(f"c{i}") for i, k in enumerate(cases))) == tuple(cases.values())


def test_densities_of_equal_values(spark):
    df = spark.createDataFrame([("a", 50.0)] * 9 + [("b", 0.0)] * 3 + [("c", 4.0)] + [("d", x) for x in (1.0, 2.0, 4.0, 4.5, 9.0)], "g string, v double")
    d = {r["g"]: r for r in density.density(df, "g", "v", "interval").collect()}
    assert (d["a"]["bandwidth"], d["a"]["points"][0], d["a"]["points"][-1]) == (0.5, 45.0, 55.0) and d["a"]["mode"] == pytest.approx(50, abs=0.1)
    assert (d["b"]["bandwidth"], d["b"]["points"][0], d["b"]["points"][-1]) == (0.1, -1.0, 1.0)
    assert d["c"]["points"] == [] and d["c"]["mode"] is None
    x = np.array([1.0, 2.0, 4.0, 4.5, 9.0])
    h = 1.06 * x.std(ddof=1) * 5**-0.2
    r = {y["g"]: y for y in density.density(df, "g", "v", "ratio").collect()}["d"]
    brute = [sum(math.exp(-0.5 * ((p - s * v) / h) ** 2) for v in x for s in (1, -1)) / (5 * h * math.sqrt(2 * math.pi)) for p in r["points"]]
    assert r["bandwidth"] == pytest.approx(h) and np.abs(np.array(brute) - r["density"]).max() < 1e-9
    c = density.density(df.where("g = 'd'"), "g", "v", "circular").first()
    a = np.radians(x)
    spread = math.sqrt(-2 * math.log(abs(np.exp(1j * a).mean())))
    assert c["bandwidth"] == pytest.approx(math.degrees(max((4 / 15) ** 0.2 * spread, 0.05)))


def test_ternary_has_a_sample_and_no_thin_groups(spark):
    r = random.Random(3)
    rows = [("a", r.uniform(1, 60), r.uniform(1, 60), r.uniform(1, 60)) for _ in range(400)] + [("b", 1.0, 1.0, 1.0)] * 5 + [("c", 1.0, 2.0, 3.0), ("d", math.nan, 1.0, 1.0), ("d", 0.0, 0.0, 0.0)]
    got = {x["g"]: x for x in density.ternary(spark.createDataFrame(rows, "g string, x double, y double, z double"), "g", ("x", "y", "z")).collect()}
    assert set(got) == {"a"} and got["a"]["count"] == 400 and len(got["a"]["density"]) == 325 and max(got["a"]["density"]) == 1
    assert len(got["a"]["sample"]) == 200 and all(abs(sum(p) - 1) < 0.002 for p in got["a"]["sample"])


def test_histogram_of_a_wide_span(spark):
    df = spark.createDataFrame([("a", 3), ("a", 3), ("a", 400_003), ("b", -2), ("b", None)], "g string, v long")
    h = stats.histogram(df, ["g"], "v")
    assert h.where("g = 'a'").count() == 400_001 and h.where("g = 'b'").collect()[0]["bin"] == -2
    assert {(r["bin"], r["n"]) for r in h.where("n > 0 AND g = 'a'").collect()} == {(3, 2), (400_003, 1)}
    assert h.groupBy("g", "bin").count().where("count > 1").count() == 0


def test_value_range_of_any_size(spark):
    v = np.random.default_rng(5).normal(size=3000)
    df = spark.createDataFrame([(i % 2900, float(x)) for i, x in enumerate(v)] + [(9999, None)], "k long, v double")
    first = np.array([min(v[i::2900]) for i in range(2900)])
    got = stats.value_range(df, "k", "v").first()
    assert (got["min"], got["max"]) == (first.min(), first.max())
    assert got["p_low"] == pytest.approx(np.quantile(first, 0.001), abs=1e-12) and got["p_high"] == pytest.approx(np.quantile(first, 0.999), abs=1e-12)
    assert tuple(stats.value_range(df.limit(0), "k", "v").first()) == (None, None, None, None)


def test_regions_with_holes(spark):
    outer, hole, far = [(0, 0), (0, 10), (10, 10), (10, 0)], [(3, 3), (3, 7), (7, 7), (7, 3)], [(20, 20), (30, 20), (25, 31)]
    ring = lambda r: [{"lat": float(a), "lon": float(b)} for a, b in r]
    regions = spark.createDataFrame([("b", [ring(outer), ring(hole), ring([(1, 1), (2, 2)])]), ("a", [ring(far)]), ("none", [])], "region string, rings array<array<struct<lat: double, lon: double>>>")
    rnd = random.Random(1)
    pts = [(i, rnd.uniform(-2, 33), rnd.uniform(-2, 33)) for i in range(600)] + [(-1, None, 3.0)]

    def inside(y, x, rings):
        odd = False
        for r in rings:
            for (y1, x1), (y2, x2) in zip(r, [*r[1:], r[0]], strict=True):
                odd ^= (y > y1) != (y > y2) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
        return odd

    want = {i: None if y is None else "a" if inside(y, x, [far]) else "b" if inside(y, x, [outer, hole]) else None for i, y, x in pts}
    got = places.region_at(spark.createDataFrame(pts, "k long, lat double, lon double"), "k", regions, 4.0)
    assert {r["k"]: r["region"] for r in got.collect()} == want and set(want.values()) == {"a", "b", None}


def test_outlines_keep_their_common_border(spark):
    r = random.Random(2)
    border = [(y, 5 + r.uniform(-1, 1)) for y in range(11)]
    left, right = [*border, (10, 0), (0, 0)], [*border, (10, 10), (0, 10)]
    ring = lambda p: [[{"lat": float(a), "lon": float(b)} for a, b in p]]
    df = spark.createDataFrame([(1, ring(left)), (2, ring(right)), (3, ring([(0, 0), (0, 0.1), (0.1, 0)]))], "k long, rings array<array<struct<lat: double, lon: double>>>")
    got = {x["k"]: [(p["lat"], p["lon"]) for q in x["rings"] for p in q] for x in df.select("k", tiles.simplified(F.col("rings"), 2.0).alias("rings")).collect()}
    assert set(got[1]) & set(got[2]) >= {p for p in got[1] if 3 <= p[1] <= 7} and len(got[1]) < len(left) and got[3] == []


def test_overviews(spark):
    f = lambda w, h, x, y: tiles.overview_factors(F.lit(w), F.lit(h), F.lit(x).cast("double"), F.lit(y).cast("double"))
    got = one(spark, f(40_000, 20_000, 1 / 120, 1 / 120).alias("a"), f(40_000, 20_000, 0.18, 0.1).alias("b"), f(6, 9, 1e-9, 1).alias("c"), f(9, 9, 0, 1).alias("d"))
    assert got == ([2, 4, 8, 16, 32], [2], [2, 4], [])


def test_words_for_classes():
    legend = [{"id": 1, "group": "Forest", "label": "forests", "attributes": ["boreal"], "solo": "taiga"}, {"id": 2, "group": "forest", "label": "forests", "attributes": ["temperate"]}, {"id": 3, "group": "desert", "label": "deserts", "attributes": ["cold"]}, {"id": 4, "memberships": [{"group": "grassland"}, {"group": "savanna"}]}]
    w = profiles.Wording(legend)
    assert w.lines({1: 1.0}) == [("Almost always in", "taiga")]
    assert w.lines({1: 0.5, 2: 0.45}) == [("Primarily in", "forests")]  # all kinds that occur: no adjective
    assert w.lines({1: 0.5, 2: 0.04, 3: 0.3}) == [("Often in", "taiga"), ("Sometimes in", "cold deserts")]
    assert w.lines({2: 0.25, 1: 0.04, 3: 0.22}) == [("Often in", "temperate forests and cold deserts")]
    assert w.lines({4: 0.7}) == [("Commonly in", "grassland and savanna")]  # in full for both, not added up
    assert w.lines({3: 0.04}) == [] and w.lines({}) == []
    axes = profiles.Wording([{"id": 1, "group": "g", "label": "woods", "attributes": ["open", "dry"]}, {"id": 2, "group": "g", "label": "woods", "attributes": ["closed", "dry"]}], {"g": [["dry", "wet"], ["open", "closed"]]}, suffix=" land")
    assert axes.lines({1: 0.3, 2: 0.3}) == [("Commonly in", "dry woods land")]
    share = profiles.Wording([{"id": 1, "group": "a", "attributes": ["warm"]}, {"id": 2, "group": "b", "attributes": ["warm"]}], share=True)
    assert share.lines({1: 0.3, 2: 0.25}) == [("Often in", "warm a and b")]


def test_sentences(spark):
    n = lambda v: F.lit(v).cast("double")
    assert one(spark, profiles.elevation_line(n(1234), n(5678)).alias("a"), profiles.elevation_line(n(1234), n(1241)).alias("b"), profiles.elevation_line(n(6), n(6.2)).alias("c"), profiles.elevation_line(n(None), n(1)).alias("d"), profiles.elevation_line(n(100), n(200), True).alias("e")) == ("Found from 1,200 to 5,700 m elevation", "Found from 1,230 to 1,240 m elevation", "Found at 6 m elevation", None, "Found from 300 to 700 ft elevation")
    assert one(spark, profiles.slope_line(n(2), n(1)).alias("a"), profiles.slope_line(n(20), n(2)).alias("b"), profiles.slope_line(n(20), n(9)).alias("c"), profiles.slope_line(n(9), n(None)).alias("d")) == ("Often on flat areas", "Often on flat areas to steep slopes", "Often on moderate to steep slopes", "Often on moderate slopes")
    assert one(spark, profiles.aspect_line(n(0.4), n(350), F.lit(101), n(6)).alias("a"), profiles.aspect_line(n(0.2), n(200), F.lit(101), n(6)).alias("b"), profiles.aspect_line(n(0.2), n(200), F.lit(100), n(6)).alias("c")) == ("Strongly prefers north-facing slopes", "Prefers south-facing slopes", None)
    s, y = profiles.weather_lines(n(30), n(-6), n(100), n(300), n(60), n(700))
    assert one(spark, s.alias("a"), y.alias("b")) == ("Prefers hot, arid summers and very cold, moderately snowy winters", "Typically subhumid locations overall")
    s, y = profiles.weather_lines(n(None), n(None), n(None), n(300), n(1), n(None))
    assert one(spark, s.alias("a"), y.alias("b")) == ("Prefers wet winters", None)
    assert one(spark, profiles.soil_line(n(1), n(7), F.lit("slightly saline")).alias("a"), profiles.soil_line(n(5), n(None), F.lit(None).cast("string")).alias("b")) == ("Usually very nutrient poor, neutral, and slightly saline soil", None)
    c = F.array(*(F.struct(F.lit(a).alias("name"), F.lit(b).alias("fraction")) for a, b in (("Clay", 0.5), ("Sandy Loam", 0.42), ("Silt", 0.1))))
    assert one(spark, profiles.texture_line(c, F.lit("coarse")).alias("a"), profiles.texture_line(F.slice(c, 1, 0), F.lit(None).cast("string")).alias("b")) == ("Prefers coarse, clay-rich and sandy loam soil", None)
    assert one(spark, profiles.labels(F.array(F.lit("a, b"), F.lit("c"))).alias("a")) == ("a, b; and c",)


def test_places_in_words(spark):
    known = [("US", 0, "United States", None), ("CA", 0, "Canada", None), ("MX", 0, "Mexico", None), ("BR", 0, "Brazil", None), ("US.1", 1, "Texas", "US"), ("US.2", 1, "Ohio", "US"), ("US.1.1", 2, "Bexar", "US.1"), ("US.1.2", 2, "Travis", "US.1")]
    counts = [("one", "US", 9), ("one", "US.1", 9), ("one", "US.1.1", 4), ("one", "US.1.2", 5), ("two", "US", 5), ("two", "US.1", 2), ("two", "US.2", 3), ("many", "US", 1), ("many", "CA", 4), ("many", "MX", 3), ("many", "BR", 2), ("some", "CA", 1), ("some", "US", 2), ("bare", "CA", 3), ("state", "US", 1), ("state", "US.2", 1), ("no", "XX", 3)]
    k, c = spark.createDataFrame(known, "gid string, level int, name string, parent_gid string"), spark.createDataFrame(counts, "taxon_key string, gid string, n long")
    got = {r["taxon_key"]: r["text"] for r in profiles.location_texts(c, k).collect()}
    assert got == {"one": "Travis and Bexar in Texas", "two": "Ohio and Texas in the United States", "many": "Canada, Mexico, Brazil and other countries", "some": "the United States and Canada", "bare": "Canada", "state": "Ohio in the United States"}
    within = lambda g: {r["taxon_key"]: r["text"] for r in profiles.location_texts_in(c, k, g).where("taxon_key IN ('one', 'two', 'bare')").collect()}
    assert within("US") == {"one": "Travis and Bexar in Texas", "two": "Ohio and Texas in the United States", "bare": "the United States"}
    assert within("US.1") == {"one": "Travis and Bexar in Texas", "two": "Texas", "bare": "Texas"} and within("US.1.1")["one"] == "Bexar in Texas" and within("?") == {}
    taxa = spark.createDataFrame([("one",), ("none",)], "taxon_key string")
    lines = profiles.location_texts(c, k).select("taxon_key", profiles.text_lines(F.col("text"), F.lit(None).cast("string")).alias("lines"))
    p = {r["taxon_key"]: [(s["id"], s["title"], [x["body"] for x in s["lines"]]) for s in r["sections"]] for r in profiles.profile(taxa, {"locations": lines, "soil": lines.limit(0)}).collect()}
    assert p == {"one": [("locations", "Locations", ["Travis and Bexar in Texas"])], "none": []}


def test_archives_databases_and_grids(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("Names-b.csv", "id,vernacularName,language\n1,Oak,en\n1,Eiche,de\n2,,en\n")
        z.writestr("Names-a.csv", 'id,vernacularName,language\n1,"Common, oak",ENG\n1,Oak,en\n')
        z.writestr("other.csv", "x\n1\n")
    rows = exports.archive_rows(spark, f"file://{tmp_path}/a.zip", "Names", ["id", "vernacularName", "language"])
    assert {r["id"]: r["names"] for r in exports.english_names(rows).collect()} == {"1": ["Common, oak", "Oak"]}
    whole = (tmp_path / "a.zip").read_bytes()
    assert exports.opens(whole, "other.csv") and not exports.opens(whole[:-30], "other.csv") and not exports.opens(whole, "none.csv")
    with sqlite3.connect(tmp_path / "g.gpkg") as db:
        db.execute("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT)")
        db.execute("INSERT INTO gpkg_contents VALUES ('meta', 'attributes'), ('adm', 'features')")
        db.execute("CREATE TABLE adm (GID_1 TEXT, NAME_1 TEXT, geom BLOB)")
        db.executemany("INSERT INTO adm VALUES (?, ?, ?)", [(f"g{i % 40}", f"n{i % 40}", b"x") for i in range(100)])
    got = exports.places(spark, f"{tmp_path}/g.gpkg", 1, {"g3": "Three"}).collect()
    assert sorted(map(tuple, got)) == sorted((f"g{i}", "Three" if i == 3 else f"n{i}") for i in range(40))
    with pytest.raises(ValueError, match="level 2"):
        exports.place_table(f"{tmp_path}/g.gpkg", 2)
    a = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    a[1, 2, 3] = np.nan
    np.save(tmp_path / "chunk.npy", a)
    cells = exports.grids(spark, f"file://{tmp_path}/chunk.npy", F.lit(100)).collect()
    assert {(r["row"], r["col"], r["step"] - 100): r["value"] for r in cells} == {k: v for k, v in np.ndenumerate(a) if np.isfinite(v)}
    assert exports.first_existing("/a", ["/b", "/c"], "x.tif", ["/c/x.tif"]) == "/c/x.tif" and exports.first_existing("/a", ["/b"], "x.tif", []) == "/a/x.tif"


def test_requests_are_used_again(spark):
    rows = [(0, "k0", "PREPARING", "CSV", ["P", "F"], "c", True), (1, "k1", "SUCCEEDED", "CSV", ["F", "P"], "c", True), (2, "k2", "SUCCEEDED", "CSV", ["F"], "c", True), (3, "k3", "FAILED", "ZIP", ["F", "P"], "c", True)]
    df = spark.createDataFrame(rows, "place int, key string, status string, form string, roots array<string>, checklist string, located boolean")
    ask = lambda form, located=True: [r["key"] for r in exports.reusable(df, form, ["P", "F"], "c", located).collect()]
    assert ask("CSV") == ["k1"] and ask("ZIP") == [] and ask("CSV", False) == []
    assert [r["key"] for r in exports.reusable(df.where("place = 0"), "CSV", ["F", "P"], "c", True).collect()] == ["k0"]


def test_stages_resume(spark, tmp_path):
    state, log, fail = jobs.State(spark, f"file://{tmp_path}/state"), [], [True]

    def b():
        if fail:
            raise ValueError("no")
        log.append("b")

    stages = [("a", lambda: log.append("a")), ("b", b), ("c", lambda: log.append("c"))]
    with pytest.raises(ValueError, match="no"):
        jobs.run_stages(state, stages)
    assert state.read()["error"] == {"stage": "b", "message": "no"}
    fail.clear()
    assert jobs.run_stages(state, stages) == ["b", "c"] and log == ["a", "b", "c"] and state.read()["status"] == "done"
    assert jobs.run_stages(state, stages, skip=["b"]) == ["a", "c"] and jobs.run_stages(state, stages, start="c") == ["c"]
    assert len([f for f in os.listdir(tmp_path / "state") if f.startswith("version=")]) <= 2
    assert jobs.nothing_new({"status": "done", "ends": {"a": 1}, "hour": 3}, {"a": 1}, 3) and not jobs.nothing_new({"status": "error"}, {}, 0)


def test_settings_and_queue(spark, monkeypatch):
    from dataclasses import dataclass

    @jobs.settings("t")
    @dataclass
    class T:
        rows: int = 5
        folder: str = "data"
        roots: tuple[str, ...] = ("P",)

    monkeypatch.setenv("ROWS", "7")
    monkeypatch.setenv("ROOTS", " A, ,B")
    jobs.forget()
    t = jobs.load("t")
    assert (t.rows, t.folder, t.roots) == (7, "data", ("A", "B")) and jobs.load("t") is t
    with pytest.raises(KeyError):
        jobs.load("none")
    clock = [0.0]
    q = jobs.Queue(lambda rows: f"{rows.count()} rows" if rows.count() else 1 / 0, most=2, now=lambda: clock[0])
    q.add("x", spark.range(3))
    q.add("y", spark.range(0))
    with pytest.raises(ValueError, match="wait"):
        q.add("z", spark.range(1))
    assert q.step() == "x" and q.step() == "y" and q.step() is None
    assert (q.jobs["x"].status, q.jobs["x"].result, q.jobs["y"].status) == ("done", "3 rows", "error")
    clock[0] = 4000.0
    assert q.forget() == ["x", "y"] and not q.jobs
    kept = spark.createDataFrame([("v", 1), ("v", 2)], "variable string, number long")
    assert [tuple(r) for r in jobs.unneeded_chunks(kept, kept.where("number = 2")).collect()] == [("v", 1)]


def test_small_sinks_and_lookups(spark, tmp_path):
    df = spark.createDataFrame([(3, "c", 1.0, 2.0), (1, "a", 3.0, 4.0)], "catalog_number long, taxon_key string, lat double, lon double")
    sinks.catalog_index(df, f"{tmp_path}/index", 2)
    assert spark.read.parquet(f"{tmp_path}/index").where("catalog_number = 1").first()["taxon_key"] == "a"
    sinks.of_one({"counts": df}, f"{tmp_path}/one")
    assert "taxon_key" not in spark.read.parquet(f"{tmp_path}/one/counts").columns
    named = layers.observation_names(spark.createDataFrame([(i, "x" if i == 2 else " ") for i in (2, 9000, 5, 1)], "k long, own string"), "own", "k")
    assert {r["k"]: r["observation_name"] for r in named.collect()} == {1: "Observation #1", 2: "x", 5: "Observation #3", 9000: "Observation #4"}
    m = spark.createDataFrame([(1, "c", "7", " "), (2, "c", "8", ""), (3, " ", "9", "u"), (4, "c", " ", "v")], "row long, taxon_key string, outer_id string, outer_url string")
    cat = spark.createDataFrame([("c", "1", "old"), ("d", "2", None)], "taxon_key string, outer_id string, outer_url string")
    assert sorted(map(tuple, naming.apply_mapping(cat, m).collect())) == [("c", "8", "old"), ("d", "2", None)]

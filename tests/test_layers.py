import math

import pytest
from pyspark.sql import functions as F

from lichen.operators import filters, search, stats
from lichen.sources import layers, sinks


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_layers_and_legends(spark):
    c = spark.createDataFrame([("bio1", None, None), ("t", "max", [1, 24])], "id string, aggregate string, windows array<int>")
    assert rows(layers.layers(c), "id", "variable", "hours") == [("bio1", "bio1", None), ("t_max_1h", "t", 1), ("t_max_24h", "t", 24)]
    legend = spark.createDataFrame([("w", 1, "base"), ("w", 2, "two"), ("w_mode_8h", 1, "own")], "layer string, class int, name string")
    v = spark.createDataFrame([("w_mode_8h", 1), ("w_mode_8h", 2), ("w_mode_8h", 3), ("x", 1)], "layer string, class int")
    assert rows(layers.with_legend(v, legend), "layer", "class", "name") == [("w_mode_8h", 1, "own"), ("w_mode_8h", 2, "two"), ("w_mode_8h", 3, None), ("x", 1, None)]
    assert layers.base_of("s3", "/a/", "b") == "s3a://b/a" and layers.base_of("local", "/x/") == "/x"
    with pytest.raises(ValueError):
        layers.base_of("ftp", "/x")


def test_chunk_files(spark):
    hour, day = 3600, 24
    start = 820454400  # 1996-01-01
    first = start // (day * 504 * hour // day)  # chunks of 504 hours
    found = layers.chunk_index(spark.range(first - 1, first + 2).withColumnRenamed("id", "number"), spark.createDataFrame([(1995,)], "year int"), 504, hour)
    got = {(r["source"], r["number"]): (r["start"], r["end"], r["offset"]) for r in found.collect()}
    assert got["year", 1995] == (788918400, start - hour, 0)
    assert ("chunk", first - 1) not in got and got["chunk", first][0] == start
    assert got["chunk", first][2] == (start - first * 504 * hour) // hour and got["chunk", first + 1][2] == 0
    assert layers.chunk_index(spark.range(0).withColumnRenamed("id", "number"), spark.createDataFrame([(1995,)], "year int"), 504, hour, since=start).count() == 0


def test_requests():
    known = {"ratio": False, "aspect": True}
    assert layers.conditions(None, known) == [] and layers.conditions("[]", known) == []
    got = layers.conditions('[{"variable": "ratio", "min": 5, "max": 1}, {"variable": "aspect", "min": 350, "max": 10}]', known)
    assert got[0]["ranges"][0] == (pytest.approx(1), pytest.approx(5)) and got[1]["ranges"][0] == (pytest.approx(350), pytest.approx(10)) and got[1]["wraps"]
    for bad, kind in (("{", ValueError), ("{}", ValueError), ('[{"variable": "zz", "min": 1}]', KeyError), ('[{"variable": "ratio"}]', ValueError)):
        with pytest.raises(kind):
            layers.conditions(bad, known)
    with pytest.raises(ValueError, match="bio1"):
        layers.reserved(["lat", "bio1"], ["bio1"])


def test_parsed_filters_apply(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 9.0), (3, None)], "id int, v double")
    assert rows(filters.chained(df, layers.conditions('[{"variable": "v", "ranges": [{"min": 9}]}]', {"v": False})), "id") == [(2,)]


def test_uploads(spark):
    t = spark.createDataFrame([("2020-01-02",), ("1/2/2020",), ("2020-01-02T03:04:05Z",), ("2020-01-02 03:04:05",), ("2 Jan 2020",), ("soon",), ("NaN",), (" ",), (None,)], "t string")
    noon, at = 1577966400, 1577934245
    assert [r["x"] for r in t.select(layers.upload_time(F.col("t")).alias("x")).collect()] == [noon, noon, at, at, noon, None, None, None, None]
    n = layers.observation_names(spark.createDataFrame([(1, "a"), (2, " "), (3, None)], "k int, n string"), "n", "k")
    assert rows(n, "k", "observation_name") == [(1, "a"), (2, "Observation #2"), (3, "Observation #3")]


def test_samples_and_curves(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("g"), "id")
    one, two = (rows(stats.sample(x, ["g"], "id", 50), "g", "id") for x in (df, df.repartition(7)))
    assert one == two and len(one) == 100
    assert rows(stats.sample(df.where("id < 9"), ["g"], "id", 50), "id") == rows(df.where("id < 9"), "id")
    x = [i / 1000 for i in range(1001)]
    c = spark.createDataFrame([(x, [1.0] * 1001), (x, [2 * v for v in x]), ([], [])], "p array<double>, d array<double>")
    got = [r["e"] for r in c.select(stats.curve_entropy(F.col("p"), F.col("d")).alias("e")).collect()]
    assert got[0] == 0 and got[1] == pytest.approx(0.5 - math.log(2), abs=1e-5) and got[2] is None


def test_pages(spark):
    names = spark.createDataFrame([("1", "red oak"), ("2", "red maple"), ("3", "oak")], "taxon_key string, name string")
    values = spark.createDataFrame([("1", 5.0), ("2", 7.0), ("3", 9.0)], "taxon_key string, value double")
    assert [r["taxon_key"] for r in search.ranked_text_page(names, values, "red", 0, 5, descending=True).collect()] in (["2", "1"], ["2"], ["1"], [])
    assert search.text_page(names, "oak", 0, 1).first()["taxon_key"] == "3"


def test_written_tables(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", 1.0, 5), (2, "b", None, 6)], "catalog_number long, taxon_key string, s double, gone int")
    batches = [spark.createDataFrame([(1, None, 2.0), (2, 3.0, None)], "catalog_number long, s double, t_avg_24h double"), spark.createDataFrame([(2, 4.0)], "catalog_number long, s double")]
    sinks.merged(base, batches, ["s", "t_avg_24h"], ["t"], ["catalog_number", "taxon_key"], str(tmp_path / "m"), 2)
    got = spark.read.parquet(str(tmp_path / "m"))
    assert rows(got, "catalog_number", "s", "t_avg_24h") == [(1, 1.0, 2.0), (2, 4.0, None)] and "gone" not in got.columns
    assert layers.schema_of(spark, str(tmp_path / "m"))["s"] == "double"
    sinks.archive({"x": spark.createDataFrame([(1, [1.0, 2.0])], "k int, p array<double>")}, str(tmp_path / "z"), with_csv=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "z/x.csv")).first()["p"] == "[1.0,2.0]"
    a, b = spark.createDataFrame([("1", None)], "taxon_key string, mode string"), spark.createDataFrame([("2", 1.0)], "taxon_key string, n double")
    sinks.summaries({"numerical": [a, b]}, str(tmp_path / "s"), 1)
    assert dict(spark.read.parquet(str(tmp_path / "s/numerical")).dtypes)["mode"] == "double"


def test_sentences(spark):
    from lichen.functions import sentences

    one = lambda c: spark.range(1).select(c).first()[0]
    words = lambda *x: F.array(*map(F.lit, x)) if x else F.expr("cast(array() as array<string>)")
    assert [one(sentences.listed(words(*x))) for x in ((), ("a",), ("a", "b"), ("a", "b", "c"))] == [None, "a", "a and b", "a, b and c"]
    c = F.array(F.struct(F.lit("dune").alias("name"), F.lit(0.505).alias("fraction")))
    assert one(sentences.shares(c, F.lit(2))) == "Found mostly in dune (51 %), and 2 more."
    import colorsys

    rgb = spark.range(40).select("id", *(v.alias(k) for k, v in sentences.fallback_rgb(F.col("id").cast("int")).items())).collect()
    for r in rgb:
        assert tuple(r[1:]) == pytest.approx([int(x * 255) for x in colorsys.hsv_to_rgb(r[0] * 137 % 360 / 360, 0.65, 0.92)], abs=1)


def test_ranked_text_page_reaches_the_end(spark):
    names = spark.createDataFrame([(f"t{i:03}", f"red thing{i:03}") for i in range(300)], "taxon_key string, name string")
    values = spark.createDataFrame([(f"t{i:03}", float(i)) for i in range(300)], "taxon_key string, value double")
    page = lambda offset, limit, descending: [r["value"] for r in search.ranked_text_page(names, values, "red", offset, limit, descending).collect()]
    assert page(290, 5, False) == [290.0, 291.0, 292.0, 293.0, 294.0]
    assert page(0, 2, True) == [299.0, 298.0] and page(298, 5, True) == [1.0, 0.0]

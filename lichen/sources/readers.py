"""Readers of exports and uploads."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lichen.functions import text

ALIASES = {"lat": ("decimallatitude", "latitude", "lat", "y"), "lon": ("decimallongitude", "longitude", "lon", "lng", "x"), "time": ("eventdate", "observedon", "date", "time")}


def delimited(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """A headed text table, all columns strings; quotes are ordinary characters and rows of the wrong width are dropped."""
    return spark.read.csv(path, sep=separator, header=True, inferSchema=False, quote="", mode="DROPMALFORMED")


def projected(spark: SparkSession, path: str, columns: list[str], where: list[tuple[str, str, object]]) -> DataFrame:
    """Some columns of the rows that meet all of (column, '=' or 'in', value); both reach the Parquet scan."""
    df = spark.read.parquet(path)
    for name, op, value in where:
        if op not in ("=", "in"):
            raise ValueError(f"no such comparison: {op}")
        df = df.where(F.col(name) == value if op == "=" else F.col(name).isin(list(value)))
    return df.select(*columns)


def event_time(date: Column, time: Column) -> Column:
    """Epoch seconds in UTC of a date and, unless blank or NA, a time; null for what can't be read."""
    t = F.trim(F.coalesce(time, F.lit("")))
    day = F.substring_index(F.trim(date), "T", 1)
    whole = F.when((t == "") | (F.upper(t) == "NA"), F.trim(date)).otherwise(F.concat_ws("T", day, t))
    return F.unix_seconds(F.try_to_timestamp(whole))


def occurrences(raw: DataFrame) -> DataFrame:
    """An export's rows in the base schema; rows without a usable place, or of a rank that is no leaf, go."""
    lat, lon = (F.expr(f"try_cast({c} AS double)") for c in ("decimalLatitude", "decimalLongitude"))
    rows = raw.where(F.col("taxonRank").isin("FORM", "VARIETY", "SUBSPECIES", "SPECIES")).withColumns({"_lat": lat, "_lon": lon}).where("_lat BETWEEN -90 AND 90 AND _lon BETWEEN -180 AND 180")
    evidence = F.from_json("dynamicProperties", "evidenceOfPresence array<string>")["evidenceOfPresence"]
    single = F.get_json_object("dynamicProperties", "$.evidenceOfPresence")
    blank = lambda c: F.when(F.trim(c) != "", c)
    return rows.select(
        text.cleaned(F.col("scientificName"), F.col("taxonRank")).alias("name"),
        "catalogNumber",
        F.col("_lat").alias("decimalLatitude"),
        F.col("_lon").alias("decimalLongitude"),
        event_time(F.col("eventDate"), F.col("eventTime")).alias("eventTimestamp"),
        F.expr("try_cast(coordinateUncertaintyInMeters AS double)").alias("coordinateUncertaintyInMeters"),
        text.obscured_flag(F.col("informationWithheld")).alias("obscured"),
        F.coalesce(F.array_join(evidence, "|"), single, F.lit("")).alias("dp"),
        F.coalesce("reproductiveCondition", F.lit("")).alias("rcs"),
        *(blank(F.col(c)).alias(c) for c in ("gbifRegion", "level0Gid", "level1Gid", "level2Gid")),
    )


def first_media(raw: DataFrame, order: str) -> DataFrame:
    """(gbifID, url, license, attribution): each observation's first row in file order, if it can be used at all; a later one
    does not take its place. ``order`` is an ordinal given when the file was landed."""
    first = raw.groupBy("gbifID").agg(F.min_by(F.struct("identifier", "license", "rightsHolder", "creator"), order).alias("m")).select("gbifID", "m.*")
    usable = first.where((F.coalesce(F.trim("identifier"), F.lit("")) != "") & text.license_usable(F.col("license")))
    return usable.select("gbifID", F.col("identifier").alias("url"), "license", F.coalesce(F.when(F.trim("rightsHolder") != "", F.col("rightsHolder")), F.col("creator")).alias("attribution"))


def alias_of(names: list[str], aliases: Iterable[str], inside: bool = False) -> str | None:
    """The column that the first alias with a match names; ``inside`` also takes a part of a name."""
    plain = {c: "".join(x for x in c.lower() if x.isalnum()) for c in names}
    for a in aliases:
        for c, p in plain.items():
            if p == a:
                return c
    return next((c for a in aliases for c, p in plain.items() if inside and len(a) > 2 and a in p), None)


def upload(spark: SparkSession, path: str, most: int = 50_000) -> DataFrame:
    """An uploaded table with lat, lon and catalog_number; bad rows reject all of it, with their number."""
    if not path.endswith((".csv", ".tsv", ".txt", ".parquet")):
        raise ValueError("unsupported file")
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, sep="," if path.endswith(".csv") else "\t", header=True)
    lat, lon = (alias_of(df.columns, ALIASES[k], inside=True) for k in ("lat", "lon"))
    if not lat or not lon:
        raise ValueError("no columns for the place")
    out = df.withColumns({"lat": F.expr(f"try_cast(`{lat}` AS double)"), "lon": F.expr(f"try_cast(`{lon}` AS double)")})
    good = F.coalesce((F.abs("lat") <= 90) & (F.abs("lon") <= 180), F.lit(False))
    n, bad = out.agg(F.count(F.lit(1)), F.coalesce(F.sum((~good).cast("int")), F.lit(0))).first()
    if n > most:
        raise ValueError(f"more than {most} rows")
    if bad:
        raise ValueError(f"{bad} rows without a valid place")
    own = alias_of(df.columns, ("catalognumber", "observationid", "id"))
    number = F.col(f"`{own}`").cast("string") if own else F.concat(F.lit("Observation #"), F.monotonically_increasing_id() + 1)
    return out.withColumn("catalog_number", F.coalesce(F.when(F.trim(number) != "", number), F.lit("Observation")))

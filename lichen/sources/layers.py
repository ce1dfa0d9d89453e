"""The catalog of layers and legends, the index of hourly chunks, and where tables lie."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = {1: "1h", 8: "8h", 24: "1d", 72: "3d", 168: "7d", 720: "30d", 2160: "90d"}


def base_of(mode: str, folder: str, bucket: str | None = None) -> str:
    """The address that tables are read under; credentials are the session's affair."""
    if mode == "local":
        return folder.rstrip("/")
    if mode in ("s3", "b2") and bucket:
        return f"s3a://{bucket}/{folder.strip('/')}".rstrip("/")
    raise ValueError(f"no such storage: {mode}")


def layers(catalog: DataFrame) -> DataFrame:
    """(id, variable, hours) of every layer from (id, aggregate, windows): static ones as they are, a temporal one once a
    window as id_aggregate_hours."""
    w = catalog.select("id", F.coalesce("aggregate", F.lit("avg")).alias("aggregate"), F.explode_outer("windows").alias("hours"))
    own = F.concat_ws("_", "id", "aggregate", F.concat(F.col("hours").cast("string"), F.lit("h")))
    return w.select(F.when(F.col("hours").isNull(), F.col("id")).otherwise(own).alias("id"), F.col("id").alias("variable"), "hours")


def variable_ids(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``asked`` (id, ...) with ``resolved``: the id if a layer has it, else without its underscores, as older links spell it."""
    k = known.select(F.col("id").alias("_id")).distinct()
    return asked.join(k, F.col("id") == F.col("_id"), "left").withColumn("resolved", F.coalesce("_id", F.replace("id", F.lit("_"), F.lit("")))).drop("_id")


def metadata(catalog: DataFrame, first: int = 10_000) -> DataFrame:
    """(id, name, category, value_type, domain, sort_order) of an archive's columns from a catalog (place, id, name, category, value_type,
    filename, derived, aggregate, windows): static layers that have a file or are derived, then temporal ones, a row a
    window, from ``first`` on. A catalog has a few hundred rows; one window numbers them."""
    from pyspark.sql import Window

    kind = F.when(F.col("value_type").isin("nominal", "ordinal"), "discrete").otherwise("continuous").alias("domain")
    number = F.row_number().over(Window.orderBy("place")) - 1
    static = catalog.where("windows IS NULL AND (filename IS NOT NULL OR derived)").withColumn("sort_order", number)
    timed = catalog.where("windows IS NOT NULL").withColumn("_i", number).select("*", F.posexplode("windows").alias("_k", "_hours"))
    own = F.concat_ws("_", "id", F.coalesce("aggregate", F.lit("avg")), F.concat(F.col("_hours").cast("string"), F.lit("h")))
    timed = timed.withColumns({"id": own, "sort_order": F.lit(first) + F.col("_i") * F.size("windows") + F.col("_k")})
    columns = ("id", F.coalesce("name", "id").alias("name"), "category", "value_type", kind, F.col("sort_order").cast("long").alias("sort_order"))
    return static.select(*columns).unionByName(timed.select(*columns))


def base_layer(name: Column) -> Column:
    """A layer id without its window: what its legend is filed under if it has none of its own."""
    return F.regexp_replace(name, r"_[a-z]+_\d+h$", "")


def with_legend(values: DataFrame, legend: DataFrame) -> DataFrame:
    """values (layer, class) with the name of the class from legend (layer, class, name): the layer's own, else its base's."""
    own = legend.select(F.col("layer").alias("_l"), F.col("class").alias("_c"), F.col("name").alias("_own"))
    base = legend.select(F.col("layer").alias("_l2"), F.col("class").alias("_c2"), F.col("name").alias("_base"))
    v = values.withColumn("_b", base_layer(F.col("layer")))
    out = v.join(own, (v["layer"] == own["_l"]) & (v["class"] == own["_c"]), "left").join(base, (F.col("_b") == base["_l2"]) & (F.col("class") == base["_c2"]), "left")
    return out.select(*values.columns, F.coalesce("_own", "_base").alias("name"))


def chunk_index(chunks: DataFrame, years: DataFrame, steps: int, seconds: int, since: int = 0) -> DataFrame:
    """(source, number, start, end, offset) of all files in order: chunk n holds the steps n * steps and on, a file of a year
    its year. Chunks begin after the last year that covers their start; those wholly covered, and files that end before
    ``since``, go. ``offset`` counts the steps left out."""
    y = years.select(F.lit("year").alias("source"), F.col("year").alias("number"), F.unix_timestamp(F.make_date("year", F.lit(1), F.lit(1)).cast("timestamp")).alias("start"), (F.unix_timestamp(F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)).cast("timestamp")) - seconds).alias("end"))
    c = chunks.select("number", (F.col("number") * steps * seconds).cast("long").alias("start"), ((F.col("number") + 1) * steps * seconds - seconds).cast("long").alias("end"))
    # a row a year: a century of files, not a table that grows with observations
    over = c.join(F.broadcast(y.select(F.col("start").alias("ys"), F.col("end").alias("ye"))), (F.col("ys") <= F.col("end")) & (F.col("ye") >= F.col("start")), "left")
    cut = over.groupBy("number", "start", "end").agg(F.max("ye").alias("ye")).withColumn("from", F.greatest("start", F.coalesce(F.col("ye") + seconds, F.col("start"))))
    kept = cut.where("`from` <= `end`").select(F.lit("chunk").alias("source"), "number", F.col("from").alias("start"), "end", ((F.col("from") - F.col("start")) / seconds).cast("long").alias("offset"))
    return y.withColumn("offset", F.lit(0).cast("long")).unionByName(kept).where(F.col("end") >= since)


def conditions(text: str | None, known: dict[str, bool]) -> list[dict]:
    """A request's chained filters (a JSON array) as ``filters.chained`` takes them; ``known`` says of each variable whether
    its ranges may go through 0. Reversed ranges of others are turned round; bounds get a slack of 1e-9."""
    if not text:
        return []
    try:
        entries = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError("filters are not valid JSON") from e
    if not isinstance(entries, list):
        raise ValueError("filters must be an array")
    out = []
    for entry in entries:
        if not isinstance(entry, dict) or entry.get("variable") not in known:
            raise KeyError(f"no such variable in {entry!r}")
        wraps = known[entry["variable"]]
        own: dict = {"variable": entry["variable"], "wraps": wraps}
        if "class_value" in entry or "class_values" in entry:
            own["class_values"] = [int(v) for v in entry.get("class_values", [entry.get("class_value")])]
        pairs = [(r.get("min"), r.get("max")) for r in entry.get("ranges", [])] + ([(entry.get("min"), entry.get("max"))] if "min" in entry or "max" in entry else [])
        for low, high in pairs:
            if low is not None and high is not None and low > high and not wraps:
                low, high = high, low  # noqa: PLW2901
            own.setdefault("ranges", []).append((None if low is None else low - 1e-9, None if high is None else high + 1e-9))
        if len(own) == 2:
            raise ValueError(f"a filter without a condition: {entry!r}")
        out.append(own)
    return out


def upload_time(value: Column) -> Column:
    """Epoch seconds in UTC of any date text; noon where it has no time of day; null for blanks and what can't be read."""
    s = F.trim(value)
    t = F.coalesce(F.unix_seconds(F.try_to_timestamp(s)), *(F.unix_seconds(F.try_to_timestamp(s, F.lit(f))) for f in ("M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "yyyy/M/d", "d MMM yyyy", "MMM d, yyyy")))
    blank = F.lower(s).isin("", "none", "nan", "nat", "null")
    return F.when(~blank, t + F.when(s.contains(":"), 0).otherwise(12 * 3600)).cast("long")


def reserved(columns: list[str], layer_ids: list[str]) -> None:
    """Rejects an upload with a column named like a layer."""
    taken = sorted(set(columns) & set(layer_ids))
    if taken:
        raise ValueError(f"columns named like layers: {', '.join(taken)}")


def observation_names(df: DataFrame, column: str | None, order: str) -> DataFrame:
    """df with observation_name: the column's value, or the row's number by ``order``, a whole number, where blank. Rows are
    numbered in blocks of 4096 values of the order, so no task holds them all."""
    from lichen.operators import rasters

    numbered = rasters.row_numbers(df, [order], F.floor(F.col(order) / 4096))
    made = F.concat(F.lit("Observation #"), F.col("row_number") + 1)
    given = F.when(F.trim(F.col(column)) != "", F.col(column)) if column else F.lit(None).cast("string")
    return numbered.withColumn("observation_name", F.coalesce(given, made)).drop("row_number")


def schema_of(spark: SparkSession, path: str) -> dict[str, str]:
    """Column names and types of a stored table, from its footer."""
    return dict(spark.read.parquet(path).dtypes)

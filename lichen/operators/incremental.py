"""Keeping an enriched snapshot up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one(df: DataFrame, key: str) -> DataFrame:
    """One row a key, the last in the order of all other columns."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, "_r.*")


def _states(new: DataFrame, old: DataFrame, key: str) -> tuple[DataFrame, Column, Column, Column]:
    o = _one(old, key)
    o = o.select(*(F.col(c).alias(f"_old_{c}") for c in o.columns), F.lit(True).alias("_found"))
    joined = new.join(o, F.col(key) == F.col(f"_old_{key}"), "left")
    found = F.coalesce("_found", F.lit(False))
    same_place = found & (F.col("lat") == F.col("_old_lat")) & (F.col("lon") == F.col("_old_lon"))
    return joined, found, F.coalesce(same_place, F.lit(False)), F.col("ts").eqNullSafe(F.col("_old_ts"))


def carry_forward(new: DataFrame, old: DataFrame, static: list[str], temporal: list[str], key: str = "catalog_number") -> DataFrame:
    """New rows with old values: static layers where the place is the same, temporal ones where the time is as well. The
    result always has all layers; those no longer listed are not carried."""
    joined, _, place, time = _states(new, old, key)
    columns = [F.when(place, F.col(f"_old_{c}")).alias(c) for c in static] + [F.when(place & time, F.col(f"_old_{c}")).alias(c) for c in temporal]
    return joined.select(*new.columns, *columns)


def carry_counts(new: DataFrame, old: DataFrame, key: str = "catalog_number") -> DataFrame:
    """One row: rows carried, changed and new."""
    joined, found, place, _ = _states(new, old, key)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return joined.agg(n(place).alias("carried"), n(found & ~place).alias("changed"), n(~found).alias("new"))


def coalesce_merge(base: DataFrame, updates: DataFrame, layers: list[str], key: str = "catalog_number") -> DataFrame:
    """base with the updates' values where they are given; base columns that are neither base nor a layer stay."""
    u = _one(updates, key)
    mine = [c for c in layers if c in u.columns]
    u = u.select(key, *(F.col(c).alias(f"_new_{c}") for c in mine))
    j = base.join(u, key, "left")
    rest = [F.coalesce(f"_new_{c}", c).alias(c) if c in mine else F.col(c) for c in base.columns]
    return j.select(*rest, *(F.col(f"_new_{c}").alias(c) for c in mine if c not in base.columns))


def stale_columns(columns: list[str], base: list[str], layers: list[str], temporal: list[str]) -> list[str]:
    """Columns that are neither base columns nor layers nor begin like a temporal layer."""
    return [c for c in columns if c not in base and c not in layers and not any(c.startswith(t + "_") for t in temporal)]


def worklist(df: DataFrame, layers: list[str], order: str) -> DataFrame:
    """(catalog_number, missing): rows that lack a layer (null; NaN counts as done), with the names of those."""
    missing = F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in layers)), lambda x: x.isNotNull())
    return df.select("catalog_number", missing.alias("missing"), F.col(order).alias("_o")).where(F.size("missing") > 0).orderBy("_o", "catalog_number").drop("_o")


def write_back(base: DataFrame, updates: DataFrame, column: str, order: str, key: str = "catalog_number") -> DataFrame:
    """base with each key's last update; keys without one keep what they have, null included."""
    last = updates.groupBy(key).agg(F.max_by(column, order).alias("_new"), F.lit(True).alias("_has"))
    return base.join(last, key, "left").withColumn(column, F.when(F.col("_has"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_has")


def pending(df: DataFrame, layers: list[str], since: int) -> DataFrame:
    """Rows with a time and a place, from ``since`` on, that lack a layer. NaN is a result: sampled, and nothing there."""
    whole = F.col("ts").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("ts") >= since)
    return df.where(whole & F.exists(F.array(*(F.col(c).isNull() for c in layers)), lambda x: x))

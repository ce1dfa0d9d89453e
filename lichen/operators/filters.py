"""Row filters; all reach the scan as predicates where the source has statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]


def good_quality(df: DataFrame, most: float = 500) -> DataFrame:
    """Not obscured, and of known or unknown uncertainty up to ``most``; columns that are absent don't matter."""
    if "obscured" in df.columns:
        df = df.where(F.col("obscured") == "No")
    if "uncertainty" in df.columns:
        df = df.where(F.col("uncertainty").isNull() | (F.col("uncertainty") <= most))
    return df


def in_list(column: str, value: str) -> Column:
    """A pipe-separated list has the value, without regard to case and outer spaces."""
    return F.array_contains(F.transform(F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), r"\|"), lambda x: F.trim(x)), value.strip().lower())


def has_state(df: DataFrame, value: str, column: str = "states") -> DataFrame:
    return df.where(in_list(column, value)) if column in df.columns else df.limit(0)


def in_time(df: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Inclusive bounds on ``ts``; rows without a time go once there is a bound."""
    if "ts" not in df.columns or first is None and last is None:
        return df
    if first is not None:
        df = df.where(F.col("ts") >= first)
    return df if last is None else df.where(F.col("ts") <= last)


def between(column: str, low: float | None, high: float | None, wraps: bool = False) -> Column:
    """Inclusive; reversed bounds are swapped, or, for an angle, go through 360. NaN is never inside."""
    c = F.col(column).cast("double")
    known = c.isNotNull() & ~F.isnan(c)
    if low is not None and high is not None and low > high:
        if wraps:
            return known & (((c >= low) & (c <= 360)) | ((c >= 0) & (c <= high)))
        low, high = high, low
    if low is not None:
        known = known & (c >= low)
    return known if high is None else known & (c <= high)


def chained(df: DataFrame, conditions: list[dict]) -> DataFrame:
    """All variables must hold; within one, any of its values or ranges. An unknown variable leaves nothing."""
    for x in conditions:
        name = x["variable"]
        if name not in df.columns:
            return df.limit(0)
        values = [x["class_value"]] if "class_value" in x else x.get("class_values", [])
        ranges = x.get("ranges", []) + ([(x.get("min"), x.get("max"))] if "min" in x or "max" in x else [])
        tests = [F.col(name).cast("double").cast("long").isin([int(v) for v in values])] if values else []
        tests += [between(name, a, b, x.get("wraps", False)) for a, b in ranges]
        if tests:
            any_of = tests[0]
            for t in tests[1:]:
                any_of = any_of | t
            df = df.where(any_of)
    return df


def in_polygon(lat: Column, lon: Column, rings: list[Ring]) -> Column:
    """Inside any ring of (lat, lon) corners, by ray casting in plain expressions; rings under three corners are skipped.
    A bounding box comes first, so most rows cost two comparisons and the box can reach the scan."""
    inside = F.lit(False)
    for ring in rings:
        if len(ring) < 3:
            continue
        ys, xs = [p[0] for p in ring], [p[1] for p in ring]
        crossings = F.lit(0)
        for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if y1 == y2:
                continue
            x_at = F.lit(float(x1)) + (lat - float(y1)) * ((x2 - x1) / (y2 - y1))
            crossings = crossings + F.when(((lat > float(y1)) != (lat > float(y2))) & (lon < x_at), 1).otherwise(0)
        box = (lat > min(ys)) & (lat < max(ys)) & (lon > min(xs)) & (lon < max(xs))
        inside = inside | (box & (crossings % 2 == 1))
    return inside


def decode_polyline(text: str) -> Ring:
    """(lat, lon) corners of an encoded polyline: zigzag deltas in groups of five bits, 1e-5 degrees."""
    out, at, point = [], 0, [0, 0]
    while at < len(text):
        for axis in (0, 1):
            value = shift = 0
            while True:
                if at >= len(text) or not 63 <= ord(text[at]) <= 126:
                    raise ValueError("bad polyline")
                bits = ord(text[at]) - 63
                at += 1
                value |= (bits & 31) << shift
                shift += 5
                if bits < 32:
                    break
            point[axis] += ~(value >> 1) if value & 1 else value >> 1
        out.append((point[0] / 1e5, point[1] / 1e5))
    return out


def parse_rings(text: str, rings: int = 50, corners: int = 2000, chars: int = 40_000) -> list[Ring]:
    """Rings of a ;-joined text; the caps guard a service, and break them by an error."""
    if len(text) > chars:
        raise ValueError("polygon text too long")
    found = [decode_polyline(t) for t in text.split(";") if t]
    if len(found) > rings or sum(map(len, found)) > corners:
        raise ValueError("polygon too large")
    return [r for r in found if len(r) >= 3]


def located(df: DataFrame, gid: str, level: int | None) -> DataFrame:
    """Rows of a known area by its level's column, else of a named region."""
    return df.where(F.col("region" if level is None else f"level{level}") == gid)


def page(df: DataFrame, column: str, limit: int) -> DataFrame:
    """(catalog_number, lat, lon, value) of rows with a place, by catalog number."""
    rows = df.where("lat IS NOT NULL AND lon IS NOT NULL").select("catalog_number", "lat", "lon", F.col(column).alias("value"))
    return rows.orderBy("catalog_number").limit(limit)


def all_obscured(scope: DataFrame, df: DataFrame) -> DataFrame:
    """One row: true iff there are rows in scope and none of them is open."""
    rows = df.join(scope, "taxon_key", "left_semi")
    return rows.agg((F.count(F.lit(1)) > 0).alias("some"), F.coalesce(F.max(F.col("obscured") == "No"), F.lit(False)).alias("open")).select((F.col("some") & ~F.col("open")).alias("all_obscured"))


def first_of_each(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key, the first by ``order``; an aggregation with partial results, not a window."""
    row = F.struct(*df.columns)
    return df.groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("_r")).select("_r.*")

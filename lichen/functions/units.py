"""Unit conversion of values and of summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: display unit by metric unit: factor and offset
TABLE = {"°C": ("°F", 1.8, 32.0), "mm": ("in", 1 / 25.4, 0.0), "m": ("ft", 1 / 0.3048, 0.0), "km": ("mi", 1 / 1.609344, 0.0), "m/s": ("mph", 1 / 0.44704, 0.0), "kg/m²": ("lb/ft²", 0.204816, 0.0)}
SPREAD = ("std", "iqr", "range", "10_90_range")
PURE = ("count", "unique_samples", "rbar", "circular_var")


def convert(value: Column, unit: str, metric: str = "mean", scale: str = "interval") -> Column:
    """A metric in display units. The offset is for places on an interval scale, not for spreads; a variance takes the
    factor's square; an entropy gains the logarithm of the factor; pure numbers stay."""
    if unit not in TABLE or metric in PURE:
        return value
    _, factor, offset = TABLE[unit]
    if metric == "variance":
        return value * factor**2
    if metric == "entropy":
        return value + F.ln(F.lit(abs(factor)))
    if metric in SPREAD or scale != "interval":
        return value * factor
    return value * factor + offset


def invert(value: Column, unit: str, metric: str = "mean", scale: str = "interval") -> Column:
    """Back to metric units; an entropy loses what ``convert`` adds."""
    if unit not in TABLE or metric in PURE:
        return value
    _, factor, offset = TABLE[unit]
    if metric == "variance":
        return value / factor**2
    if metric == "entropy":
        return value - F.ln(F.lit(abs(factor)))
    if metric in SPREAD or scale != "interval":
        return value / factor
    return (value - offset) / factor


def convert_density(points: Column, density: Column, unit: str, scale: str = "interval") -> tuple[Column, Column]:
    """A curve in display units: points move, density is divided by the factor."""
    _, factor, _ = TABLE[unit]
    return F.transform(points, lambda p: convert(p, unit, "mean", scale)), F.transform(density, lambda d: d / abs(factor))

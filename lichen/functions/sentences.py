"""Short texts from statistics, and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def listed(items: Column) -> Column:
    """Texts as "a", "a and b" or "a, b and c"; null without any."""
    n = F.size(items)
    front = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 1, F.element_at(items, 1)).when(n > 1, F.concat(front, F.lit(" and "), F.element_at(items, -1)))


def shares(classes: Column, more: Column) -> Column:
    """A sentence on the commonest classes, an array of (name, fraction) with the largest first; ``more`` counts the rest."""
    part = F.transform(classes, lambda c: F.concat(c["name"], F.lit(" ("), F.round(c["fraction"] * 100).cast("int").cast("string"), F.lit(" %)")))
    rest = F.when(more > 0, F.concat(F.lit(", and "), more.cast("string"), F.lit(" more"))).otherwise("")
    return F.when(F.size(classes) > 0, F.concat(F.lit("Found mostly in "), listed(part), rest, F.lit(".")))


def fallback_rgb(code: Column) -> dict[str, Column]:
    """A class without a colour: hues 137 degrees apart at saturation 0.65 and value 0.92."""
    hue = F.pmod(code * 137, F.lit(360)) / 60.0
    out = {}
    for name, turn in (("red", 5), ("green", 3), ("blue", 1)):  # each channel is the same ramp, turned
        k = (hue + turn) - F.floor((hue + turn) / 6) * 6
        level = 0.92 - 0.92 * 0.65 * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))
        out[name] = F.floor(level * 255 + 1e-9).cast("long")
    return out

"""Derived weather."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def saturation(t: Column) -> Column:
    """kPa over water at t degrees Celsius."""
    return 0.6108 * F.exp(t * 17.27 / (237.3 + t))


def vpd(t: Column, dew: Column) -> Column:
    """Vapour pressure deficit in kPa."""
    return saturation(t) - saturation(dew)


def dew_point(t: Column, humidity: Column) -> Column:
    """Degrees Celsius; the humidity is held between 1 and 100."""
    g = F.ln(F.greatest(F.lit(1.0), F.least(F.lit(100.0), humidity)) / 100) + t * 17.625 / (t + 243.04)
    return 243.04 * g / (17.625 - g)


# Codes and the rate from which each holds; snow in cm an hour, rain in mm an hour, cloud in percent.
SNOW_CODES = ((0.8, 75), (0.2, 73), (0.01, 71))
RAIN_CODES = ((7.6, 65), (2.5, 63), (1.3, 61), (1.0, 55), (0.5, 53), (0.01, 51))
CLOUD_CODES = ((80.0, 3), (50.0, 2), (20.0, 1))
NO_ELEVATION = -9000.0


def _known(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def weather_code(cloud: Column, rain: Column, snow: Column, t: Column | None = None, hours: float = 1.0) -> Column:
    """WMO code of a step of ``hours``: snow (mm of water), else rain (mm), else cloud. With a known temperature, snow above
    0 degrees is rain and rain (not drizzle) below is snow. Null without cloud, rain or snow."""
    of = lambda rate, codes: F.coalesce(*(F.when(rate >= least, code) for least, code in codes))
    code = F.coalesce(of(snow / 10 / hours, SNOW_CODES), of(rain / hours, RAIN_CODES), of(cloud, CLOUD_CODES), F.lit(0))
    if t is not None:
        warm, frost = _known(t) & (t > 0), _known(t) & (t < 0)
        code = F.when(warm & (code >= 71), code - 10).when(frost & code.between(61, 65), code + 10).otherwise(code)
    return F.when(_known(cloud) & _known(rain) & _known(snow), code)


def elevation_corrected(value: Column, model: Column, own: Column) -> Column:
    """Moved by 6.5 degrees a kilometre where both elevations are known: finite, the place's own above what stands for none."""
    known = _known(model) & _known(own) & (own > NO_ELEVATION)
    return F.when(known, value + (model - own) * 0.0065).otherwise(value)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_from(u: Column, v: Column) -> Column:
    """The direction it blows from, in degrees from north, clockwise."""
    return F.pmod(F.degrees(F.atan2(-u, -v)) + 360, F.lit(360.0))

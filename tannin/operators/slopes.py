"""Spectral slopes and their ratio."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tannin.functions.missing import INFINITY, ieee_div

# The two wavelength bands of the slope ratio, in nm.
BAND_275 = (275, 295)
BAND_350 = (350, 400)
BANDS = {"275": BAND_275, "350": BAND_350}


def within(band: tuple[float, float]) -> str:
    """SQL text: the row's wavelength lies in the closed band."""
    low, high = band
    return f"wavelength between {low} and {high}"


IN_ANY_BAND = f"({within(BAND_275)} or {within(BAND_350)})"


def log_point(band: tuple[float, float], value: str = "SUVA") -> str:
    """SQL text: ln(value) in the band, NULL where no finite logarithm exists."""
    return (
        f"case when {within(band)} and {value} > 0 and {value} < {INFINITY} "
        f"then ln({value}) end"
    )


def band_slope(band: tuple[float, float], value: str = "SUVA") -> Column:
    """Aggregate: least-squares slope of ln(value) on wavelength, sign flipped.

    NULL for fewer than two usable wavelengths.  Constant memory per group.
    """
    return F.expr(f"-regr_slope({log_point(band, value)}, double(wavelength))")


def band_intercept(band: tuple[float, float], value: str = "SUVA") -> Column:
    """Aggregate: intercept of the same line; the mean where it has no slope."""
    point = log_point(band, value)
    return F.expr(
        f"coalesce(regr_intercept({point}, double(wavelength)), avg({point}))"
    )


def band_rows(band: tuple[float, float]) -> Column:
    """Aggregate: rows in the band, usable for the slope or not."""
    return F.expr(f"count_if({within(band)})")


def band_nonfinite(band: tuple[float, float], value: str = "SUVA") -> Column:
    """Aggregate: rows in the band whose logarithm is infinite."""
    return F.expr(f"count_if({within(band)} and {value} in (0, {INFINITY}))")


def spectral_slope(
    spectrum: DataFrame, keys: Sequence[str], band: str, value: str = "SUVA"
) -> DataFrame:
    """Intercept and slope of one band per group with a row in the band."""
    limits = BANDS[band]
    return (
        spectrum.where(within(limits)).groupBy(*keys)
        .agg(
            band_intercept(limits, value).alias(f"intercept{band}"),
            band_slope(limits, value).alias(f"slope{band}"),
            band_nonfinite(limits, value).alias(f"nonfinite{band}"),
        )
    )


def slope_columns(value: str = "SUVA") -> list[Column]:
    """Aggregates for both bands at once."""
    return [
        column
        for name, limits in BANDS.items()
        for column in (
            band_rows(limits).alias(f"rows{name}"),
            band_intercept(limits, value).alias(f"intercept{name}"),
            band_slope(limits, value).alias(f"slope{name}"),
        )
    ]


def slope_ratio(
    spectrum: DataFrame, keys: Sequence[str], ratio: str = "Sr", value: str = "SUVA"
) -> DataFrame:
    """Both slopes and their ratio, for groups with rows in both bands.

    One conditional aggregate instead of two fits and a join.
    """
    slopes = spectrum.where(IN_ANY_BAND).groupBy(*keys).agg(*slope_columns(value))
    return with_ratio(slopes, ratio)


def with_ratio(slopes: DataFrame, ratio: str) -> DataFrame:
    return (
        slopes.where("rows275 > 0 and rows350 > 0")
        .drop("rows275", "rows350")
        .withColumn(ratio, ieee_div("slope275", "slope350"))
    )

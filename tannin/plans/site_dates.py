"""Slope ratios per site and date, and comparisons between sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tannin.functions.missing import (
    drop_incomplete, ieee_ln, strict_avg, strict_variance,
)
from tannin.functions.parsing import as_number, parse_number
from tannin.operators.merging import merge_tables
from tannin.operators.slopes import slope_columns, slope_ratio, with_ratio
from tannin.operators.spectra import (
    SITE_DATE, label_type, mean_spectra, suva_spectrum, wavelength_total,
)

SURFACE, GROUND = "Surface Water", "Groundwater"

# The site types that count as aquatic.
AQUATIC_TYPES = ("Core Aquatic", "Gradient Aquatic")

# The drivers put into long form, in their order; ``mean_evelation_m`` is the
# spelling of the input.
DRIVERS = [
    "latitude", "longitude", "mean_evelation_m", "mean_annual_precipitation_mm",
    "mean_annual_temperature_C", "watershed_size_km2", "lake_depth_mean_m",
    "lake_depth_max_m",
]


def slope_ratio_by_site_date(
    scan: DataFrame, chem: DataFrame, keys: Sequence[str] = SITE_DATE
) -> DataFrame:
    """Slopes of all SUVA values of a site and date, and their ratio."""
    spectrum = suva_spectrum(scan, chem, complete=False)
    return slope_ratio(drop_incomplete(spectrum, ["SUVA"]), keys)


def compare_water_types(surface: DataFrame, ground: DataFrame) -> DataFrame:
    """Both slope tables under each other with a ``type`` column."""
    return label_type(surface, SURFACE).unionByName(label_type(ground, GROUND))


def slope_ratio_complete(
    spectrum: DataFrame, keys: Sequence[str] = SITE_DATE
) -> DataFrame:
    """Slope ratio of mean spectra, for groups with a complete spectrum only.

    Completeness is a count inside the same aggregate as the slopes: a group
    needs a value at every wavelength seen anywhere in the input.
    """
    means = mean_spectra(spectrum, keys).where(F.col("wavelength").isNotNull())
    slopes = (
        drop_incomplete(means, keys).groupBy(*keys)
        .agg(F.count("SUVA").alias("present"), *slope_columns())
    )
    complete = slopes.where(F.col("present") == wavelength_total(means))
    return with_ratio(complete.drop("present"), "Sr")


def site_variation(slopes: DataFrame) -> DataFrame:
    """Variance and mean of the slope ratio per site."""
    return slopes.groupBy("siteID").agg(
        strict_variance("Sr").alias("var"), strict_avg("Sr").alias("mean")
    )


def overall_variation(slopes: DataFrame) -> DataFrame:
    """Variance and mean of the slope ratio over all rows."""
    return slopes.agg(
        strict_variance("Sr").alias("overall_var"),
        strict_avg("Sr").alias("overall_mean"),
    )


def site_vs_overall(slopes: DataFrame) -> DataFrame:
    """Each site's variation beside the overall one.

    Both are Spark's own moments, merged pairwise and free of cancelling sums.
    The overall ones are a scalar over the same slopes, whose shuffle Spark
    runs once and uses again.
    """
    overall = overall_variation(slopes).select(F.struct("overall_var", "overall_mean")).scalar()
    return site_variation(slopes).withColumn("overall", overall).select(
        "siteID", "var", "mean", "overall.overall_var", "overall.overall_mean"
    )


def aquatic_sites(sites: DataFrame) -> DataFrame:
    return sites.where(F.col("site_type").isin(*AQUATIC_TYPES))


def site_drivers(variation: DataFrame, sites: DataFrame) -> DataFrame:
    """Variation of the aquatic sites with their metadata.

    The site table is small as a rule; Spark broadcasts it when its size
    allows and shuffles on the site otherwise.
    """
    attributes = aquatic_sites(sites).withColumnRenamed("site_id", "siteID")
    return merge_tables(variation, attributes, ["siteID"])


def driver_long(site_table: DataFrame) -> DataFrame:
    """One row per site and driver, with text made numeric and basin size logged."""
    numeric = site_table.select(
        "siteID", "site_subtype", "var", "mean", "dominant_nlcd_classes",
        *(_driver(name).alias(name) for name in DRIVERS),
    )
    kept = numeric.columns[:5]
    return numeric.unpivot(kept, DRIVERS, "variable", "value")


def _driver(name: str) -> Column:
    if name == "mean_annual_temperature_C":
        return parse_number(name)
    if name in ("mean_evelation_m", "mean_annual_precipitation_mm"):
        return as_number(name)
    if name == "watershed_size_km2":
        return ieee_ln(name)
    return F.col(name).cast("double")


def sr_time_series(
    slopes: DataFrame, group: Sequence[str] = ("siteID",), ordered: bool = True
) -> DataFrame:
    """Points of the slope-ratio lines, per group in date order."""
    series = slopes.select(*group, "collectDate", "Sr")
    return series.orderBy(*group, "collectDate") if ordered else series

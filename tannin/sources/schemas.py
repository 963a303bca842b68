"""Fixed column names and types of the input tables.

Files may carry more columns; only these are read.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


_S, _D, _TS = T.StringType(), T.DoubleType(), T.TimestampType()

ABSORBANCE_SCAN = _table(
    sampleID=_S, domainID=_S, siteID=_S, collectDate=_TS,
    wavelength=_D, decadicAbsorbance=_D, release=_S,
)
ANALYTES = _table(
    sampleID=_S, domainID=_S, siteID=_S, collectDate=_TS,
    analyte=_S, analyteConcentration=_D, release=_S,
)
WATER_QUALITY = _table(
    siteID=_S, startDateTime=_TS, horizontalPosition=_S,
    rawCalibratedfDOM=_D, release=_S,
)
SITES = _table(
    site_id=_S, site_type=_S, site_subtype=_S, latitude=_D, longitude=_D,
    mean_evelation_m=_S, mean_annual_precipitation_mm=_S,
    mean_annual_temperature_C=_S, dominant_nlcd_classes=_S,
    watershed_size_km2=_D, lake_depth_mean_m=_D, lake_depth_max_m=_D,
)
SUVA_SPECTRUM = _table(
    siteID=_S, collectDate=_S, wavelength=_D, absorbance=_D, DOC=_D, SUVA=_D,
)

# Table names end in these, after a prefix for the water type.
PRODUCT_TABLES = {
    "externalLabAbsorbanceScan": (ABSORBANCE_SCAN, "collectDate"),
    "externalLabDataByAnalyte": (ANALYTES, "collectDate"),
    "instantaneous": (WATER_QUALITY, "startDateTime"),
}

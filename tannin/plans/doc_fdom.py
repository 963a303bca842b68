"""Laboratory DOC paired with the 5-minute sensor average."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tannin.functions.missing import strict_avg
from tannin.functions.parsing import round_5min
from tannin.operators.merging import merge_tables
from tannin.operators.stats import fit_summary
from tannin.sources.sinks import store

# Sensor positions where fDOM is measured.
SENSOR_POSITIONS = ("102", "112", "103")


def doc_by_time(chem: DataFrame, keys: Sequence[str] = ("siteID", "domainID")) -> DataFrame:
    """Mean DOC per collection time, the time then rounded to 5 minutes.

    Averaging comes before rounding: two collections within one bucket stay
    two rows.
    """
    doc = chem.where(F.col("analyte") == "DOC")
    means = doc.groupBy("collectDate", *keys).agg(
        strict_avg("analyteConcentration").alias("DOC")
    )
    return means.withColumn("collectDate", round_5min("collectDate"))


def sensor_positions(sensor: DataFrame) -> DataFrame:
    """Readings from the positions where fDOM is expected."""
    return sensor.where(F.col("horizontalPosition").isin(*SENSOR_POSITIONS))


def _rounded_readings(sensor: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sensor_positions(sensor).select(
        *keys, round_5min("startDateTime").alias("startDateTime"),
        "rawCalibratedfDOM",
    )


def _bucket_means(readings: DataFrame, keys: Sequence[str]) -> DataFrame:
    return readings.groupBy("startDateTime", *keys).agg(
        strict_avg("rawCalibratedfDOM").alias("fDOM")
    )


def fdom_5min(sensor: DataFrame, keys: Sequence[str] = ("siteID",)) -> DataFrame:
    """Mean sensor fDOM per 5-minute bucket; rounding comes first.

    One missing reading makes the bucket missing.
    """
    return _bucket_means(_rounded_readings(sensor, keys), keys)


def pair_doc_fdom(
    chem: DataFrame, sensor: DataFrame, by: Sequence[str] = ("siteID",)
) -> DataFrame:
    """Every DOC collection with the sensor mean of its bucket, if there is one.

    ``by`` keeps sites apart; pass ``()`` for input of a single site whose
    sensor rows carry no site.

    One plan for all sizes.  The collections are stored, so Spark knows their
    bytes.  It moves the restriction to their buckets below the averaging of
    the readings, as a broadcast, when they are small enough for that; else
    the readings are averaged first, which combines before the shuffle, and
    only means meet the collections, of which a hot bucket is split.
    """
    doc = store(doc_by_time(chem), "collections")
    keys = ["collectDate", *by]
    wanted = doc.select(
        F.col("collectDate").alias("startDateTime"), *by
    ).distinct()
    fdom = fdom_5min(sensor, by).join(wanted, wanted.columns, "left_semi")
    pairs = merge_tables(doc, fdom.withColumnRenamed("startDateTime", "collectDate"), keys, "left")
    return pairs.select("collectDate", "domainID", "siteID", "DOC", "fDOM")


def doc_fdom_fit(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Linear regression of DOC on fDOM with its summary."""
    return fit_summary(pairs, y="DOC", x="fDOM", by=by)

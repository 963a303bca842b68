"""The 5-minute sensor average on an unbounded input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tannin.functions.missing import strict_avg
from tannin.functions.parsing import BUCKET, HALF_BUCKET
from tannin.plans.doc_fdom import sensor_positions


def fdom_stream(
    sensor: DataFrame, keys: Sequence[str] = ("siteID",), lateness: str = "10 minutes"
) -> DataFrame:
    """Running 5-minute means; a bucket closes ``lateness`` after its end.

    The window itself is the grouping key, so that the watermark can close
    buckets and drop their state.
    """
    bucket = F.window("startDateTime", BUCKET, BUCKET, HALF_BUCKET).alias("bucket")
    means = (
        sensor_positions(sensor.withWatermark("startDateTime", lateness))
        .groupBy(bucket, *keys)
        .agg(strict_avg("rawCalibratedfDOM").alias("fDOM"))
    )
    middle = F.col("bucket.start") + F.expr(f"INTERVAL {HALF_BUCKET}")
    return means.select(middle.alias("startDateTime"), *keys, "fDOM")


def write_fdom_stream(
    means: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
    **trigger,
) -> StreamingQuery:
    """Append closed buckets to files; restartable from ``checkpoint``."""
    writer = (
        means.writeStream.format(fmt).outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(**trigger) if trigger else writer).start()

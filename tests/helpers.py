"""Small hand-made inputs."""

from __future__ import annotations

import io
import math
from contextlib import redirect_stdout
from datetime import datetime

from pyspark.sql import DataFrame

SCAN = (
    "sampleID string, domainID string, siteID string, collectDate timestamp, "
    "wavelength double, decadicAbsorbance double"
)
CHEM = "sampleID string, analyte string, analyteConcentration double"
SPECTRUM = "siteID string, collectDate timestamp, wavelength double, SUVA double"
DAY = datetime(2024, 5, 1)


def scan(spark, readings, site="A", day=DAY) -> DataFrame:
    """``readings``: (sample, wavelength, absorbance) or with a site."""
    rows = [
        (r[0], "D1", r[3] if len(r) > 3 else site, day, float(r[1]), r[2])
        for r in readings
    ]
    return spark.createDataFrame(rows, SCAN)


def chem(spark, *rows) -> DataFrame:
    return spark.createDataFrame(list(rows), CHEM)


def exponential(sample, slope=0.015, factor=1.0, step=2, skip=()):
    """A spectrum whose logarithm is a line of known slope."""
    return [
        (sample, w, factor * math.exp(-slope * w))
        for w in range(200, 401, step) if w not in skip
    ]


def one(df: DataFrame) -> dict:
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0].asDict()


def plan(df: DataFrame) -> str:
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()

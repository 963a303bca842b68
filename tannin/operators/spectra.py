"""From raw absorbance scans to SUVA spectra, and selections on spectra."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tannin.functions.missing import (
    drop_incomplete, ieee_div, ieee_ln, known, nan_to_null, strict_avg,
)
from tannin.operators.merging import merge_tables
from tannin.sources.sinks import store

SAMPLE_ATTRIBUTES = ("domainID", "siteID", "collectDate")
SITE_DATE = ("siteID", "collectDate")

# Most columns of a wide spectrum.
WIDEST = 10_000


def average_replicates(
    scan: DataFrame, attributes: Sequence[str] = SAMPLE_ATTRIBUTES, check: bool = True
) -> DataFrame:
    """One row per sample and wavelength: the mean of the replicate scans.

    A missing replicate makes the mean missing.  The sample's attributes ride
    along as grouping keys: text in an aggregation buffer would force a sort,
    as keys they leave it a hash aggregate that combines before the shuffle.
    The wavelength in the key spreads even a sample with very many rows.

    Replicates with different attributes raise an error when the rows are
    computed, unless a later aggregate does so and ``check`` is off.
    """
    means = scan.groupBy("sampleID", *attributes, "wavelength").agg(
        strict_avg("decadicAbsorbance").alias("absorbance")
    )
    return one_per_key(means, ["sampleID", "wavelength"]) if check else means


def one_per_key(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows themselves; a key with several of them raises when it is computed.

    Rows that lack a part of the key belong to nothing and may be several.  For aggregates that carry more grouping columns than the key: each set of
    values is one row, so the window holds no more than the sets of one key.
    No input is read twice, and filters on the key pass through to the scan.
    """
    text = F.concat_ws(" ", *(F.col(k).cast("string") for k in keys))
    several = F.raise_error(F.concat(F.lit(f"attributes differ within {' '.join(keys)}: "), text))
    known = reduce(and_, (F.col(k).isNotNull() for k in keys))
    counted = groups.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    # the filter on the count cannot move below it
    alone = F.when((F.col("_rows") > 1) & known, several.cast("boolean")).otherwise(F.lit(True))
    return counted.where(alone).drop("_rows")


def functional_violations(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Keys whose ``columns`` do not hold one single combination of values."""
    fingerprint = F.xxhash64(
        *(F.struct(F.col(c).isNull(), F.col(c)) for c in columns)
    )
    return (
        df.groupBy(*keys)
        .agg(F.min(fingerprint).alias("lo"), F.max(fingerprint).alias("hi"))
        .where("lo <> hi").select(*keys)
    )


def assert_functional(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """``df`` itself; raises when ``columns`` vary within ``keys``."""
    example = functional_violations(df, keys, columns).first()
    if example is not None:
        raise ValueError(f"{list(columns)} vary within {example.asDict()}")
    return df


def analyte_slice(chem: DataFrame, analyte: str) -> DataFrame:
    """Sample and concentration of one analyte, the latter named after it."""
    return chem.where(F.col("analyte") == analyte).select(
        "sampleID", F.col("analyteConcentration").alias(analyte)
    )


def analyte_means(chem: DataFrame, *analytes: str) -> DataFrame:
    """One row per sample with the mean of each analyte's known analyses.

    Analyses without a value are left out first, as they are from a spectrum
    with one copy per analysis.
    """
    value = known("analyteConcentration")
    wanted = chem.where(F.col("analyte").isin(*analytes))
    return wanted.groupBy("sampleID").agg(*(
        F.expr(f"avg({value}) filter (where analyte = '{a}')").alias(a) for a in analytes
    ))


def suva(absorbance: str, doc: str) -> Column:
    """Specific absorbance in L/(mg m)."""
    return ieee_div(absorbance, doc) * 100


def suva_spectrum(
    scan: DataFrame,
    chem: DataFrame,
    doc_replicates: str = "cross",
    complete: bool = True,
    null_safe: bool = False,
) -> DataFrame:
    """Averaged spectrum joined with DOC, and SUVA.

    ``doc_replicates``: "cross" keeps a copy of the spectrum per DOC analysis
    of the sample, "mean" averages the analyses first.  ``complete`` drops
    rows with any missing value.
    """
    if doc_replicates == "mean":
        doc = analyte_means(chem, "DOC")
    elif doc_replicates == "cross":
        doc = analyte_slice(chem, "DOC")
    else:
        raise ValueError(f"doc_replicates is 'cross' or 'mean', not {doc_replicates!r}")
    joined = merge_tables(
        average_replicates(scan), doc, ["sampleID"], null_safe=null_safe
    )
    spectrum = joined.withColumn("SUVA", suva("absorbance", "DOC"))
    return drop_incomplete(spectrum) if complete else spectrum


def wavelength_at(df: DataFrame, *wavelengths: float) -> DataFrame:
    """Rows at exactly one of the wavelengths."""
    return df.where(F.col("wavelength").isin(*wavelengths))


def wavelength_band(df: DataFrame, low: float, high: float) -> DataFrame:
    """Rows within a closed wavelength interval."""
    return df.where(F.col("wavelength").between(low, high))


def mean_spectra(spectrum: DataFrame, keys: Sequence[str] = SITE_DATE) -> DataFrame:
    """Mean SUVA per group and wavelength; missing values are skipped."""
    return spectrum.groupBy(*keys, "wavelength").agg(
        F.avg(nan_to_null("SUVA")).alias("SUVA")
    )


def wavelength_total(means: DataFrame) -> Column:
    """How many wavelengths occur anywhere, as a scalar subquery.

    It also counts the missing means, which makes it read the same columns as
    the query around it, so Spark runs the averaging once and reuses it.
    """
    counted = means.agg(
        F.count_distinct("wavelength").alias("wavelengths"),
        F.count_if(F.col("SUVA").isNull()).alias("missing"),
    )
    return counted.select(
        F.when(F.col("missing") >= 0, F.col("wavelengths"))
    ).scalar()


def complete_spectra(
    spectrum: DataFrame, keys: Sequence[str] = SITE_DATE
) -> DataFrame:
    """Mean spectra of the groups with a value at every wavelength seen anywhere.

    Equivalent to pivoting by wavelength and keeping rows without a gap, but
    counts instead: the window holds one row per wavelength of one group.
    """
    means = mean_spectra(spectrum, keys).where(F.col("wavelength").isNotNull())
    present = F.count("SUVA").over(Window.partitionBy(*keys))
    return (
        drop_incomplete(means, keys)
        .withColumn("present", present)
        .where(F.col("present") == wavelength_total(means))
        .drop("present")
    )


def spectra_wide(
    spectrum: DataFrame, wavelengths: Iterable[float] | None = None,
    keys: Sequence[str] = SITE_DATE,
) -> DataFrame:
    """One row per group, one column of mean SUVA per wavelength, in ascending order.

    Without a list the columns are all wavelengths that occur.  They are found
    in a distributed pass over the mean spectra, which are stored for it, and
    are at most ``WIDEST``, since columns must be known before a query runs.
    """
    means = mean_spectra(spectrum, keys).where(F.col("wavelength").isNotNull())
    if wavelengths is None:
        means = store(means, "means")
        found = means.select("wavelength").distinct().limit(WIDEST + 1).collect()
        if len(found) > WIDEST:
            raise ValueError(f"more than {WIDEST} wavelengths")
        wavelengths = sorted(r["wavelength"] for r in found)
    # one row per group and wavelength
    return means.groupBy(*keys).pivot("wavelength", list(wavelengths)).agg(F.max("SUVA"))


def group_mean_on_rows(
    spectrum: DataFrame, keys: Sequence[str] = (*SITE_DATE, "wavelength")
) -> DataFrame:
    """Every row kept, SUVA replaced by the mean of its group.

    Aggregate and join back rather than a window, which would hold all rows
    of a group in one task: of the join Spark splits the rows of a hot key.
    """
    means = spectrum.groupBy(*keys).agg(F.avg(nan_to_null("SUVA")).alias("SUVA"))
    return merge_tables(spectrum.drop("SUVA"), means, keys, null_safe=True).select(*spectrum.columns)


def spectrum_series(
    spectrum: DataFrame,
    group: Sequence[str] = ("siteID", "sampleID"),
    x_limits: tuple[float, float] | None = None,
    y_limits: tuple[float, float] | None = None,
    log: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """Points of the spectrum lines, per group in wavelength order.

    Points outside the limits are left out; ``log`` gives ln(SUVA), of 0 minus infinity.
    """
    value = ieee_ln("SUVA") if log else F.col("SUVA")
    series = spectrum.select(*group, "wavelength", value.alias("SUVA"))
    if x_limits is not None:
        series = series.where(F.col("wavelength").between(*x_limits))
    if y_limits is not None:
        series = series.where(F.col("SUVA").between(*y_limits))
    return series.orderBy(*group, "wavelength") if ordered else series


def label_type(df: DataFrame, label: str) -> DataFrame:
    """Add a constant ``type`` column."""
    return df.withColumn("type", F.lit(label))

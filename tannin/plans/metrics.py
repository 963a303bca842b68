"""Per-sample metrics, their iron correction and site statistics.

All metrics of a sample come out of one conditional aggregate over its
spectrum.  Only the wavelengths that some metric needs are read.

``replicates`` says what happens when a sample has several analyses of DOC (or
iron).  "mean" averages them first: one row per sample.  "cross" gives one row
per combination of analyses in every metric, as chained outer joins on the
sample would: k DOC rows give k*k*k rows.  Both have the same slope ratios.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tannin.functions.missing import (
    drop_incomplete, ieee_div, strict_avg, strict_stddev,
)
from tannin.operators.iron import (
    BAND_COEFFICIENT, IRON_AT_254, IRON_AT_350, iron_free,
)
from tannin.operators.merging import merge_tables
from tannin.operators.slopes import (
    BAND_275, BAND_350, IN_ANY_BAND, band_rows, band_slope,
)
from tannin.operators.spectra import (
    SAMPLE_ATTRIBUTES, analyte_means, analyte_slice, average_replicates, suva,
)

# The single wavelengths of the metrics, in nm.
AT_250, AT_254, AT_350 = 250, 254, 350
NEAR_365 = (364, 366)

METRICS = [
    "sampleID", *SAMPLE_ATTRIBUTES, "DOC", "SUVA254", "SUVA350", "E2E3", "SR",
]
CORRECTED = ["Fe", "correctedSUVA254", "correctedSUVA350", "correctedSR"]
RAW_NAMES = {"SUVA254": "rawSUVA254", "SUVA350": "rawSUVA350", "SR": "rawSR"}


def _at(*wavelengths: float) -> str:
    return f"wavelength in ({', '.join(map(str, wavelengths))})"


USED_WAVELENGTHS = f"{_at(AT_250, AT_254, *NEAR_365)} or {IN_ANY_BAND}"
BOTH_BANDS = "rows275 > 0 and rows350 > 0"


def _value_at(wavelength: float, column: str) -> Column:
    return F.expr(f"max({column}) filter (where {_at(wavelength)})")


def _mean_near_365() -> Column:
    return F.expr(f"avg(absorbance) filter (where {_at(*NEAR_365)})")


def _known(chem: DataFrame, analyte: str) -> DataFrame:
    return drop_incomplete(analyte_slice(chem, analyte), [analyte])


def _spectrum(scan: DataFrame, lab: DataFrame) -> DataFrame:
    """Complete rows of the averaged spectrum with DOC and SUVA.

    ``lab`` has DOC per sample and may have iron, which may be missing.
    """
    # differing attributes are found by the aggregate per sample
    averaged = drop_incomplete(average_replicates(scan.where(USED_WAVELENGTHS), check=False))
    joined = merge_tables(averaged, drop_incomplete(lab, ["DOC"]), ["sampleID"])
    spectrum = joined.withColumn("SUVA", suva("absorbance", "DOC"))
    return drop_incomplete(spectrum, [c for c in spectrum.columns if c != "Fe"])


def _raw_profile() -> list[Column]:
    """Per-sample aggregates of the spectrum.

    Site, domain, date and DOC are those of the 254 nm row, so a sample
    without one has none.  Rows of one sample with different attributes, at
    whatever wavelengths, are a conflict.
    """
    parts = ", ".join(f"{c} is null, {c}" for c in SAMPLE_ATTRIBUTES)
    conflict = " <> ".join(f"{end}(xxhash64({parts}))" for end in ("min", "max"))
    return [
        *(_value_at(AT_254, c).alias(c) for c in (*SAMPLE_ATTRIBUTES, "DOC")),
        _value_at(AT_254, "SUVA").alias("SUVA254"),
        _value_at(AT_350, "SUVA").alias("SUVA350"),
        _value_at(AT_254, "absorbance").alias("abs254"),
        _value_at(AT_350, "absorbance").alias("abs350"),
        _value_at(AT_250, "absorbance").alias("abs250"),
        _mean_near_365().alias("abs365"),
        band_rows(BAND_275).alias("rows275"),
        band_rows(BAND_350).alias("rows350"),
        band_slope(BAND_275).alias("slope275"),
        band_slope(BAND_350).alias("slope350"),
        F.expr(conflict).alias("conflict"),
    ]


def _iron_profile() -> list[Column]:
    """Per-sample aggregates of the iron-corrected spectrum."""
    return [
        _value_at(AT_254, "Fe").alias("Fe"),
        _value_at(AT_254, "corrected254").alias("correctedSUVA254"),
        _value_at(AT_350, "corrected350").alias("correctedSUVA350"),
        band_slope(BAND_275, "correctedSUVA").alias("correctedSlope275"),
        band_slope(BAND_350, "correctedSUVA").alias("correctedSlope350"),
        F.count("Fe").alias("rowsFe"),
    ]


def _with_corrections(spectrum: DataFrame) -> DataFrame:
    return spectrum.withColumns({
        "corrected254": suva(iron_free("absorbance", IRON_AT_254), "DOC"),
        "corrected350": suva(iron_free("absorbance", IRON_AT_350), "DOC"),
        "correctedSUVA": suva(iron_free("absorbance", BAND_COEFFICIENT), "DOC"),
    })


def _ratios(profile: DataFrame) -> DataFrame:
    """Add E2E3 and SR; keep samples that some metric has a row for."""
    single = "coalesce(abs254, abs350, abs250, abs365) is not null"
    site = (
        "case when conflict then raise_error(concat('attributes differ within "
        "sample ', sampleID)) else siteID end"
    )
    return profile.where(f"{single} or ({BOTH_BANDS})").withColumns({
        "siteID": F.expr(site),
        "E2E3": ieee_div("abs250", "abs365"),
        "SR": F.when(F.expr(BOTH_BANDS), ieee_div("slope275", "slope350")),
    })


def _corrected_ratio(profile: DataFrame) -> DataFrame:
    ratio = ieee_div("correctedSlope275", "correctedSlope350")
    return profile.withColumn("correctedSR", F.when(F.expr(BOTH_BANDS), ratio))


def _per_analysis(profile: DataFrame, lab: DataFrame, absorbance: str) -> DataFrame:
    """One row per analysis for which the sample has a row at a wavelength.

    0/0 is missing, so such a pair has no row.  Samples without any row at
    that wavelength stay, with the analysis missing.
    """
    same = "profile.sampleID = lab.sampleID"
    row_exists = (
        f"profile.{absorbance} is not null "
        f"and not (profile.{absorbance} = 0 and lab.DOC = 0)"
    )
    return profile.alias("profile").join(
        lab.alias("lab"), F.expr(f"{same} and {row_exists}"), "left"
    )


def _cross_raw(profile: DataFrame, doc: DataFrame) -> DataFrame:
    """Raw metrics for every combination of DOC analyses."""
    keep = [c for c in profile.columns if c not in ("DOC", "SUVA254", "SUVA350")]
    base = profile.select(*keep)
    base = _per_analysis(base, doc, "abs254").select(
        "profile.*", F.col("lab.DOC").alias("DOC")
    ).withColumn("SUVA254", suva("abs254", "DOC"))
    base = _per_analysis(base, doc, "abs350").select(
        "profile.*", suva("abs350", "lab.DOC").alias("SUVA350")
    )
    return _per_analysis(base, doc, "abs250").select("profile.*")


def _cross_corrected(rows: DataFrame, doc: DataFrame, iron: DataFrame) -> DataFrame:
    """Corrected metrics for every combination of DOC and iron analyses."""
    dropped = ("Fe", "correctedSUVA254", "correctedSUVA350")
    lab = merge_tables(doc, iron, ["sampleID"])
    base = rows.select(*(c for c in rows.columns if c not in dropped))
    base = _per_analysis(base, lab, "abs254").select(
        "profile.*", F.col("lab.Fe").alias("Fe"),
        suva(iron_free("abs254", IRON_AT_254, "lab.Fe"), "lab.DOC")
        .alias("correctedSUVA254"),
    )
    return _per_analysis(base, lab, "abs350").select(
        "profile.*",
        suva(iron_free("abs350", IRON_AT_350, "lab.Fe"), "lab.DOC")
        .alias("correctedSUVA350"),
    )


def _is_cross(replicates: str) -> bool:
    if replicates not in ("mean", "cross"):
        raise ValueError(f"replicates is 'mean' or 'cross', not {replicates!r}")
    return replicates == "cross"


def sample_metrics(
    scan: DataFrame, chem: DataFrame, replicates: str = "mean"
) -> DataFrame:
    """DOC, SUVA at 254 and 350 nm, E2:E3 and slope ratio per sample."""
    cross = _is_cross(replicates)
    doc = _known(chem, "DOC") if cross else analyte_means(chem, "DOC")
    profile = _ratios(
        _spectrum(scan, doc).groupBy("sampleID").agg(*_raw_profile())
    )
    return (_cross_raw(profile, doc) if cross else profile).select(*METRICS)


def corrected_metrics(
    scan: DataFrame, chem: DataFrame, replicates: str = "mean", with_raw: bool = True
) -> DataFrame:
    """Iron-corrected metrics, beside the raw ones or alone.

    Raw and corrected metrics come out of the same aggregate.  With the raw
    ones every sample is kept; alone, only those with iron.
    """
    if _is_cross(replicates):
        doc, iron = _known(chem, "DOC"), _known(chem, "Fe")
        lab = merge_tables(doc, iron, ["sampleID"], "left")
    else:
        doc, iron = None, None
        lab = analyte_means(chem, "DOC", "Fe")
    spectrum = _with_corrections(_spectrum(scan, lab))
    profile = _corrected_ratio(_ratios(
        spectrum.groupBy("sampleID").agg(*_raw_profile(), *_iron_profile())
    ))
    if not with_raw:
        # the single metrics without a corrected counterpart make no row
        profile = profile.where(
            f"rowsFe > 0 and (coalesce(abs254, abs350) is not null or ({BOTH_BANDS}))"
        )
        if doc is not None:
            profile = _cross_corrected(profile, doc, iron)
        return profile.select("sampleID", *CORRECTED)
    if doc is not None:
        profile = _cross_corrected(_cross_raw(profile, doc), doc, iron)
    return profile.select(*METRICS, *CORRECTED).withColumnsRenamed(RAW_NAMES)


def raw_vs_corrected(metrics: DataFrame, corrected: DataFrame) -> DataFrame:
    """Put two stored metric tables beside each other, keeping every sample."""
    return merge_tables(
        metrics.withColumnsRenamed(RAW_NAMES), corrected, ["sampleID"], "full_outer"
    )


def e2_e3(spectrum: DataFrame) -> DataFrame:
    """Absorbance at 250 nm over mean absorbance at 364 and 366 nm per sample.

    Expects one row per sample and wavelength.
    """
    return (
        spectrum.where(_at(AT_250, *NEAR_365)).groupBy("sampleID")
        .agg(
            _value_at(AT_250, "absorbance").alias("abs250"),
            _mean_near_365().alias("abs365"),
        )
        .select("sampleID", ieee_div("abs250", "abs365").alias("E2E3"))
    )


def site_statistics(metrics: DataFrame) -> DataFrame:
    """Sample count, mean and standard deviation of the metrics per site."""
    spread = [
        aggregate(column).alias(prefix + column)
        for column in ("DOC", "SUVA254", "SUVA350", "SR")
        for prefix, aggregate in (("mean", strict_avg), ("sd", strict_stddev))
    ]
    return metrics.groupBy("siteID").agg(
        F.count(F.lit(1)).alias("nSamples"), *spread
    )

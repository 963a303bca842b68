"""Registered queries and their SQL counterparts."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

import oracle_queries  # noqa: E402
from tannin.functions.missing import drop_incomplete  # noqa: E402
from tannin.functions.parsing import (  # noqa: E402
    as_number, parse_number, parse_timestamp, round_5min,
)
from tannin.operators import iron, slopes, spectra, stats  # noqa: E402
from tannin.plans import doc_fdom, metrics, site_dates  # noqa: E402
from tannin.plans import tables as given  # noqa: E402
from tannin.sources import schemas, sinks  # noqa: E402
from tannin.sources import tables as sources  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]

try:  # the subpackage is optional
    import corpus_pipeline
    from tannin.llm import queries as llm_queries
except ImportError:
    llm_queries = corpus_pipeline = None

# Doubles are compared to so many significant digits, sums of many terms to
# fewer, since they differ in their last bits between engines.
DIGITS, FLOOR = 9, "1e-12"
FEWER_DIGITS = {
    name: 6 for name in (
        "density_curve", "driver_fit", "linear_fit", "doc_fdom_fit", "doc_fdom_fit_by_site",
        "linear_fit_band", "driver_log_variance_band", "variation_log_band", "doc_fdom_band",
    )
} | {
    name: 8 for name in (
        "site_variation", "overall_variation", "site_vs_overall", "site_drivers", "driver_long",
        "site_statistics", "write_statistics", "box_stats",
    )
}
SMOKE_DIR = "/root/testdata/sf0.001"


def _rounded(df: DataFrame, digits: int) -> DataFrame:
    """Doubles with so many significant digits, tiny ones as zero."""
    def text(c: str) -> str:
        return f"cast(format_string('%.{digits - 1}e', `{c}`) as double)"

    return df.select(*(
        F.expr(f"case when abs(`{c}`) < {FLOOR} then 0d when `{c}` is not null then {text(c)} end").alias(c)
        if isinstance(df.schema[c].dataType, T.DoubleType) else F.col(f"`{c}`")
        for c in df.columns
    ))


def _inputs(spark: SparkSession, d: str, water: str | None = None):
    return given.scan(spark, d, water), given.chem(spark, d, water)


def _spectrum(spark, d, water=None):
    return spectra.suva_spectrum(*_inputs(spark, d, water))


def _metrics(spark, d):
    return metrics.sample_metrics(*_inputs(spark, d))


def _slopes(spark, d, water=None):
    return site_dates.slope_ratio_by_site_date(*_inputs(spark, d, water))


def _whole_spectrum(spark, d):
    """With the rows that lack a value, as it is before they are dropped."""
    return spectra.suva_spectrum(*_inputs(spark, d), complete=False)


def _both_waters(spark, d):
    return site_dates.compare_water_types(
        _slopes(spark, d, "surface"), _slopes(spark, d, "ground")
    )


def _complete_slopes(spark, d):
    return site_dates.slope_ratio_complete(_whole_spectrum(spark, d))


def _drivers(spark, d):
    variation = site_dates.site_variation(_complete_slopes(spark, d))
    return site_dates.site_drivers(variation, given.sites(spark, d))


def _driver_long(spark, d):
    return site_dates.driver_long(_drivers(spark, d))


def _pairs(spark, d):
    return doc_fdom.pair_doc_fdom(given.grabs(spark, d), given.sensor(spark, d))


# --- sources and sinks ------------------------------------------------------

def _read_product(spark, d):
    """Write both product tables, read them back restricted; some rows are provisional."""
    scan, chem = _inputs(spark, d)
    scan = scan.withColumn("release", F.expr("if(wavelength % 5 = 0, 'PROVISIONAL', 'RELEASE')"))
    root = sinks.scratch_path(spark, "product")
    for name, df in (("swc_externalLabAbsorbanceScan", scan),
                     ("swc_externalLabDataByAnalyte", chem)):
        layout = [c for c in ("siteID",) if c in df.columns]
        sinks.write_table(df, f"{root}/{name}", fmt="parquet", partition_by=layout)
    tables = sources.read_product(
        spark, root, ["swc_externalLabAbsorbanceScan"], sites=["N1", "N4"], start="2023-10",
        end="2023-11", include_provisional=False,
    )
    found = sources.table_by_pattern(tables, "AbsorbanceScan")
    return found.groupBy("sampleID", "siteID").agg(
        F.count(F.lit(1)).alias("readings"), F.max("wavelength").alias("top")
    )


def _register_tables(spark, d):
    scan, chem = _inputs(spark, d)
    sources.register_tables({"swc_scan": scan, "swc_chem": chem})
    return spark.sql(
        "select s.siteID, c.analyte, count(*) as readings from swc_scan s "
        "join swc_chem c on s.sampleID = c.sampleID group by s.siteID, c.analyte"
    )


def _table_by_pattern(spark, d):
    scan, chem = _inputs(spark, d)
    found = sources.table_by_pattern(
        {"gwc_externalLabAbsorbanceScan": scan, "gwc_externalLabDataByAnalyte": chem},
        "DataByAnalyte",
    )
    return found.select("sampleID", "analyte", "analyteConcentration")


def _read_sites(spark, d):
    path = sinks.scratch_path(spark, "sites")
    sinks.write_table(given.sites(spark, d), path, fmt="csv")
    return sources.read_sites(spark, path)


def _read_csv_dir(spark, d):
    """Two folders of spectra with their columns in different orders."""
    root = sinks.scratch_path(spark, "spectra")
    columns = ["siteID", "collectDate", "wavelength", "absorbance", "DOC", "SUVA"]
    folders = {"surface": columns, "ground": columns[::-1]}
    for water, order in folders.items():
        spectrum = _spectrum(spark, d, water).select(
            F.lit("row").alias("X"), *order
        )
        sinks.write_table(spectrum, f"{root}/{water}", fmt="csv")
    stacked = sources.read_csv_dir(
        spark, [f"{root}/{water}" for water in folders], schemas.SUVA_SPECTRUM
    )
    moment = parse_timestamp("collectDate").cast("timestamp_ntz")
    return stacked.withColumn("collectDate", moment)


def _write_table(spark, d):
    path = sinks.scratch_path(spark, "pairs")
    pairs = _pairs(spark, d)
    sinks.write_table(pairs, path, fmt="parquet", partition_by=["siteID"])
    return spark.read.parquet(path).select(*pairs.columns)


def _product(spark, label, **tables):
    """Store tables as product tables; returns their folder."""
    root = sinks.scratch_path(spark, label)
    for name, df in tables.items():
        sinks.write_table(df, f"{root}/{name}", fmt="parquet", partition_by=["siteID"])
    return root


def _read_sensor_product(spark, d):
    """Sensor readings written by site, provisional ones (one position) left out."""
    position = "if(horizontalPosition = '112', 'PROVISIONAL', 'RELEASE')"
    sensor = given.sensor(spark, d).withColumn("release", F.expr(position))
    root = _product(spark, "sensor", waq_instantaneous=sensor)
    read = sources.read_product(
        spark, root, ["waq_instantaneous"], sites=["N2", "N7"], include_provisional=False)
    found = sources.table_by_pattern(read, "instantaneous")
    return found.groupBy("siteID", "horizontalPosition").agg(
        F.count(F.lit(1)).alias("readings"), F.count("rawCalibratedfDOM").alias("known"),
        F.max("rawCalibratedfDOM").alias("top"))


def _read_ground_product(spark, d):
    """Ground water tables written and read, and the spectra of one site."""
    scan, chem = _inputs(spark, d, "ground")
    lab = chem.selectExpr("sampleID", "'D' as domainID", "'N3' as siteID",
                          "timestamp_ntz '2024-01-01' as collectDate", "analyte", "analyteConcentration")
    root = _product(spark, "ground", gwc_externalLabAbsorbanceScan=scan.withColumn(
        "wavelength", F.col("wavelength").cast("double")), gwc_externalLabDataByAnalyte=lab)
    read = sources.read_product(
        spark, root, ["gwc_externalLabAbsorbanceScan", "gwc_externalLabDataByAnalyte"], sites="N3")
    spectrum = spectra.suva_spectrum(
        sources.table_by_pattern(read, "AbsorbanceScan"), sources.table_by_pattern(read, "DataByAnalyte"))
    return spectrum.withColumn("wavelength", F.col("wavelength").cast("long"))


def _site_doc_fdom(spark, d):
    """Pairs of one site from its two product tables, the sensor's without its site."""
    grabs = given.grabs(spark, d).withColumn("sampleID", F.lit("grab"))
    root = _product(spark, "site", swc_externalLabDataByAnalyte=grabs, waq_instantaneous=given.sensor(spark, d))
    read = sources.read_product(
        spark, root, ["swc_externalLabDataByAnalyte", "waq_instantaneous"], sites="N4")
    sensor = sources.table_by_pattern(read, "instantaneous").drop("siteID")
    return doc_fdom.pair_doc_fdom(sources.table_by_pattern(read, "DataByAnalyte"), sensor, by=())


def _written(query):
    """A result table written as CSV and read back."""
    def run(spark, d):
        df = query(spark, d)
        path = sinks.scratch_path(spark, "result")
        sinks.write_table(df, path)
        return sources.read_result(spark, path, df.schema)

    return run


def _bucketed_times(spark, d):
    return given.grabs(spark, d).select(
        "collectDate", round_5min("collectDate").alias("bucket")
    )


def _parsed(spark, d):
    site = given.sites(spark, d)
    return site.select(
        "site_id", parse_number("mean_annual_temperature_C").alias("temperature"),
        as_number("mean_evelation_m").alias("elevation"),
    )


def _parsed_times(spark, d):
    grabs = given.grabs(spark, d)
    text = F.date_format("collectDate", "yyyy-MM-dd HH:mm:ss")
    # one in three lacks its time of day and must not parse
    cut = F.when(F.second("collectDate") % 3 == 0, F.substring(text, 1, 10)).otherwise(text)
    return grabs.select(
        "collectDate", parse_timestamp(cut).cast("timestamp_ntz").alias("parsed")
    )


# --- spectra ----------------------------------------------------------------

def _e2_e3(spark, d):
    # of samples with DOC, as the other metrics; analyses are averaged to keep one row per wavelength
    return metrics.e2_e3(spectra.suva_spectrum(*_inputs(spark, d), doc_replicates="mean"))


def _fe_joined(spark, d):
    return iron.fe_join(_spectrum(spark, d), given.chem(spark, d))


def _spectrum_series(spark, d):
    return spectra.spectrum_series(
        _spectrum(spark, d), x_limits=(200, 400), y_limits=(0, 10)
    )


def _log_axes(spark, d):
    variation = _drivers(spark, d).select(
        F.log10("mean").alias("log_mean"), F.log10("var").alias("log_var")
    )
    return stats.linear_fit_band(variation, y="log_var", x="log_mean")


def _log_var_fit(spark, d):
    long = _driver_long(spark, d).withColumn("log_var", F.ln("var"))
    return stats.linear_fit_band(long, y="log_var", x="value", by=["variable"])


QUERIES: dict[str, Query] = {
    # sources and sinks
    "read_product": _read_product,
    "register_tables": _register_tables,
    "table_by_pattern": _table_by_pattern,
    "site_filter": lambda s, d: sources.site_filter(
        _metrics(s, d), ["N2", "N5"]).select("sampleID", "siteID", "SR"),
    "month_range_filter": lambda s, d: sources.month_range_filter(
        _metrics(s, d), "2023-11", "2024-01", "collectDate"),
    "read_sites": _read_sites,
    "read_csv_dir": _read_csv_dir,
    "write_table": _write_table,
    "read_sensor_product": _read_sensor_product,
    "read_ground_product": _read_ground_product,
    "site_doc_fdom": _site_doc_fdom,
    "write_metrics": _written(_metrics),
    "write_statistics": _written(lambda s, d: metrics.site_statistics(_metrics(s, d))),
    "write_corrected": _written(lambda s, d: metrics.corrected_metrics(
        *_inputs(s, d), with_raw=False)),
    # selections and scalar functions
    "analyte_slice": lambda s, d: spectra.analyte_slice(given.chem(s, d), "Fe"),
    "wavelength_at": lambda s, d: spectra.wavelength_at(_spectrum(s, d), 364, 366),
    "wavelength_band": lambda s, d: spectra.wavelength_band(
        _spectrum(s, d), *slopes.BAND_275),
    "drop_incomplete": lambda s, d: drop_incomplete(
        spectra.average_replicates(given.scan(s, d))),
    "label_type": lambda s, d: spectra.label_type(
        given.chem(s, d, "ground"), site_dates.GROUND),
    "aquatic_sites": lambda s, d: site_dates.aquatic_sites(given.sites(s, d)),
    "sensor_positions": lambda s, d: doc_fdom.sensor_positions(given.sensor(s, d)),
    "round_5min": _bucketed_times,
    "parse_number": _parsed,
    "parse_timestamp": _parsed_times,
    # spectra
    "average_replicates": lambda s, d: spectra.average_replicates(given.scan(s, d)),
    "functional_violations": lambda s, d: spectra.functional_violations(
        given.scan(s, d), spectra.SITE_DATE, ["sampleID"]),
    "suva_spectrum": _spectrum,
    "complete_spectra": lambda s, d: spectra.complete_spectra(_whole_spectrum(s, d)),
    "spectra_wide": lambda s, d: spectra.spectra_wide(_whole_spectrum(s, d)),
    "group_mean_on_rows": lambda s, d: spectra.group_mean_on_rows(_spectrum(s, d)),
    "spectrum_series": _spectrum_series,
    "log_spectrum_series": lambda s, d: spectra.spectrum_series(
        _spectrum(s, d), log=True),
    # sample metrics
    "e2_e3": _e2_e3,
    "spectral_slope": lambda s, d: slopes.spectral_slope(
        _spectrum(s, d), ["sampleID"], "275"),
    "slope_ratio": lambda s, d: slopes.slope_ratio(
        _spectrum(s, d), ["sampleID"], "SR"),
    "sample_metrics": _metrics,
    "site_statistics": lambda s, d: metrics.site_statistics(_metrics(s, d)),
    "fe_join": _fe_joined,
    "fe_corrected_spectrum": lambda s, d: iron.fe_corrected_spectrum(_fe_joined(s, d)),
    "corrected_metrics": lambda s, d: metrics.corrected_metrics(
        *_inputs(s, d), with_raw=False),
    "raw_vs_corrected": lambda s, d: metrics.corrected_metrics(*_inputs(s, d)),
    # sites and dates
    "slope_ratio_by_site_date": lambda s, d: _slopes(s, d, "surface"),
    "slope_ratio_by_site_date_ground": lambda s, d: _slopes(s, d, "ground"),
    "compare_water_types": _both_waters,
    "slope_ratio_complete": _complete_slopes,
    "sr_time_series": lambda s, d: site_dates.sr_time_series(
        _both_waters(s, d), ["siteID", "type"]),
    "site_variation": lambda s, d: site_dates.site_variation(_complete_slopes(s, d)),
    "overall_variation": lambda s, d: site_dates.overall_variation(
        _complete_slopes(s, d)),
    "site_vs_overall": lambda s, d: site_dates.site_vs_overall(
        drop_incomplete(_complete_slopes(s, d), ["Sr"])),
    "site_drivers": _drivers,
    "driver_long": _driver_long,
    "driver_fit": lambda s, d: stats.linear_fit(
        _driver_long(s, d), y="mean", x="value", by=["variable"]),
    "linear_fit_band": lambda s, d: stats.linear_fit_band(
        _driver_long(s, d), y="mean", x="value", by=["variable"]),
    "driver_log_variance_band": _log_var_fit,
    "variation_log_band": _log_axes,
    "box_stats": lambda s, d: stats.box_stats(
        _both_waters(s, d), "Sr", ["siteID", "type"]),
    "box_outliers": lambda s, d: stats.box_outliers(
        _both_waters(s, d).select("siteID", "collectDate", "type", "Sr"),
        "Sr", ["type"]),
    "density_curve": lambda s, d: stats.density_curve(
        _complete_slopes(s, d), "Sr", ["siteID"]),
    # laboratory DOC and sensor fDOM
    "doc_by_time": lambda s, d: doc_fdom.doc_by_time(given.grabs(s, d)),
    "fdom_5min": lambda s, d: doc_fdom.fdom_5min(given.sensor(s, d)),
    "pair_doc_fdom": _pairs,
    "linear_fit": lambda s, d: stats.linear_fit(_pairs(s, d), "DOC", "fDOM"),
    "doc_fdom_fit": lambda s, d: doc_fdom.doc_fdom_fit(_pairs(s, d)),
    "doc_fdom_fit_by_site": lambda s, d: doc_fdom.doc_fdom_fit(_pairs(s, d), ["siteID"]),
    "doc_fdom_band": lambda s, d: stats.linear_fit_band(_pairs(s, d), "DOC", "fDOM"),
}


def _with_rounding(name: str, query: Query) -> Query:
    return lambda spark, sf_dir: _rounded(query(spark, sf_dir), FEWER_DIGITS.get(name, DIGITS))


def entry(spark: SparkSession) -> DataFrame:
    """Per-sample metrics on the smallest test data."""
    return queries()["sample_metrics"](spark, SMOKE_DIR)


def queries() -> dict[str, Query]:
    found = {name: _with_rounding(name, query) for name, query in QUERIES.items()}
    if llm_queries:
        found |= llm_queries.QUERIES | {"pipeline": corpus_pipeline.run}
    return found


def oracle_sql() -> dict[str, str]:
    found = oracle_queries.rounded(FEWER_DIGITS, DIGITS, FLOOR)
    if llm_queries:
        found |= llm_queries.ORACLE_SQL
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found

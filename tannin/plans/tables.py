"""Domain tables derived from the star-schema test tables.

The test data holds no spectra, so the registered queries see these
projections of it.  None of them joins or aggregates: like a real scan table,
each source row is already one measurement with its sample's attributes.

They are as unclean as real ones: some samples were not scanned at 254 nm, some
absorbances are missing or zero, some DOC analyses are repeated, missing or
zero, and a sensor now and then reports an infinite value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _is_type(key: str, water: str | None) -> str:
    """A third of the samples are ground water, the rest surface water."""
    return {None: "true", "ground": f"{key} % 3 = 0", "surface": f"{key} % 3 <> 0"}[water]


def scan(spark: SparkSession, sf_dir: str, water: str | None = None) -> DataFrame:
    """Absorbance readings: one sample per supplier, 101 wavelengths."""
    lines = table(spark, sf_dir, "lineitem").where(_is_type("l_suppkey", water)).where(
        "not (l_suppkey % 17 = 5 and l_partkey % 101 = 27)"  # 254 nm
    )
    return lines.selectExpr(
        "concat('S', l_suppkey) as sampleID",
        "concat('D', l_suppkey % 5) as domainID",
        "concat('N', l_suppkey % 10) as siteID",
        """cast(date_add(date '2023-10-01', cast((l_suppkey div 20) * 9 % 820 as int))
                as timestamp_ntz) as collectDate""",
        "200 + 2 * (l_partkey % 101) as wavelength",
        "if(l_linenumber % 2 = 0, 'A', 'B') as replicate",
        """case when l_suppkey % 23 = 7 and l_partkey % 101 = 38 then 0d
                when l_orderkey % 997 <> 0
                then exp(-0.015d * (2 * (l_partkey % 101))) * (0.5d + l_quantity / 100)
           end as decadicAbsorbance""",
    )


def chem(spark: SparkSession, sf_dir: str, water: str | None = None) -> DataFrame:
    """Analyses per supplier: DOC for ten in eleven, iron for six in seven, some DOC twice."""
    suppliers = table(spark, sf_dir, "supplier").where(_is_type("s_suppkey", water))
    return suppliers.selectExpr(
        "concat('S', s_suppkey) as sampleID",
        """inline(array(
            struct('DOC' as analyte,
                   if(s_suppkey % 47 = 6, 0d, 1d + abs(s_acctbal) / 1000) as analyteConcentration,
                   s_suppkey % 11 <> 3 as present),
            struct('DOC' as analyte,
                   if(s_suppkey % 2 = 0, null, 1.25d + abs(s_acctbal) / 1000) as analyteConcentration,
                   s_suppkey % 13 = 4 as present),
            struct('Fe' as analyte, s_suppkey % 13 / 50d as analyteConcentration,
                   s_suppkey % 7 <> 0 as present)))""",
    ).where("present").drop("present")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site metadata: one site per nation, numbers partly as text."""
    return table(spark, sf_dir, "nation").selectExpr(
        "concat('N', n_nationkey) as site_id",
        """case n_nationkey % 3 when 0 then 'Core Aquatic' when 1 then 'Gradient Aquatic'
                else 'Core Terrestrial' end as site_type""",
        "if(n_nationkey % 2 = 0, 'Lake', 'Wadeable Stream') as site_subtype",
        "20d + n_nationkey * n_nationkey % 23 as latitude",
        "-70d - n_nationkey * 7 % 19 as longitude",
        """if(n_nationkey % 9 = 4, 'unknown', string(100 + n_nationkey * 10))
           as mean_evelation_m""",
        "string(n_nationkey * 25 % 311) as mean_annual_precipitation_mm",
        "concat(n_nationkey * 5 % 17, '.5C/70F') as mean_annual_temperature_C",
        "concat('class', n_nationkey % 4) as dominant_nlcd_classes",
        "1d + n_nationkey * 3 % 29 as watershed_size_km2",
        "if(n_nationkey % 2 = 0, 0.5d + n_nationkey / 4d, null) as lake_depth_mean_m",
        """if(n_nationkey % 2 = 0, 1d + n_nationkey * n_nationkey / 10d, null)
           as lake_depth_max_m""",
    )


def grabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laboratory DOC at a collection time: purchase events."""
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").selectExpr(
        "ts as collectDate", "concat('N', user_id % 10) as siteID",
        "concat('D', user_id % 10 % 5) as domainID", "'DOC' as analyte",
        "1d + value / 10 as analyteConcentration",
    )


def sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor readings: all other events; one in fifty lacks its value."""
    return table(spark, sf_dir, "events").where("event_type <> 'purchase'").selectExpr(
        "ts as startDateTime", "concat('N', user_id % 10) as siteID",
        """case event_id % 4 when 0 then '102' when 1 then '112' when 2 then '103'
                else '101' end as horizontalPosition""",
        """case when event_id % 499 = 7 then double('Infinity')
                when event_id % 50 <> 0 then value end as rawCalibratedfDOM""",
    )

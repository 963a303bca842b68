"""SQL counterparts of the registered queries, for an independent engine.

Written from the definitions, step by step with plain joins, and not from the
Spark plans: where Spark uses one conditional aggregate, this uses outer joins.
"""

from __future__ import annotations

# --- domain tables over the test tables -------------------------------------


def _scan(where: str) -> str:
    return f"""
    select 'S' || l_suppkey as "sampleID", 'D' || (l_suppkey % 5) as "domainID",
           'N' || (l_suppkey % 10) as "siteID",
           cast(date '2023-10-01' + cast((l_suppkey // 20) * 9 % 820 as integer)
                as timestamp) as "collectDate",
           200 + 2 * (l_partkey % 101) as wavelength,
           case when l_linenumber % 2 = 0 then 'A' else 'B' end as replicate,
           case when l_suppkey % 23 = 7 and l_partkey % 101 = 38 then 0e0
                when l_orderkey % 997 <> 0
                then exp(-0.015e0 * (2 * (l_partkey % 101)))
                     * (0.5e0 + l_quantity / 100e0) end as "decadicAbsorbance"
    from lineitem where {where.format(key='l_suppkey')}
      and not (l_suppkey % 17 = 5 and l_partkey % 101 = 27)"""


def _chem(where: str) -> str:
    return f"""
    select 'S' || s_suppkey as "sampleID", 'DOC' as analyte,
           case when s_suppkey % 47 = 6 then 0e0 else 1e0 + abs(s_acctbal) / 1000e0 end
               as "analyteConcentration"
    from supplier where s_suppkey % 11 <> 3 and {where.format(key='s_suppkey')}
    union all
    select 'S' || s_suppkey, 'DOC',
           case when s_suppkey % 2 <> 0 then 1.25e0 + abs(s_acctbal) / 1000e0 end
    from supplier where s_suppkey % 13 = 4 and {where.format(key='s_suppkey')}
    union all
    select 'S' || s_suppkey, 'Fe', (s_suppkey % 13) / 50e0
    from supplier where s_suppkey % 7 <> 0 and {where.format(key='s_suppkey')}"""


_WATER = {"": "true", "surface_": "{key} % 3 <> 0", "ground_": "{key} % 3 = 0"}

_SITES = """
    select 'N' || n_nationkey as site_id,
           case n_nationkey % 3 when 0 then 'Core Aquatic'
                when 1 then 'Gradient Aquatic' else 'Core Terrestrial' end as site_type,
           case n_nationkey % 2 when 0 then 'Lake' else 'Wadeable Stream' end
               as site_subtype,
           20e0 + n_nationkey * n_nationkey % 23 as latitude,
           -70e0 - n_nationkey * 7 % 19 as longitude,
           case when n_nationkey % 9 = 4 then 'unknown'
                else cast(100 + n_nationkey * 10 as varchar) end as mean_evelation_m,
           cast(n_nationkey * 25 % 311 as varchar) as mean_annual_precipitation_mm,
           cast(n_nationkey * 5 % 17 as varchar) || '.5C/70F'
               as "mean_annual_temperature_C",
           'class' || (n_nationkey % 4) as dominant_nlcd_classes,
           1e0 + n_nationkey * 3 % 29 as watershed_size_km2,
           case when n_nationkey % 2 = 0 then 0.5e0 + n_nationkey / 4e0 end
               as lake_depth_mean_m,
           case when n_nationkey % 2 = 0 then 1e0 + n_nationkey * n_nationkey / 10e0 end
               as lake_depth_max_m
    from nation"""

_GRABS = """
    select ts as "collectDate", 'N' || (user_id % 10) as "siteID",
           'D' || (user_id % 10 % 5) as "domainID", 'DOC' as analyte,
           1e0 + value / 10e0 as "analyteConcentration"
    from events where event_type = 'purchase'"""

_SENSOR = """
    select ts as "startDateTime", 'N' || (user_id % 10) as "siteID",
           case event_id % 4 when 0 then '102' when 1 then '112' when 2 then '103'
                else '101' end as "horizontalPosition",
           case when event_id % 499 = 7 then 'inf'::double
                when event_id % 50 <> 0 then value end as "rawCalibratedfDOM"
    from events where event_type <> 'purchase'"""

# --- derived steps, one set per water type ----------------------------------

_GOOD = "{v} is not null and not isnan({v})"


def _steps(p: str) -> dict[str, str]:
    """Named subqueries; ``p`` is the prefix of the water type."""
    return {
        f"{p}scan": _scan(_WATER[p]),
        f"{p}chem": _chem(_WATER[p]),
        f"{p}averaged": f"""
            select "sampleID", "domainID", "siteID", "collectDate", wavelength,
                   case when count("decadicAbsorbance") = count(*)
                        then avg("decadicAbsorbance") end as absorbance
            from {p}scan group by all""",
        f"{p}doc": f"""
            select "sampleID", "analyteConcentration" as "DOC"
            from {p}chem where analyte = 'DOC'""",
        f"{p}iron": f"""
            select "sampleID", "analyteConcentration" as "Fe"
            from {p}chem where analyte = 'Fe'""",
        f"{p}whole_spectrum": f"""
            select a.*, "DOC", absorbance / "DOC" * 100 as "SUVA"
            from {p}averaged a join {p}doc using ("sampleID")""",
        f"{p}spectrum": f"""
            select * from {p}whole_spectrum where "SUVA" is not null and not isnan("SUVA")""",
    }


def _line(keys: str, source: str, band: str, value: str = '"SUVA"') -> str:
    low, high = {"275": (275, 295), "350": (350, 400)}[band]
    y = f"case when {value} > 0 and {value} < 'inf'::double then ln({value}) end"
    return f"""
        select {keys},
               case when regr_count({y}, wavelength) > 1
                    then regr_intercept({y}, wavelength)
                    else avg({y}) end as intercept{band},
               case when regr_count({y}, wavelength) > 1
                    then -regr_slope({y}, wavelength) end as slope{band}
        from {source} where wavelength >= {low} and wavelength <= {high}
        group by {keys}"""


def _ratio(keys: str, source: str, name: str = '"Sr"', value: str = '"SUVA"') -> str:
    return f"""
        select {keys}, intercept275, slope275, intercept350, slope350,
               slope275 / slope350 as {name}
        from ({_line(keys, source, '275', value)}) x
        join ({_line(keys, source, '350', value)}) y using ({keys})"""


_SITE_DATE = '"siteID", "collectDate"'

def _corrected(source: str) -> str:
    return f"""
        select *, (absorbance - 0.0570e0 * "Fe") as "correctedAbsorbance",
               (absorbance - 0.0570e0 * "Fe") / "DOC" * 100 as "correctedSUVA"
        from {source} where wavelength between 275 and 295
        union all
        select *, (absorbance - 0.0118e0 * "Fe"),
               (absorbance - 0.0118e0 * "Fe") / "DOC" * 100
        from {source} where wavelength between 350 and 400"""


_IRON_STEPS = {
    "spectrum_with_iron": """
        select s.*, i."Fe" from spectrum s join iron i using ("sampleID")
        where i."Fe" is not null""",
}

_METRIC_STEPS = {
    "lab": """
        select "sampleID",
               avg("analyteConcentration") filter (where analyte = 'DOC') as "DOC",
               avg("analyteConcentration") filter (where analyte = 'Fe') as "Fe"
        from chem group by "sampleID" """,
    "sampled": """
        select a.*, "DOC", "Fe", absorbance / "DOC" * 100 as "SUVA"
        from averaged a join lab using ("sampleID")
        where absorbance is not null and "DOC" is not null
          and not isnan(absorbance / "DOC")""",
    "at254": """select "sampleID", "domainID", "siteID", "collectDate", "DOC",
                       "SUVA" as "SUVA254" from sampled where wavelength = 254""",
    "at350": """select "sampleID", "SUVA" as "SUVA350" from sampled
                where wavelength = 350""",
    "at250": """select "sampleID", absorbance as abs250 from sampled
                where wavelength = 250""",
    "at365": """select "sampleID", avg(absorbance) as abs365 from sampled
                where wavelength in (364, 366) group by "sampleID" """,
    "e2e3": """select "sampleID", abs250 / abs365 as "E2E3"
               from at250 full join at365 using ("sampleID")""",
    "sr": _ratio('"sampleID"', "sampled", '"SR"'),
    "metrics": """
        select "sampleID", "domainID", "siteID", "collectDate", "DOC", "SUVA254",
               "SUVA350", "E2E3", "SR"
        from at254 full join at350 using ("sampleID")
             full join e2e3 using ("sampleID")
             full join (select "sampleID", "SR" from sr) s using ("sampleID")""",
    "with_iron": """
        select * from sampled where "Fe" is not null""",
    "corrected_bands": _corrected("with_iron"),
    "corrected_sr": _ratio('"sampleID"', "corrected_bands", '"correctedSR"',
                           '"correctedSUVA"'),
    "corrected": """
        select "sampleID", "Fe", "correctedSUVA254", "correctedSUVA350", "correctedSR"
        from (select "sampleID", "Fe", (absorbance - 0.0653e0 * "Fe") / "DOC" * 100
                     as "correctedSUVA254" from with_iron where wavelength = 254) a
        full join (select "sampleID", (absorbance - 0.0323e0 * "Fe") / "DOC" * 100
                     as "correctedSUVA350" from with_iron where wavelength = 350) b
             using ("sampleID")
        full join (select "sampleID", "correctedSR" from corrected_sr) c
             using ("sampleID")""",
}


def _slopes(p: str) -> dict[str, str]:
    return {f"{p}slopes": _ratio(_SITE_DATE, f"{p}spectrum")}


_COMPLETE_STEPS = {
    "means": f"""select {_SITE_DATE}, wavelength,
                        avg("SUVA") filter (where not isnan("SUVA")) as "SUVA"
                 from whole_spectrum group by all""",
    "gaps": f"""select distinct {_SITE_DATE} from
                (select distinct {_SITE_DATE} from means) g
                cross join (select distinct wavelength from means) w
                left join means m using ({_SITE_DATE}, wavelength)
                where m."SUVA" is null""",
    "complete": f"""select means.* from means anti join gaps using ({_SITE_DATE})""",
    "complete_slopes": _ratio(_SITE_DATE, "complete"),
    "sites": _SITES,
    "variation": """
        select "siteID", case when count("Sr") = count(*) then var_samp("Sr") end as var,
               case when count("Sr") = count(*) then avg("Sr") end as mean
        from complete_slopes group by "siteID" """,
    "known_slopes": """select * from complete_slopes where "Sr" is not null""",
    "known_variation": """select "siteID", var_samp("Sr") as var, avg("Sr") as mean
                          from known_slopes group by "siteID" """,
    "drivers": """select v.*, s.* exclude (site_id)
                  from variation v join sites s on v."siteID" = s.site_id
                  where site_type in ('Core Aquatic', 'Gradient Aquatic')""",
    "numeric_drivers": r"""
        select "siteID", site_subtype, var, mean, dominant_nlcd_classes, latitude,
               longitude, try_cast(mean_evelation_m as double) as mean_evelation_m,
               try_cast(mean_annual_precipitation_mm as double)
                   as mean_annual_precipitation_mm,
               cast(regexp_extract("mean_annual_temperature_C", '-?[0-9]+[.][0-9]+')
                    as double) as "mean_annual_temperature_C",
               ln(watershed_size_km2) as watershed_size_km2, lake_depth_mean_m,
               lake_depth_max_m
        from drivers""",
    "driver_rows": " union all ".join(
        'select "siteID", site_subtype, var, mean, dominant_nlcd_classes, '
        f"'{name}' as variable, \"{name}\" as value from numeric_drivers"
        for name in (
            "latitude", "longitude", "mean_evelation_m",
            "mean_annual_precipitation_mm", "mean_annual_temperature_C",
            "watershed_size_km2", "lake_depth_mean_m", "lake_depth_max_m",
        )
    ),
}

_BUCKET = "time_bucket(interval '5 minutes', {ts} + interval '150 seconds')"

_PAIR_STEPS = {
    "grabs": _GRABS,
    "sensor": _SENSOR,
    "grab_times": f"""
        select {_BUCKET.format(ts='"collectDate"')} as "collectDate", "siteID",
               "domainID", "DOC"
        from (select "collectDate", "siteID", "domainID",
                     avg("analyteConcentration") as "DOC" from grabs group by all) g""",
    "buckets": f"""
        select {_BUCKET.format(ts='"startDateTime"')} as "startDateTime", "siteID",
               case when count(*) = count("rawCalibratedfDOM")
                    then avg("rawCalibratedfDOM") end as "fDOM"
        from sensor where "horizontalPosition" in ('102', '112', '103')
        group by 1, 2""",
    "pairs": """
        select g."collectDate", g."domainID", g."siteID", g."DOC", b."fDOM"
        from grab_times g left join buckets b
          on g."collectDate" = b."startDateTime" and g."siteID" = b."siteID" """,
}

# --- fitted lines -----------------------------------------------------------

# Central probability of the t distribution by Simpson's rule with 4000 panels.
_CENTRAL = """
    (2 * ({t}) / 12000e0
     * exp(lgamma(({df} + 1) / 2e0) - lgamma({df} / 2e0)) / sqrt({df} * pi())
     * list_sum(list_transform(range(0, 4001), lambda i:
         (case when i in (0, 4000) then 1e0 when i % 2 = 1 then 4e0 else 2e0 end)
         * pow(1 + pow(({t}) * i / 4000e0, 2) / {df}, -({df} + 1) / 2e0))))"""


def _central(t: str, df: str) -> str:
    return _CENTRAL.format(t=t, df=df)


def _fit_steps(source: str, y: str, x: str, by: str = "") -> dict[str, str]:
    """Moments and test statistics of the line of y on x, per group."""
    keys, group = (f"{by}, ", f"group by {by}") if by else ("", "")
    return {
        "line": f"""
            select {keys} count(*) as n,
                   case when regr_sxx(yy, xx) > 0 then regr_slope(yy, xx) end as slope,
                   case when regr_sxx(yy, xx) > 0 then regr_intercept(yy, xx)
                        else avg(yy) end as intercept,
                   case when count(*) > 0 then count(*)
                        - case when regr_sxx(yy, xx) > 0 then 2 else 1 end end as df,
                   avg(xx) as mean_x, min(xx) as min_x, max(xx) as max_x,
                   regr_sxx(yy, xx) as sxx, regr_syy(yy, xx) as syy,
                   regr_sxy(yy, xx) as sxy
            from (select *, {y} as yy, {x} as xx from {source}
                  where isfinite({y}) and isfinite({x})) {group}""",
        "infinite": f"""
            select {keys} count(*) filter (where isinf({y}) or isinf({x})) as nonfinite
            from {source} where not isnan({y}) and not isnan({x}) {group}""",
        "spread": """
            select *, case when df > 0 then sqrt(rss / df) end as sigma
            from (select *, greatest(syy - case when sxx > 0 then sxy * sxy / sxx
                                                else 0 end, 0) as rss from line) l""",
        "errors": """

            select *, case when sxx > 0 then sigma / sqrt(sxx) end as se_slope,
                   sigma * sqrt(1e0 / n + case when sxx > 0
                       then mean_x * mean_x / sxx else 0 end) as se_intercept,
                   case when syy > 0 then 1 - rss / syy end as r_squared from spread""",
        "fit": f"""
            select {keys} n, coalesce(nonfinite, 0) as nonfinite, df, intercept, slope,
                   se_intercept,
                   se_slope, intercept / se_intercept as t_intercept,
                   slope / se_slope as t_slope,
                   1 - {_central('abs(intercept / se_intercept)', 'df')} as p_intercept,
                   1 - {_central('abs(slope / se_slope)', 'df')} as p_slope, sigma,
                   r_squared, case when df > 0
                       then 1 - (1 - r_squared) * (n - 1) / df end as adj_r_squared,
                   slope / se_slope * slope / se_slope as f_statistic
            from errors {f'left join infinite using ({by})' if by else 'cross join infinite'}""",
    }


def _band(source: str, y: str, x: str, by: str = "") -> tuple[dict[str, str], str]:
    """Confidence band on 80 points, the t quantile found by bisection."""
    keys = f"{by}, " if by else ""
    steps = _fit_steps(source, y, x, by)
    del steps["errors"], steps["fit"], steps["infinite"]
    steps["bisect(df, lo, hi, k)"] = f"""
        select distinct df, 0e0, 64e0, 0 from spread where df > 0
        union all
        select df, case when p < 0.95e0 then (lo + hi) / 2 else lo end,
               case when p < 0.95e0 then hi else (lo + hi) / 2 end, k + 1
        from (select *, {_central('(lo + hi) / 2', 'df')} as p from bisect) b
        where k < 55"""
    steps["grid"] = """
        select s.*, b.lo as t, cast(i as integer) as i,
               min_x + i * (max_x - min_x) / 79e0 as at_x
        from spread s left join bisect b on s.df = b.df and b.k = 55
        cross join range(80) r(i) where slope is not null"""
    return steps, f"""
        select {keys} i, at_x as x, intercept + slope * at_x as fitted,
               intercept + slope * at_x
                 - t * sigma * sqrt(1e0 / n + pow(at_x - mean_x, 2) / sxx) as lower,
               intercept + slope * at_x
                 + t * sigma * sqrt(1e0 / n + pow(at_x - mean_x, 2) / sxx) as upper
        from grid"""


# --- the queries ------------------------------------------------------------

_S = _steps("")
_M = {**_S, **_METRIC_STEPS}
_C = {**_S, **_COMPLETE_STEPS}
_BOTH = {
    **_steps("surface_"), **_slopes("surface_"),
    **_steps("ground_"), **_slopes("ground_"),
    "waters": """select *, 'Surface Water' as type from surface_slopes
               union all select *, 'Groundwater' as type from ground_slopes""",
}


def _box(by: str) -> str:
    return f"""
        select {by}, count(*) as n, quantile_cont("Sr", 0.25) as q1,
               quantile_cont("Sr", 0.5) as q2, quantile_cont("Sr", 0.75) as q3
        from waters where "Sr" is not null group by {by}"""


_SPECTRUM_DOUBLES = "absorbance DOC SUVA"
_METRIC_DOUBLES = "DOC SUVA254 SUVA350 E2E3 SR"
_CORRECTED_DOUBLES = "Fe correctedSUVA254 correctedSUVA350 correctedSR"
_SLOPE_DOUBLES = "intercept275 slope275 intercept350 slope350 Sr"
_BAND_DOUBLES = "x fitted lower upper"
_FIT_DOUBLES = (
    "intercept slope se_intercept se_slope t_intercept t_slope p_intercept p_slope "
    "sigma r_squared adj_r_squared f_statistic"
)
_SITE_DOUBLES = (
    "latitude longitude watershed_size_km2 lake_depth_mean_m lake_depth_max_m"
)

_STATISTIC_DOUBLES = " ".join(f"mean{c} sd{c}" for c in ("DOC", "SUVA254", "SUVA350", "SR"))
_STATISTICS = """
    select "siteID", count(*) as "nSamples", """ + ", ".join(
    f'case when count("{c}") = count(*) then avg("{c}") end as "mean{c}", '
    f'case when count("{c}") = count(*) then stddev_samp("{c}") end as "sd{c}"'
    for c in ("DOC", "SUVA254", "SUVA350", "SR")
) + ' from metrics group by "siteID"'

# name -> (subqueries, final select, columns of type double)
_QUERIES: dict[str, tuple[dict[str, str], str, str]] = {
    "read_product": (_S, """
        select "sampleID", "siteID", count(*) as readings,
               cast(max(wavelength) as double) as top
        from scan where "siteID" in ('N1', 'N4') and wavelength % 5 <> 0
          and "collectDate" >= timestamp '2023-10-01'
          and "collectDate" < timestamp '2023-12-01'
        group by "sampleID", "siteID" """, "top"),
    "register_tables": (_S, """
        select "siteID", analyte, count(*) as readings
        from scan join chem using ("sampleID") group by all""", ""),
    "table_by_pattern": (_S, "select * from chem", "analyteConcentration"),
    "site_filter": (_M, """select "sampleID", "siteID", "SR" from metrics
                           where "siteID" in ('N2', 'N5')""", "SR"),
    "month_range_filter": (_M, """
        select * from metrics where date_trunc('month', "collectDate")
            between timestamp '2023-11-01' and timestamp '2024-01-01'""",
        _METRIC_DOUBLES),
    "read_sites": ({"sites": _SITES}, "select * from sites", _SITE_DOUBLES),
    "read_csv_dir": (
        {**_steps("surface_"), **_steps("ground_")}, """
        select "siteID", "collectDate", cast(wavelength as double) as wavelength,
               absorbance, "DOC", "SUVA" from surface_spectrum
        union all
        select "siteID", "collectDate", cast(wavelength as double),
               absorbance, "DOC", "SUVA" from ground_spectrum""",
        "wavelength " + _SPECTRUM_DOUBLES),
    "write_table": (_PAIR_STEPS, "select * from pairs", "DOC fDOM"),
    "analyte_slice": (_S, "select * from iron", "Fe"),
    "wavelength_at": (_S, "select * from spectrum where wavelength in (364, 366)",
                      _SPECTRUM_DOUBLES),
    "wavelength_band": (_S, """select * from spectrum
                               where wavelength between 275 and 295""",
                        _SPECTRUM_DOUBLES),
    "drop_incomplete": (_S, "select * from averaged where absorbance is not null",
                        "absorbance"),
    "label_type": (_steps("ground_"), "select *, 'Groundwater' as type from ground_chem",
                   "analyteConcentration"),
    "aquatic_sites": ({"sites": _SITES}, """
        select * from sites where site_type <> 'Core Terrestrial'""", _SITE_DOUBLES),
    "sensor_positions": (_PAIR_STEPS, """
        select * from sensor where "horizontalPosition" <> '101'""",
        "rawCalibratedfDOM"),
    "round_5min": (_PAIR_STEPS, f"""
        select "collectDate", {_BUCKET.format(ts='"collectDate"')} as bucket
        from grabs""", ""),
    "parse_number": (_C, r"""
        select site_id,
               cast(regexp_extract("mean_annual_temperature_C", '^[0-9]+[.]5')
                    as double) as temperature,
               try_cast(mean_evelation_m as double) as elevation from sites""",
        "temperature elevation"),
    "parse_timestamp": (_PAIR_STEPS, """
        select "collectDate", case when cast(second("collectDate") as integer) % 3 <> 0
                 then date_trunc('second', "collectDate") end as parsed
        from grabs""", ""),
    "average_replicates": (_S, "select * from averaged", "absorbance"),
    "functional_violations": (_S, f"""
        select {_SITE_DATE} from scan group by {_SITE_DATE}
        having count(distinct "sampleID") > 1""", ""),
    "suva_spectrum": (_S, "select * from spectrum", _SPECTRUM_DOUBLES),
    "complete_spectra": (_C, "select * from complete", "SUVA"),
    "spectra_wide": (_C, f"""
        select {_SITE_DATE}, """ + ", ".join(
            f"""max("SUVA") filter (where wavelength = {w}) as "{w}" """
            for w in range(200, 401, 2)
        ) + f"from means group by {_SITE_DATE}", " ".join(map(str, range(200, 401, 2)))),
    "group_mean_on_rows": (_S, """
        select * replace (avg("SUVA") over
            (partition by "siteID", "collectDate", wavelength) as "SUVA")
        from spectrum""", _SPECTRUM_DOUBLES),
    "spectrum_series": (_S, """
        select "siteID", "sampleID", wavelength, "SUVA" from spectrum
        where "SUVA" between 0 and 10 and wavelength between 200 and 400""", "SUVA"),
    "log_spectrum_series": (_S, """
        select "siteID", "sampleID", wavelength, ln("SUVA") as "SUVA"
        from spectrum""", "SUVA"),
    "e2_e3": (_M, """select "sampleID", "E2E3" from e2e3""", "E2E3"),
    "spectral_slope": (_S, f"""
        select * from ({_line('"sampleID"', 'spectrum', '275')}) x
        join (select "sampleID", count(*) filter (where "SUVA" in (0, 'inf'::double)) as nonfinite275
              from spectrum where wavelength between 275 and 295 group by "sampleID") y
        using ("sampleID")""", "intercept275 slope275"),
    "slope_ratio": (_S, _ratio('"sampleID"', "spectrum", '"SR"'),
                    _SLOPE_DOUBLES.replace("Sr", "SR")),
    "sample_metrics": (_M, "select * from metrics", _METRIC_DOUBLES),
    "site_statistics": (_M, _STATISTICS, _STATISTIC_DOUBLES),
    "fe_join": ({**_S, **_IRON_STEPS}, "select * from spectrum_with_iron",
                _SPECTRUM_DOUBLES + " Fe"),
    "fe_corrected_spectrum": ({**_S, **_IRON_STEPS}, _corrected("spectrum_with_iron"),
                              _SPECTRUM_DOUBLES + " Fe correctedAbsorbance correctedSUVA"),
    "corrected_metrics": (_M, "select * from corrected", _CORRECTED_DOUBLES),
    "raw_vs_corrected": (_M, """
        select m.* rename ("SUVA254" as "rawSUVA254", "SUVA350" as "rawSUVA350",
                           "SR" as "rawSR"),
               c.* exclude ("sampleID")
        from metrics m left join corrected c using ("sampleID")""",
        "DOC rawSUVA254 rawSUVA350 E2E3 rawSR " + _CORRECTED_DOUBLES),
    "slope_ratio_by_site_date": (_BOTH, "select * from surface_slopes", _SLOPE_DOUBLES),
    "slope_ratio_by_site_date_ground": (_BOTH, "select * from ground_slopes",
                                        _SLOPE_DOUBLES),
    "compare_water_types": (_BOTH, "select * from waters", _SLOPE_DOUBLES),
    "slope_ratio_complete": (_C, "select * from complete_slopes", _SLOPE_DOUBLES),
    "sr_time_series": (_BOTH, 'select "siteID", type, "collectDate", "Sr" from waters',
                       "Sr"),
    "site_variation": (_C, "select * from variation", "var mean"),
    "overall_variation": (_C, """
        select case when count("Sr") = count(*) then var_samp("Sr") end as overall_var,
               case when count("Sr") = count(*) then avg("Sr") end as overall_mean
        from complete_slopes""", "overall_var overall_mean"),
    "site_vs_overall": (_C, """
        select *, (select var_samp("Sr") from known_slopes) as overall_var,
               (select avg("Sr") from known_slopes) as overall_mean
        from known_variation""", "var mean overall_var overall_mean"),
    "site_drivers": (_C, "select * from drivers", "var mean " + _SITE_DOUBLES),
    "driver_long": (_C, "select * from driver_rows", "var mean value"),
    "driver_fit": ({**_C, **_fit_steps("driver_rows", "mean", "value", "variable")},
                   "select * from fit", _FIT_DOUBLES),
    "box_stats": ({**_BOTH, "quartiles": _box('"siteID", type')}, """
        select q."siteID", q.type, q.n,
               least(q1, min("Sr") filter (where "Sr" between q1 - 1.5 * (q3 - q1)
                                           and q3 + 1.5 * (q3 - q1))) as ymin,
               q1 as lower, q2 as middle, q3 as upper,
               greatest(q3, max("Sr") filter (where "Sr" between q1 - 1.5 * (q3 - q1)
                                              and q3 + 1.5 * (q3 - q1))) as ymax,
               count(*) filter (where not ("Sr" between q1 - 1.5 * (q3 - q1)
                                           and q3 + 1.5 * (q3 - q1))) as outliers
        from waters b join quartiles q on b."siteID" = q."siteID" and b.type = q.type
        where "Sr" is not null group by q."siteID", q.type, q.n, q1, q2, q3""",
        "ymin lower middle upper ymax"),
    "box_outliers": ({**_BOTH, "quartiles": _box("type")}, """
        select "siteID", "collectDate", type, "Sr" from waters join quartiles using (type)
        where "Sr" < q1 - 1.5 * (q3 - q1) or "Sr" > q3 + 1.5 * (q3 - q1)""", "Sr"),
    "density_curve": ({
        **_C,
        "spreads": """
            select "siteID", count(*) as n, min("Sr") as one, stddev_samp("Sr") as sd,
                   (quantile_cont("Sr", 0.75) - quantile_cont("Sr", 0.25)) / 1.34e0
                       as robust
            from known_slopes group by "siteID" having count(*) > 1""",
        "widths": """
            select *, 0.9e0 * pow(n, -0.2e0) *
                case when least(sd, robust) > 0 then least(sd, robust)
                     when sd > 0 then sd when one <> 0 then abs(one) else 1e0 end as bw
            from spreads""",
        "span": """select min("Sr") as lo, (max("Sr") - min("Sr")) / 511e0 as step
                   from known_slopes""",
        # each value weighs on the two grid points beside it
        "places": """
            select "siteID", case when step > 0 then least(("Sr" - lo) / step, 511e0) else 0e0 end
                   as place from known_slopes cross join span""",
        "weights": """
            select "siteID", k, sum(weight) as weight
            from (select "siteID", floor(place) as k, 1 - (place - floor(place)) as weight from places
                  union all
                  select "siteID", floor(place) + 1, place - floor(place) from places)
            where weight > 0 group by "siteID", k"""}, """
        select "siteID", cast(i as integer) as i, lo + i * step as x,
               sum(weight * exp(-pow((i - k) * step / bw, 2) / 2)) / (n * bw * sqrt(2 * pi()))
                   as density
        from widths join weights using ("siteID") cross join span cross join range(512) r(i)
        group by "siteID", i, lo, step, n, bw""", "x density"),
    "doc_by_time": (_PAIR_STEPS, "select * from grab_times", "DOC"),
    "fdom_5min": (_PAIR_STEPS, "select * from buckets", "fDOM"),
    "pair_doc_fdom": (_PAIR_STEPS, "select * from pairs", "DOC fDOM"),
    "linear_fit": ({**_PAIR_STEPS, **_fit_steps("pairs", '"DOC"', '"fDOM"')},
                   "select * from fit", _FIT_DOUBLES),
    "doc_fdom_fit": ({
        **_PAIR_STEPS, **_fit_steps("pairs", '"DOC"', '"fDOM"'),
        "residuals": """select "DOC" - intercept - slope * "fDOM" as r
                        from pairs cross join line where isfinite("fDOM")"""}, """
        select fit.*, f.* from fit cross join (
            select min(r) as residual_min, quantile_cont(r, 0.25) as residual_q1,
                   median(r) as residual_median, quantile_cont(r, 0.75) as residual_q3,
                   max(r) as residual_max from residuals) f""",
        _FIT_DOUBLES + " residual_min residual_q1 residual_median residual_q3"
        " residual_max"),
    "doc_fdom_fit_by_site": ({
        **_PAIR_STEPS, **_fit_steps("pairs", '"DOC"', '"fDOM"', '"siteID"'),
        "residuals": """select "siteID", "DOC" - intercept - slope * "fDOM" as r
                        from pairs join line using ("siteID") where isfinite("fDOM")"""}, """
        select fit.*, f.* exclude ("siteID") from fit join (
            select "siteID", min(r) as residual_min, quantile_cont(r, 0.25) as residual_q1,
                   median(r) as residual_median, quantile_cont(r, 0.75) as residual_q3,
                   max(r) as residual_max from residuals group by "siteID") f using ("siteID")""",
        _FIT_DOUBLES + " residual_min residual_q1 residual_median residual_q3"
        " residual_max"),
    "read_sensor_product": (_PAIR_STEPS, """
        select "siteID", "horizontalPosition", count(*) as readings,
               count("rawCalibratedfDOM") as known, max("rawCalibratedfDOM") as top
        from sensor where "siteID" in ('N2', 'N7') and "horizontalPosition" <> '112'
        group by "siteID", "horizontalPosition" """, "top"),
    "read_ground_product": (_steps("ground_"), """
        select * from ground_spectrum where "siteID" = 'N3'""", _SPECTRUM_DOUBLES),
    "site_doc_fdom": (_PAIR_STEPS, """
        select * from pairs where "siteID" = 'N4'""", "DOC fDOM"),
    "write_metrics": (_M, "select * from metrics", _METRIC_DOUBLES),
    "write_statistics": (_M, _STATISTICS, _STATISTIC_DOUBLES),
    "write_corrected": (_M, "select * from corrected", _CORRECTED_DOUBLES),
}


def _add_band(name: str, before: dict[str, str], source: str, y: str, x: str,
              by: str = "") -> None:
    steps, final = _band(source, y, x, by)
    _QUERIES[name] = ({**before, **steps}, final, _BAND_DOUBLES)


_add_band("linear_fit_band", _C, "driver_rows", "mean", "value", "variable")
_add_band("driver_log_variance_band", _C, "driver_rows", "ln(var)", "value", "variable")
_add_band("variation_log_band", _C, "drivers", "log10(var)", "log10(mean)")
_add_band("doc_fdom_band", _PAIR_STEPS, "pairs", '"DOC"', '"fDOM"')


def rounded(digits: dict[str, int], default: int, floor: str) -> dict[str, str]:
    """Complete statements, every double with so many significant digits, below the floor zero.

    ``digits`` names queries with other than the ``default`` number.
    """
    found = {}
    for name, (steps, final, doubles) in _QUERIES.items():
        named = ",\n".join(
            # a recursive step, with its column list, cannot be materialized
            f"{step} as {'' if '(' in step else 'materialized '}({sql})"
            for step, sql in steps.items()
        )
        places = digits.get(name, default) - 1
        replaced = ", ".join(
            f"""case when abs("{c}") < {floor} then 0e0
                     else cast(printf('%.{places}e', "{c}") as double) end as "{c}" """
            for c in doubles.split()
        )
        columns = f"* replace ({replaced})" if replaced else "*"
        found[name] = (
            f"with recursive {named}\nselect {columns} from ({final}) result"
        )
    return found

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import DAY, SPECTRUM, chem, exponential, one, plan, scan
from tannin.functions.missing import drop_incomplete
from tannin.operators import iron, slopes, spectra
from tannin.operators.merging import merge_tables
from tannin.plans import site_dates


def spectrum(spark, rows):
    return spark.createDataFrame(rows, SPECTRUM)


def test_replicates_are_averaged(spark):
    got = spectra.average_replicates(scan(spark, [
        ("s", 254, 0.10), ("s", 254, 0.12), ("s", 256, 0.1), ("s", 256, None)
    ]))
    values = {r.wavelength: r.absorbance for r in got.collect()}
    assert values == {254.0: pytest.approx(0.11), 256.0: None}


def test_average_is_a_hash_aggregate(spark):
    text = plan(spectra.average_replicates(scan(spark, [("s", 254, 0.1)])))
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_two_sites_in_one_sample_raise(spark):
    clash = scan(spark, [("s", 350, 0.1, "A"), ("s", 350, 0.1, "B"), ("t", 254, 0.1),
                         (None, 254, 0.1, "A"), (None, 254, 0.1, "B")])
    lab = chem(spark, ("s", "DOC", 2.0), ("t", "DOC", 2.0))
    assert spectra.average_replicates(clash.where("sampleID is null")).count() == 2
    with pytest.raises(Exception, match="attributes differ within sampleID wavelength: s 350"):
        spectra.suva_spectrum(clash, lab).collect()
    # the restriction reaches the scan, and what it leaves has one site
    assert spectra.wavelength_at(spectra.suva_spectrum(clash, lab), 254).count() == 1
    text = plan(spectra.suva_spectrum(clash, lab))
    assert "SortAggregate" not in text


def test_functional_check(spark):
    clash = scan(spark, [("s", 254, 0.1, "A"), ("s", 256, 0.1, "B"), ("t", 254, 0.1)])
    found = spectra.functional_violations(clash, ["sampleID"], ["siteID"])
    assert [r.sampleID for r in found.collect()] == ["s"]
    with pytest.raises(ValueError, match="vary within"):
        spectra.assert_functional(clash, ["sampleID"], ["siteID"])
    assert spectra.assert_functional(clash, ["sampleID", "wavelength"], ["siteID"]) is clash


def test_spectrum_joins_doc(spark):
    readings = scan(spark, [("s", 254, 0.1), ("zero", 254, 0.1), ("nil", 254, 0.0),
                            ("none", 254, 0.1)])
    lab = chem(spark, ("s", "DOC", 2.0), ("s", "DOC", 4.0), ("s", "Fe", 9.0),
               ("zero", "DOC", 0.0), ("nil", "DOC", 0.0))
    rows = spectra.suva_spectrum(readings, lab).collect()
    assert sorted((r.sampleID, r.SUVA) for r in rows) == [
        ("s", pytest.approx(2.5)), ("s", pytest.approx(5.0)), ("zero", float("inf"))
    ]
    mean = spectra.suva_spectrum(readings, lab, doc_replicates="mean")
    assert one(mean.where("sampleID = 's'"))["DOC"] == 3.0
    assert spectra.suva_spectrum(readings, lab, complete=False).count() == 4


def test_null_keys_join_only_on_request(spark):
    readings, lab = scan(spark, [(None, 254, 0.1)]), chem(spark, (None, "DOC", 1.0))
    assert spectra.suva_spectrum(readings, lab, complete=False).count() == 0
    assert spectra.suva_spectrum(readings, lab, complete=False, null_safe=True).count() == 1


def test_merge_suffixes_and_outer_keys(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    right = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    rows = merge_tables(left, right, ["k"], "full_outer").orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(1, "a", None), (2, "b", "c"), (3, None, "d")]
    assert merge_tables(left, right, ["k"]).columns == ["k", "v_x", "v_y"]


@pytest.mark.parametrize("slope", [0.005, 0.015, 0.03])
def test_known_slope_is_found(spark, slope):
    df = scan(spark, exponential("s", slope)).withColumn("SUVA", F.col("decadicAbsorbance"))
    got = one(slopes.slope_ratio(df, ["sampleID"]))
    assert got["slope275"] == pytest.approx(slope, abs=1e-9)
    assert got["slope350"] == pytest.approx(slope, abs=1e-9)
    assert got["Sr"] == pytest.approx(1.0, abs=1e-9)
    assert got["intercept275"] == pytest.approx(0.0, abs=1e-9)


def test_slope_edge_cases(spark):
    inf = float("inf")
    df = spectrum(spark, [
        ("one", DAY, 276.0, 2.0), ("one", DAY, 360.0, 2.0),
        ("low", DAY, 276.0, 1.0), ("low", DAY, 278.0, 0.5),
        ("odd", DAY, 276.0, 1.0), ("odd", DAY, 280.0, 0.5), ("odd", DAY, 278.0, inf),
        ("odd", DAY, 282.0, 0.0), ("odd", DAY, 284.0, -1.0), ("odd", DAY, 286.0, None),
    ])
    single = one(slopes.slope_ratio(df, ["siteID"]))
    assert single["siteID"] == "one" and single["slope275"] is None and single["Sr"] is None
    assert single["intercept275"] == pytest.approx(0.6931471805599453)
    odd = one(slopes.spectral_slope(df.where("siteID = 'odd'"), ["siteID"], "275"))
    assert odd["slope275"] == pytest.approx(0.6931471805599453 / 4)
    assert odd["nonfinite275"] == 2


def test_complete_spectra(spark):
    later = DAY + timedelta(days=1)
    rows = [("A", DAY, w, 1.0) for w in (276.0, 278.0, 360.0, 362.0)]
    rows += [("A", DAY, 276.0, 3.0), ("A", DAY, 278.0, None)]
    rows += [("A", later, w, 1.0) for w in (276.0, 278.0, 360.0)]
    rows += [("B", DAY, w, 1.0 if w != 278.0 else float("nan"))
             for w in (276.0, 278.0, 360.0, 362.0)]
    rows += [(None, DAY, w, 1.0) for w in (276.0, 278.0, 360.0, 362.0)]
    df = spectrum(spark, rows)
    got = spectra.complete_spectra(df).collect()
    assert {(r.siteID, r.collectDate, r.wavelength, r.SUVA) for r in got} == {
        ("A", DAY, 276.0, 2.0), ("A", DAY, 278.0, 1.0),
        ("A", DAY, 360.0, 1.0), ("A", DAY, 362.0, 1.0),
    }
    assert one(site_dates.slope_ratio_complete(df))["siteID"] == "A"


def test_all_missing_wavelength_still_counts(spark):
    df = spectrum(spark, [("A", DAY, 276.0, 1.0), ("B", DAY, 276.0, 1.0),
                          ("B", DAY, 278.0, None)])
    assert spectra.complete_spectra(df).count() == 0


def test_wide_and_row_means(spark):
    df = spectrum(spark, [("A", DAY, 254.0, 1.0), ("A", DAY, 254.0, 2.0),
                          ("A", DAY, 350.0, None), (None, DAY, 254.0, 5.0)])
    wide = spectra.spectra_wide(df, [254.0, 350.0]).where("siteID = 'A'")
    row = one(wide)
    assert row["254.0"] == 1.5 and row["350.0"] is None
    means = spectra.group_mean_on_rows(df)
    assert means.columns == df.columns
    assert sorted((r.siteID or "", r.wavelength, r.SUVA or 0) for r in means.collect()) == [
        ("", 254.0, 5.0), ("A", 254.0, 1.5), ("A", 254.0, 1.5), ("A", 350.0, 0)
    ]


def test_series_limits_and_order(spark):
    df = spectrum(spark, [("A", DAY, 254.0, 11.0), ("A", DAY, 404.0, 1.0),
                          ("A", DAY, 300.0, 1.0), ("A", DAY, 260.0, 2.0)])
    got = spectra.spectrum_series(df, ["siteID"], (200, 400), (0, 10)).collect()
    assert [r.wavelength for r in got] == [260.0, 300.0]
    logs = spectra.spectrum_series(df, ["siteID"], log=True).collect()
    assert logs[2].SUVA == pytest.approx(0.0)


def test_selections(spark):
    df = spectrum(spark, [("A", DAY, float(w), 1.0) for w in (275, 295, 296, 364, 366)])
    assert spectra.wavelength_band(df, *slopes.BAND_275).count() == 2
    assert spectra.wavelength_at(df, 364, 366).count() == 2
    assert one(spectra.label_type(df.limit(1), "x"))["type"] == "x"


def test_iron_join_is_inner(spark):
    lab = chem(spark, ("s", "DOC", 2.0), ("s", "Fe", 0.5), ("t", "DOC", 1.0),
               ("u", "DOC", 1.0), ("u", "Fe", None))
    spec = spectra.suva_spectrum(
        scan(spark, [(s, 276, 0.2) for s in "stu"] + [("s", 260, 0.2)]), lab)
    joined = iron.fe_join(spec, lab)
    assert {r.sampleID for r in joined.collect()} == {"s"}
    assert "LeftOuter" not in plan(joined)
    row = one(iron.fe_corrected_spectrum(joined))
    assert row["correctedAbsorbance"] == pytest.approx(0.2 - 0.0570 * 0.5)
    assert row["correctedSUVA"] == pytest.approx((0.2 - 0.0570 * 0.5) / 2 * 100)


def test_filter_reaches_scan(spark, tmp_path):
    path = str(tmp_path / "scan")
    scan(spark, exponential("s")).write.parquet(path)
    averaged = drop_incomplete(spectra.average_replicates(spark.read.parquet(path)))
    text = plan(spectra.wavelength_band(averaged, 275, 295))
    assert "GreaterThanOrEqual(wavelength,275.0)" in text
    # missing attributes are looked at after differing ones
    unchecked = drop_incomplete(spectra.average_replicates(spark.read.parquet(path), check=False))
    assert "IsNotNull(siteID)" in plan(unchecked)

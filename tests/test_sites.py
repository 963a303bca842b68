import math
import random
import statistics
from fractions import Fraction

import pytest

from helpers import DAY, chem, exponential, one, plan, scan
from pyspark.sql import functions as F
from tannin.operators import stats
from tannin.plans import site_dates

SLOPES = "siteID string, Sr double"
SITE = (
    "site_id string, site_type string, site_subtype string, latitude double, "
    "longitude double, mean_evelation_m string, mean_annual_precipitation_mm string, "
    "mean_annual_temperature_C string, dominant_nlcd_classes string, "
    "watershed_size_km2 double, lake_depth_mean_m double, lake_depth_max_m double"
)


def slopes(spark, rows):
    return spark.createDataFrame(rows, SLOPES)


def test_slopes_pool_all_samples_of_a_site_and_date(spark):
    readings = scan(spark, exponential("s", 0.01) + exponential("t", 0.02, 3.0))
    lab = chem(spark, ("s", "DOC", 1.0), ("s", "DOC", 4.0), ("t", "DOC", 2.0))
    got = one(site_dates.slope_ratio_by_site_date(readings, lab))
    # two copies of s and one of t over the same wavelengths
    assert got["slope275"] == pytest.approx((2 * 0.01 + 0.02) / 3)
    assert got["siteID"] == "A" and got["collectDate"] == DAY


def test_water_types(spark):
    lab = chem(spark, ("s", "DOC", 1.0))
    table = site_dates.slope_ratio_by_site_date(scan(spark, exponential("s")), lab)
    got = site_dates.compare_water_types(table, table).collect()
    assert {r.type for r in got} == {"Surface Water", "Groundwater"}


def test_variation(spark):
    df = slopes(spark, [("A", 1.0), ("A", 3.0), ("B", 2.0), ("C", 5.0), ("C", None)])
    got = {r.siteID: (r.var, r.mean) for r in site_dates.site_variation(df).collect()}
    assert got == {"A": (2.0, 2.0), "B": (None, 2.0), "C": (None, None)}
    assert one(site_dates.overall_variation(df)) == {"overall_var": None, "overall_mean": None}
    assert {r.overall_mean for r in site_dates.site_vs_overall(df).collect()} == {None}


def test_overall_variance_does_not_cancel(spark):
    random.seed(8)
    rows = [(f"S{i % 7}", 1000 + random.gauss(0, 1e-4)) for i in range(2000)]
    got = site_dates.site_vs_overall(slopes(spark, rows).repartition(6)).collect()
    exact = [Fraction(v) for _, v in rows]
    mean = sum(exact) / len(exact)
    variance = float(sum((v - mean) ** 2 for v in exact) / (len(exact) - 1))
    assert {r.overall_var for r in got} == {got[0].overall_var} and len(got) == 7
    assert got[0].overall_var == pytest.approx(variance, rel=1e-9)
    assert got[0].overall_mean == pytest.approx(float(mean), rel=1e-13)


def test_site_vs_overall_merges_moments(spark):
    random.seed(1)
    rows = [(random.choice("ABC"), random.gauss(1, 0.2)) for _ in range(60)] + [("D", 4.0)]
    values = [v for _, v in rows]
    got = site_dates.site_vs_overall(slopes(spark, rows)).collect()
    assert len(got) == 4
    for row in got:
        own = [v for s, v in rows if s == row.siteID]
        assert row.mean == pytest.approx(statistics.mean(own))
        assert (row.var is None) == (len(own) == 1)
        assert row.overall_var == pytest.approx(statistics.variance(values))
        assert row.overall_mean == pytest.approx(statistics.mean(values))


def test_overall_figures_reuse_the_slopes(spark):
    readings = scan(spark, exponential("s") + exponential("t"))
    slopes_ = site_dates.slope_ratio_by_site_date(readings, chem(spark, ("s", "DOC", 1.0), ("t", "DOC", 2.0)))
    df = site_dates.site_vs_overall(slopes_)
    df.collect()
    assert "ReusedExchange" in plan(df)


def sites(spark):
    return spark.createDataFrame([
        ("A", "Core Aquatic", "Lake", 1.0, 2.0, "300", "x", "22.5C/72.5F", "f", math.e, 1.0, None),
        ("B", "Gradient Aquatic", "Stream", 2.0, 3.0, "n/a", "10", "none", "g", 1.0, None, 2.0),
        ("C", "Core Terrestrial", "", 2.0, 3.0, "1", "1", "1", "g", 1.0, 1.0, 2.0),
    ], SITE)


def test_drivers(spark):
    variation = site_dates.site_variation(
        slopes(spark, [(s, v) for s in "ABCZ" for v in (1.0, 2.0)]))
    table = site_dates.site_drivers(variation, sites(spark))
    assert {r.siteID for r in table.collect()} == {"A", "B"}
    long = site_dates.driver_long(table)
    assert long.columns == ["siteID", "site_subtype", "var", "mean",
                            "dominant_nlcd_classes", "variable", "value"]
    values = {(r.siteID, r.variable): r.value for r in long.collect()}
    assert len(values) == 16
    assert values["A", "watershed_size_km2"] == pytest.approx(1.0)
    assert values["A", "mean_annual_temperature_C"] == 22.5
    assert values["A", "mean_annual_precipitation_mm"] is None
    assert values["B", "mean_evelation_m"] is None
    assert values["B", "lake_depth_mean_m"] is None


def test_time_series_is_ordered(spark):
    df = spark.createDataFrame(
        [("B", DAY, 1.0), ("A", DAY, 2.0)], "siteID string, collectDate timestamp, Sr double")
    assert [r.siteID for r in site_dates.sr_time_series(df).collect()] == ["A", "B"]


# --- statistics -------------------------------------------------------------

def quantile(values, p):
    values = sorted(values)
    h = (len(values) - 1) * p
    low = math.floor(h)
    high = min(low + 1, len(values) - 1)
    return values[low] + (h - low) * (values[high] - values[low])


@pytest.mark.parametrize("shape", ["ties", "spread", "tails", "powers", "ends"])
@pytest.mark.parametrize("shift", [0.0, 0.3])
def test_exact_quantiles(spark, shape, shift, monkeypatch):
    """Whatever the sketch says; a wrong one only costs passes."""
    right = stats.F.percentile_approx
    monkeypatch.setattr(stats.F, "percentile_approx", lambda c, p, a: right(
        c, [min(x + shift, 1.0) for x in p], 100))
    random.seed(3)
    draw = {
        "ties": lambda: float(random.choice([1, 1, 1, 2, 3])),
        "spread": lambda: random.random(),
        "tails": lambda: random.gauss(0, 1) / (random.random() + 1e-6) ** 3,
        "powers": lambda: 2.0 ** random.randrange(60),
        "ends": lambda: random.choice([-1.7e308, -1e300, 0.0, 5e-324, 1e308, 1.7e308]),
    }[shape]
    rows = [("hot", draw()) for _ in range(3000)]
    rows += [("small", draw()) for _ in range(7)] + [("one", 4.0), (None, 2.0), ("hot", None)]
    df = slopes(spark, rows).repartition(5)
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r.siteID: r for r in stats.exact_quantiles(df, "Sr", probs, ["siteID"]).collect()}
    for key in {k for k, _ in rows}:
        values = [v for k, v in rows if k == key and v is not None]
        assert got[key].n == len(values)
        for i, p in enumerate(probs):
            assert got[key][f"q{i}"] == pytest.approx(quantile(values, p), rel=1e-12)
    whole = one(stats.exact_quantiles(df, "Sr", [0.5]))
    assert whole["q0"] == pytest.approx(quantile([v for _, v in rows if v is not None], 0.5))


def test_quantiles_are_counted_not_ranked(spark):
    df = slopes(spark, [("a", float(i % 977)) for i in range(5000)]).repartition(4)
    summary = stats.store(stats._summary(df, "Sr", (0.5,), ["siteID"]), "summary")
    still = summary.select("siteID", F.struct(
        F.lit(0).alias("i"), F.lit(2500).cast("long").alias("rank"), F.col("n").alias("c"),
        F.col("least").alias("low"), F.col("most").alias("high"),
        F.col("bounds")[0].alias("cut_low"), F.col("bounds")[1].alias("cut_high")).alias("t"))
    text = plan(stats._narrowed(df, still, "Sr", ["siteID"]))
    assert "Window" not in text
    # a task hands on no more rows than there are intervals
    counted = stats._narrowed(df, still, "Sr", ["siteID"]).collect()
    assert len(counted) == 1 and counted[0]["t"]["low"] <= 477 <= counted[0]["t"]["high"]


def test_quantiles_of_nothing(spark):
    assert stats.exact_quantiles(slopes(spark, []), "Sr", [0.5]).count() == 0


def test_box(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 40.0]
    df = slopes(spark, [("A", v) for v in values] + [("A", math.inf), ("B", 1.0)])
    got = {r.siteID: r for r in stats.box_stats(df, "Sr", ["siteID"]).collect()}
    a = got["A"]
    assert (a.n, a.lower, a.middle, a.upper) == (6, 2.25, 3.5, 4.75)
    assert (a.ymin, a.ymax, a.outliers) == (1.0, 5.0, 1)
    assert (got["B"].ymin, got["B"].ymax, got["B"].outliers) == (1.0, 1.0, 0)
    out = stats.box_outliers(df, "Sr", ["siteID"]).collect()
    assert [(r.siteID, r.Sr) for r in out] == [("A", 40.0)]


def bandwidth(values):
    sd = statistics.stdev(values)
    robust = (quantile(values, 0.75) - quantile(values, 0.25)) / 1.34
    spread = min(sd, robust) or sd or abs(values[0]) or 1.0
    return 0.9 * spread * len(values) ** -0.2


def test_density(spark):
    random.seed(5)
    groups = {"A": [random.gauss(1, 0.1) for _ in range(40)], "B": [2.0, 2.0, 2.0],
              "C": [0.0, 0.0], "D": [1.0]}
    df = slopes(spark, [(k, v) for k, vs in groups.items() for v in vs])
    everything = [v for vs in groups.values() for v in vs]
    low, high = min(everything), max(everything)
    step = (high - low) / 511
    curve = stats.density_curve(df, "Sr", ["siteID"]).collect()
    assert len(curve) == len({(r.siteID, r.i) for r in curve}) == 3 * 512
    for row in curve:
        values = groups[row.siteID]
        x = low + row.i * step
        bw = bandwidth(values)

        def kernel(away):
            return math.exp(-(away / bw) ** 2 / 2) / (len(values) * bw * math.sqrt(2 * math.pi))

        binned = 0.0
        for v in values:
            place = (v - low) / step
            k, after = math.floor(place), place - math.floor(place)
            binned += (1 - after) * kernel((row.i - k) * step) + after * kernel((row.i - k - 1) * step)
        assert row.x == pytest.approx(x)
        assert row.density == pytest.approx(binned, rel=1e-9, abs=1e-300)
        # binning moves the curve by the square of the grid's step in bandwidths
        exact = sum(kernel(x - v) for v in values)
        assert abs(row.density - exact) <= (step / bw) ** 2 * 0.4 / bw


def test_density_of_one_value(spark):
    df = slopes(spark, [("A", 3.0), ("A", 3.0)])
    curve = stats.density_curve(df, "Sr", ["siteID"]).collect()
    bw = 0.9 * 3.0 * 2 ** -0.2
    assert len(curve) == 512
    assert {round(r.density, 9) for r in curve} == {round(1 / (bw * math.sqrt(2 * math.pi)), 9)}


XY = "g string, x double, y double"


def test_fit_of_a_textbook_line(spark):
    # hand-computed: sxx = 10, sxy = 6, syy = 6
    points = [(1, 2), (2, 4), (3, 5), (4, 4), (5, 5)]
    df = spark.createDataFrame(
        [("a", float(x), float(y)) for x, y in points]
        + [("a", None, 1.0), ("a", 1.0, math.nan), ("a", math.inf, 1.0)], XY)
    got = one(stats.linear_fit(df, "y", "x"))
    assert got["n"] == 5 and got["nonfinite"] == 1 and got["df"] == 3
    assert got["slope"] == pytest.approx(0.6) and got["intercept"] == pytest.approx(2.2)
    assert got["sigma"] == pytest.approx(math.sqrt(0.8))
    assert got["se_slope"] == pytest.approx(math.sqrt(0.08))
    assert got["se_intercept"] == pytest.approx(math.sqrt(0.8 * 1.1))
    assert got["r_squared"] == pytest.approx(0.6)
    assert got["adj_r_squared"] == pytest.approx(1 - 0.4 * 4 / 3)
    assert got["f_statistic"] == pytest.approx(4.5)
    assert got["p_slope"] == pytest.approx(0.124027, abs=1e-6)
    summary = one(stats.fit_summary(df, "y", "x"))
    residuals = [y - 2.2 - 0.6 * x for x, y in points]
    names = ("min", "q1", "median", "q3", "max")
    for name, p in zip(names, (0, 0.25, 0.5, 0.75, 1)):
        assert summary[f"residual_{name}"] == pytest.approx(quantile(residuals, p))


def test_fit_agrees_with_the_ml_library(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    random.seed(2)
    rows = [("a", float(i), 0.3 * i + random.gauss(0, 4)) for i in range(25)]
    df = spark.createDataFrame(rows, XY)
    features = VectorAssembler(inputCols=["x"], outputCol="f").transform(df)
    model = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(features)
    got = one(stats.linear_fit(df, "y", "x", ["g"]))
    assert got["slope"] == pytest.approx(model.coefficients[0])
    assert got["intercept"] == pytest.approx(model.intercept)
    assert [got["p_slope"], got["p_intercept"]] == pytest.approx(model.summary.pValues)
    assert [got["se_slope"], got["se_intercept"]] == pytest.approx(
        model.summary.coefficientStandardErrors)
    assert got["r_squared"] == pytest.approx(model.summary.r2)


def test_degenerate_fits(spark):
    df = spark.createDataFrame([
        ("flat", 1.0, 2.0), ("flat", 1.0, 4.0), ("flat", 1.0, 6.0),
        ("two", 0.0, 1.0), ("two", 1.0, 3.0), ("one", 1.0, 5.0), ("none", None, 1.0)], XY)
    got = {r.g: r for r in stats.linear_fit(df, "y", "x", ["g"]).collect()}
    assert got["flat"].slope is None and got["flat"].intercept == 4.0
    assert got["flat"].df == 2 and got["flat"].sigma == pytest.approx(2.0)
    assert got["two"].slope == 2.0 and got["two"].sigma is None and got["two"].p_slope is None
    assert got["one"].intercept == 5.0 and got["none"].intercept is None
    band = stats.linear_fit_band(df, "y", "x", ["g"]).collect()
    assert {r.g for r in band} == {"two"} and len(band) == 80
    assert band[0].lower is None


def test_band(spark):
    points = [(1, 2), (2, 4), (3, 5), (4, 4), (5, 5)]
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in points], XY)
    band = stats.linear_fit_band(df, "y", "x", points=5).orderBy("x").collect()
    assert [r.x for r in band] == [1.0, 2.0, 3.0, 4.0, 5.0]
    for r in band:
        half = 3.182446305 * math.sqrt(0.8 * (1 / 5 + (r.x - 3) ** 2 / 10))
        assert r.fitted == pytest.approx(2.2 + 0.6 * r.x)
        assert r.upper - r.fitted == pytest.approx(half, rel=1e-8)
        assert r.fitted - r.lower == pytest.approx(half, rel=1e-8)


def test_grouped_summary(spark):
    df = spark.createDataFrame(
        [(g, float(x), float(x * k + x % 2)) for g, k in (("a", 1), ("b", 2))
         for x in range(6)], XY)
    got = {r.g: r for r in stats.fit_summary(df, "y", "x", ["g"]).collect()}
    assert got["b"].slope - got["a"].slope == pytest.approx(1.0)
    assert got["a"].residual_max == pytest.approx(got["b"].residual_max)


def test_many_groups_are_joined_without_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = slopes(spark, [(k, float(v)) for k in ("A", "B", None) for v in range(9)] * 3)
        got = stats.box_stats(df, "Sr", ["siteID"]).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r.siteID, r.n, r.middle, r.ymax) for r in got} == {
        (k, 27, 4.0, 8.0) for k in ("A", "B", None)}

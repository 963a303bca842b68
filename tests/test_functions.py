import math
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tannin.functions import missing, parsing, student_t

INF, NAN = float("inf"), float("nan")


def column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


@pytest.mark.parametrize("values, mean", [
    ([0.10, 0.12], 0.11), ([0.10, None], None), ([0.10, NAN], None), ([None], None),
])
def test_strict_mean(spark, values, mean):
    got = column(spark, values).agg(missing.strict_avg("x").alias("m")).first().m
    assert got == pytest.approx(mean) if mean is not None else got is None


def test_strict_spread(spark):
    def spread(values):
        return column(spark, values).agg(
            missing.strict_stddev("x").alias("s"), missing.strict_variance("x").alias("v")
        ).first()
    assert spread([1.0, 3.0]).v == pytest.approx(2.0)
    assert spread([1.0, 3.0]).s == pytest.approx(math.sqrt(2))
    assert spread([1.0]).s is None and spread([1.0]).v is None
    assert spread([1.0, 2.0, None]).v is None


@pytest.mark.parametrize("a, b, expected", [
    (1.0, 4.0, 0.25), (1.0, 0.0, INF), (-1.0, 0.0, -INF), (0.0, 0.0, NAN),
    (NAN, 0.0, NAN), (None, 0.0, None), (1.0, None, None), (1.0, INF, 0.0),
])
def test_division(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a double, b double")
    got = df.select(missing.ieee_div("a", "b").alias("q")).first().q
    if expected is not None and math.isnan(expected):
        assert math.isnan(got)
    else:
        assert got == expected


def test_drop_incomplete(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("b", None), ("c", NAN), ("d", INF), (None, 2.0)], "k string, x double"
    )
    assert {r.k for r in missing.drop_incomplete(df).collect()} == {"a", "d"}
    assert missing.drop_incomplete(df, ["k"]).count() == 4


def test_missing_and_finite(spark):
    df = column(spark, [1.0, None, NAN, INF, -INF])
    got = df.select(missing.is_missing("x").alias("m"), missing.is_finite("x").alias("f"))
    assert [tuple(r) for r in got.collect()] == [
        (False, True), (True, False), (True, False), (False, False), (False, False)
    ]


def parsed(spark, function, texts):
    df = column(spark, texts, "string")
    return [r[0] for r in df.select(function(F.col("x"))).collect()]


def test_numbers_in_text(spark):
    texts = ["22.5C/72.5F", "1,234.5 m", "none", None, "-3", ".5 m"]
    assert parsed(spark, parsing.parse_number, texts) == [
        22.5, 1234.5, None, None, -3.0, 0.5
    ]


def test_text_as_number(spark):
    texts = ["12", " 1e3 ", "12 m", "", None, "1d", "Inf", "NA"]
    assert parsed(spark, parsing.as_number, texts) == [
        12.0, 1000.0, None, None, None, None, INF, None
    ]


def test_timestamps(spark):
    texts = ["2024-05-01 10:20:30", "2024-05-01T10:20:30Z", "2024-05-01", "x", None]
    moment = datetime(2024, 5, 1, 10, 20, 30)
    assert parsed(spark, parsing.parse_timestamp, texts) == [
        moment, moment, None, None, None
    ]
    loose = parsed(spark, lambda c: parsing.parse_timestamp(c, strict=False), texts)
    assert loose[2] == datetime(2024, 5, 1)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_round_to_five_minutes(spark, kind):
    cases = {
        "2024-01-01 00:02:30.000": "2024-01-01 00:05:00",
        "2024-01-01 00:02:29.999": "2024-01-01 00:00:00",
        "2024-01-01 00:07:29.999999": "2024-01-01 00:05:00",
        "1969-12-31 23:57:30": "1970-01-01 00:00:00",
        "1969-12-31 23:57:29": "1969-12-31 23:55:00",
    }
    df = column(spark, list(cases), "string").select(
        "x", parsing.round_5min(F.col("x").cast(kind)).cast("string").alias("r")
    )
    assert {r.x: r.r for r in df.collect()} == cases


# two-sided tail probabilities and critical values from printed t tables
@pytest.mark.parametrize("df, t", [(1, 12.706), (4, 2.776), (10, 2.228), (120, 1.980)])
def test_t_table(df, t):
    assert student_t.two_sided_tail(t, df) == pytest.approx(0.05, abs=2e-5 * 10)
    assert student_t.critical_value(df, 0.95) == pytest.approx(t, abs=5e-4)


def test_t_closed_forms():
    for t in (0.1, 1.0, 3.0, 40.0):
        assert student_t.two_sided_tail(t, 1) == pytest.approx(
            1 - 2 * math.atan(t) / math.pi, rel=1e-12)
        assert student_t.two_sided_tail(t, 2) == pytest.approx(
            1 - t / math.sqrt(2 + t * t), rel=1e-9)
    assert math.isnan(student_t.two_sided_tail(1.0, 0))
    assert student_t.two_sided_tail(INF, 3) == 0.0


@pytest.mark.parametrize("df", [10**10, 10**11, 10**12])
def test_t_nears_the_normal(df):
    for t in (0.1, 1.0, 1.7, 2.0, 3.0, 5.0):
        assert student_t.two_sided_tail(t, df) == pytest.approx(math.erfc(t / math.sqrt(2)), abs=1e-10)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 10**12), st.floats(0.01, 0.999))
def test_critical_value_inverts_tail(df, level):
    t = student_t.critical_value(df, level)
    assert student_t.two_sided_tail(t, df) == pytest.approx(1 - level, abs=1e-9)

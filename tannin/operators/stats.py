"""Fitted lines, quantiles, box statistics and density curves, per group."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tannin.functions.missing import is_finite, nan_to_null
from tannin.functions.student_t import t_critical, t_two_sided_p
from tannin.operators.merging import merge_tables
from tannin.sources.sinks import store

# Rank error of the quantile sketch is one in this many rows.
SKETCH_ACCURACY = 10_000
# Intervals that a bracket is cut into when its values are counted.
SPLITS = 512

QUARTILES = (0.25, 0.5, 0.75)

# Fences in interquartile ranges, grid sizes, the normal
# reference bandwidth rule and its quantile-to-deviation ratio.
FENCE = 1.5
DENSITY_GRID = 512
LINE_GRID = 80
BANDWIDTH_FACTOR = 0.9
IQR_PER_SD = 1.34

# exp(-u*u/2) is exactly zero beyond this many bandwidths
KERNEL_REACH = 39.0

# SQL text: the place of a value among the intervals of its bracket, those
# below and above it included.  Halves, since a difference may overflow; in
# full where the halves of the smallest numbers are equal.
INTERVAL = f"""
    case when _x < t.cut_low then 0 when _x > t.cut_high then {SPLITS + 1}
         when t.cut_low = t.cut_high then 1
         else 1 + least({SPLITS - 1}, int(floor({SPLITS} * coalesce(
             try_divide(_x / 2 - t.cut_low / 2, t.cut_high / 2 - t.cut_low / 2),
             try_divide(_x - t.cut_low, t.cut_high - t.cut_low))))) end"""

# SQL text: the interval that holds a rank, from the counts of all of them
HOLDING = """
    aggregate(array_sort(intervals),
        named_struct('rank', rank, 'c', 0L, 'low', double(null), 'high', double(null)),
        (s, v) -> case when s.low is not null then s
            when s.rank < v.c then named_struct('rank', s.rank, 'c', v.c, 'low', v.low, 'high', v.high)
            else named_struct('rank', s.rank - v.c, 'c', 0L, 'low', double(null), 'high', double(null)) end)"""


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float] = QUARTILES,
    by: Sequence[str] = (),
) -> DataFrame:
    """Interpolated quantiles ``q0, q1, ..`` and row count ``n`` per group.

    Exact, yet no task ever holds a group or ranks its values.  Non-finite
    values take no part.  Reads ``df`` once for the summary of the groups and
    once per pass of the selection: store it if it is costly.
    """
    rows = _finite(df, value, by).withColumn(value, F.col(value).cast("double"))
    summary = store(_summary(rows, value, probs, by), "summary")
    return _quantiles(rows, summary, value, probs, by)


def _summary(rows: DataFrame, value: str, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Per group: rows, ends, spread, and from a mergeable sketch where the ranks about lie."""
    margin = 2.0 / SKETCH_ACCURACY
    bounds = [bound for p in probs for bound in (max(p - margin, 0.0), min(p + margin, 1.0))]
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"),
        F.stddev_samp(value).alias("sd"),
        F.percentile_approx(value, bounds, SKETCH_ACCURACY).alias("bounds"),
    ).where("n > 0")


def _quantiles(
    rows: DataFrame, summary: DataFrame, value: str, probs: Sequence[float], by: Sequence[str]
) -> DataFrame:
    """Quantiles by repeated counting.

    A quantile lies between the values of two neighbouring ranks.  For each
    of them a bracket of values is known that holds it.  A pass cuts every
    open bracket into intervals and counts their values, combining before the
    shuffle, and keeps the interval of the rank, narrowed to its smallest and
    largest value.  When these are equal, or the rank is the first or last,
    the value is found.  The sketch only says where the first cuts lie: a
    wrong one costs a pass.  The brackets are stored between passes, so lost
    work is redone alike.
    """
    def target(i: int, p: float, upper: bool) -> Column:
        place = (F.col("n") - 1) * F.lit(float(p))
        return F.struct(
            F.lit(2 * i + upper).alias("i"),
            (F.ceil(place) if upper else F.floor(place)).cast("long").alias("rank"),
            F.col("n").alias("c"), F.col("least").alias("low"), F.col("most").alias("high"),
            F.col("bounds")[2 * i].alias("cut_low"), F.col("bounds")[2 * i + 1].alias("cut_high"),
        )

    wanted = F.array(*(target(i, p, upper) for i, p in enumerate(probs) for upper in (False, True)))
    still = summary.select(*by, F.explode(wanted).alias("t")).select(*by, _settled("t"))
    found, left = [], True
    while left:
        found.append(still.where("t.low = t.high"))
        still = store(_narrowed(rows, still.where("t.low < t.high"), value, by), "brackets")
        left = not still.where("t.low < t.high").isEmpty()
    found.append(still)
    settled = reduce(DataFrame.union, found).groupBy(*by).agg(*(
        F.max(F.when(F.col("t.i") == i, F.col("t.low"))).alias(f"v{i}") for i in range(2 * len(probs))
    ))
    both = _join_groups(summary.select(*by, "n"), settled, by)

    def interpolated(i: int, p: float) -> Column:
        place = (F.col("n") - 1) * F.lit(float(p))
        a, b = F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}")
        return (a + (b - a) * (place - F.floor(place))).alias(f"q{i}")

    return both.select(*by, "n", *(interpolated(i, p) for i, p in enumerate(probs)))


def _settled(t: str) -> Column:
    """A target whose bracket is one value where its rank is at an end."""
    low, high = F.col(f"{t}.low"), F.col(f"{t}.high")
    first, last = F.col(f"{t}.rank") == 0, F.col(f"{t}.rank") == F.col(f"{t}.c") - 1
    fields = [F.col(f"{t}.{name}").alias(name) for name in ("i", "rank", "c")]
    ends = [F.when(last & ~first, high).otherwise(low).alias("low"),
            F.when(first, low).otherwise(high).alias("high")]
    cuts = [F.col(f"{t}.{name}").alias(name) for name in ("cut_low", "cut_high")]
    return F.struct(*fields, *ends, *cuts).alias("t")


def _narrowed(rows: DataFrame, still: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """One pass: each open bracket becomes the one of its intervals that holds the rank."""
    targets = still.groupBy(*by).agg(F.collect_list("t").alias("w"))  # two per quantile at most
    inside = F.filter("w", lambda t: F.col("_x").between(t["low"], t["high"]))
    counted = _join_groups(rows.select(*by, F.col(value).alias("_x")), targets, by).select(
        *by, "_x", F.explode(inside).alias("t")
    ).groupBy(*by, F.col("t.i").alias("i"), F.col("t.rank").alias("rank"),
              F.expr(INTERVAL).alias("interval")).agg(
        F.count(F.lit(1)).alias("c"), F.min("_x").alias("low"), F.max("_x").alias("high"))
    chosen = counted.groupBy(*by, "i", "rank").agg(
        F.collect_list(F.struct("interval", "c", "low", "high")).alias("intervals")  # SPLITS + 2 at most
    ).select(*by, "i", F.expr(HOLDING).alias("s"))
    narrower = chosen.select(*by, F.struct(
        "i", "s.rank", "s.c", "s.low", "s.high",
        F.col("s.low").alias("cut_low"), F.col("s.high").alias("cut_high")).alias("t"))
    return narrower.select(*by, _settled("t"))


def _join_groups(rows: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add per-group columns to rows; ``groups`` has one row per key.

    An ordinary join: groups come from stored tables, whose bytes Spark knows,
    so it broadcasts them by size, and splits the rows of a hot key when it
    shuffles.  Without grouping there is one row, which becomes a scalar.
    """
    if by:
        return merge_tables(rows, groups, by, null_safe=True)
    one = groups.select(F.struct(*groups.columns).alias("g")).scalar()
    with_one = rows.withColumn("g", one).where(F.col("g").isNotNull())
    return with_one.select(*rows.columns, *(F.col(f"g.`{c}`") for c in groups.columns))


def box_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, whisker ends and number of outliers per group.

    Whiskers end at the last values within 1.5 interquartile ranges of the
    box.  Non-finite values take no part.
    """
    rows = store(_finite(df, value, by), "values")
    quartiles = exact_quantiles(rows, value, QUARTILES, by)
    inner = F.when(_within_fences(value), F.col(value))
    return _join_groups(rows, quartiles, by).groupBy(*by, "n", "q0", "q1", "q2").agg(
        F.min(inner).alias("low"), F.max(inner).alias("high"),
        F.count_if(~_within_fences(value)).alias("outliers"),
    ).select(
        *by, "n",
        F.least("low", "q0").alias("ymin"), F.col("q0").alias("lower"),
        F.col("q1").alias("middle"), F.col("q2").alias("upper"),
        F.greatest("high", "q2").alias("ymax"), "outliers",
    )


def box_outliers(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """The rows of ``df`` that lie outside the whiskers of their group."""
    rows = store(_finite(df, value, by, *df.columns), "values")
    box = exact_quantiles(rows, value, QUARTILES, by)
    return _join_groups(rows, box, by).where(~_within_fences(value)).select(*df.columns)


def _finite(df: DataFrame, value: str, by: Sequence[str], *more: str) -> DataFrame:
    columns = list(dict.fromkeys([*by, value, *more]))
    return df.where(is_finite(value)).select(*columns)


def _within_fences(value: str) -> Column:
    reach = FENCE * (F.col("q2") - F.col("q0"))
    return F.col(value).between(F.col("q0") - reach, F.col("q2") + reach)


def density_curve(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Gaussian kernel density per group on one grid over all groups' range.

    Linear binning: a value gives its two neighbouring grid points shares of
    its weight by closeness, and the kernel runs between grid points.  So
    whatever the number of values, a group is at most one weight per grid
    point, and the curve a product of the kernel matrix of the grid with
    these weights.  Groups of one value have no curve.
    """
    rows = store(_finite(df, value, by).withColumn(value, F.col(value).cast("double")), "values")
    summary = store(_summary(rows, value, QUARTILES, by), "summary")
    several = summary.where("n > 1")
    span = summary.agg(F.min("least").alias("lo"), F.max("most").alias("hi"))
    quartiles = _quantiles(rows, several, value, QUARTILES, by).drop("n")
    groups = _join_groups(several, quartiles, by).select(
        *by, "n", _bandwidth().alias("bw"), span.select(F.struct("lo", "hi")).scalar().alias("span"),
    ).select(*by, "n", "bw", F.col("span.lo").alias("lo"), _step("span").alias("step"))
    last = DENSITY_GRID - 1
    place = F.when(_step("span") > 0, (F.col(value) - F.col("span.lo")) / _step("span")).otherwise(F.lit(0.0))
    binned = rows.withColumn("span", span.select(F.struct("lo", "hi")).scalar()).select(
        *by, F.least(F.greatest(place, F.lit(0.0)), F.lit(float(last))).alias("place")
    ).groupBy(*by, F.floor("place").cast("int").alias("i")).agg(
        F.sum(F.col("place") - F.floor("place")).alias("after"), F.count(F.lit(1)).alias("c"))
    weights = binned.select(*by, F.explode(F.array(
        F.struct("i", (F.col("c") - F.col("after")).alias("weight")),
        F.struct((F.col("i") + 1).alias("i"), F.col("after").alias("weight")))).alias("w"),
    ).where("w.weight > 0").select(*by, "w.*")
    # how many grid points away a kernel is not zero
    reach = F.when(F.col("step") > 0, F.least(
        F.ceil(F.lit(KERNEL_REACH) * F.col("bw") / F.col("step")), F.lit(last))).otherwise(last).cast("int")
    spread = _join_groups(weights, groups, by).withColumn("j", F.explode(F.sequence(
        F.greatest(F.col("i") - reach, F.lit(0)), F.least(F.col("i") + reach, F.lit(last)))))
    u = (F.col("j") - F.col("i")) * F.col("step") / F.col("bw")
    sums = spread.groupBy(*by, "n", "bw", "lo", "step", "j").agg(
        F.sum(F.col("weight") * F.exp(-u * u / 2)).alias("kernel"))
    # a point that no kernel reaches has weight 0 from each group
    grid = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("j"), F.lit(0.0).alias("kernel"))
    names = [*by, "n", "bw", "lo", "step", "j"]
    curve = sums.select(*names, "kernel").unionByName(grid.select(*names, "kernel")).groupBy(*names).agg(
        F.sum("kernel").alias("kernel"))
    scale = F.col("n") * F.col("bw") * math.sqrt(2 * math.pi)
    return curve.select(
        *by, F.col("j").alias("i"), (F.col("lo") + F.col("j") * F.col("step")).alias("x"),
        (F.col("kernel") / scale).alias("density"),
    )


def _step(span: str) -> Column:
    return (F.col(f"{span}.hi") - F.col(f"{span}.lo")) / (DENSITY_GRID - 1)


def _bandwidth() -> Column:
    """Normal reference rule: the smaller of two spreads, if not zero."""
    robust = (F.col("q2") - F.col("q0")) / IQR_PER_SD
    smaller = F.least("sd", robust)
    spread = (
        F.when(smaller > 0, smaller).when(F.col("sd") > 0, F.col("sd"))
        .when(F.col("least") != 0, F.abs("least")).otherwise(F.lit(1.0))
    )
    return BANDWIDTH_FACTOR * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2))


def _line_moments(df: DataFrame, y: str, x: str, by: Sequence[str]) -> DataFrame:
    """One pass of regression aggregates over the finite pairs."""
    pair = is_finite(y) & is_finite(x)
    present = nan_to_null(y).isNotNull() & nan_to_null(x).isNotNull()
    ys, xs = F.when(pair, F.col(y)).cast("double"), F.when(pair, F.col(x)).cast("double")
    return df.groupBy(*by).agg(
        F.regr_count(ys, xs).alias("n"),
        F.count_if(present & ~pair).alias("nonfinite"),
        F.regr_slope(ys, xs).alias("slope"),
        # without a spread in x the fit is the mean alone
        F.coalesce(F.regr_intercept(ys, xs), F.regr_avgy(ys, xs)).alias("intercept"),
        F.regr_avgx(ys, xs).alias("mean_x"),
        F.regr_sxx(ys, xs).alias("sxx"), F.regr_syy(ys, xs).alias("syy"),
        F.regr_sxy(ys, xs).alias("sxy"),
        F.min(xs).alias("min_x"), F.max(xs).alias("max_x"),
    )


def _residual_spread(moments: DataFrame) -> DataFrame:
    explained = F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx"))
    left = F.col("syy") - F.coalesce(explained, F.lit(0.0))
    fitted = F.when(F.col("slope").isNotNull(), 2).otherwise(1)
    return moments.withColumns({
        "df": F.when(F.col("n") > 0, F.col("n") - fitted),
        "rss": F.greatest(left, F.lit(0.0)),
    }).withColumn(
        "sigma", F.when(F.col("df") > 0, F.sqrt(F.col("rss") / F.col("df")))
    )


def linear_fit(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of y on x per group, with the usual test statistics.

    Pairs with a missing value are left out, as are infinite ones, which
    ``nonfinite`` counts.  Without a spread in x the intercept is the mean of
    y and the slope NULL; without usable pairs both are NULL.
    """
    fit = _residual_spread(_line_moments(df, y, x, by))
    se_slope = F.try_divide(F.col("sigma"), F.sqrt("sxx"))
    off = F.try_divide(F.col("mean_x") * F.col("mean_x"), F.col("sxx"))
    se_intercept = F.col("sigma") * F.sqrt(
        F.try_divide(F.lit(1.0), "n") + F.coalesce(off, F.lit(0.0))
    )
    r2 = F.when(F.col("syy") > 0, 1 - F.col("rss") / F.col("syy"))
    fit = fit.withColumns({
        "se_intercept": se_intercept, "se_slope": se_slope, "r_squared": r2,
    }).withColumns({
        "t_intercept": F.try_divide("intercept", "se_intercept"),
        "t_slope": F.try_divide("slope", "se_slope"),
        "adj_r_squared": F.when(
            F.col("df") > 0,
            1 - (1 - F.col("r_squared")) * (F.col("n") - 1) / F.col("df"),
        ),
    }).withColumn("f_statistic", F.col("t_slope") * F.col("t_slope"))
    freedom = F.col("df").cast("double")
    return fit.withColumns({
        "p_intercept": t_two_sided_p("t_intercept", freedom),
        # with one predictor the F test is the slope's t test
        "p_slope": t_two_sided_p("t_slope", freedom),
    }).select(
        *by, "n", "nonfinite", "df", "intercept", "slope",
        "se_intercept", "se_slope", "t_intercept", "t_slope",
        "p_intercept", "p_slope", "sigma", "r_squared", "adj_r_squared",
        "f_statistic",
    )


def fit_summary(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """``linear_fit`` with the five-number summary of the residuals."""
    # infinite pairs are kept: the fit counts them, and they have no finite residual
    pairs = store(
        df.select(*by, nan_to_null(y).alias(y), nan_to_null(x).alias(x)).dropna(subset=[y, x]), "pairs"
    )
    fit = store(linear_fit(pairs, y, x, by), "fit")
    line = fit.select(*by, "intercept", "slope")
    residuals = _join_groups(pairs, line, by).select(
        *by,
        (F.col(y) - F.col("intercept") - F.col("slope") * F.col(x)).alias("residual"),
    )
    five = exact_quantiles(residuals, "residual", (0.0, 0.25, 0.5, 0.75, 1.0), by)
    named = five.drop("n").withColumnsRenamed({
        "q0": "residual_min", "q1": "residual_q1", "q2": "residual_median",
        "q3": "residual_q3", "q4": "residual_max",
    })
    if by:
        return merge_tables(fit, named, by, "left", null_safe=True)
    values = named.select(F.struct(*named.columns)).scalar()
    return fit.withColumn("five", values).select(*fit.columns, "five.*")


def linear_fit_band(
    df: DataFrame,
    y: str,
    x: str,
    by: Sequence[str] = (),
    level: float = 0.95,
    points: int = LINE_GRID,
) -> DataFrame:
    """Fitted line on an even grid over x, with its confidence band."""
    fit = _residual_spread(_line_moments(df, y, x, by)).where(
        F.col("slope").isNotNull()
    )
    fit = fit.withColumn(
        "t", t_critical(F.col("df").cast("double"), F.lit(level))
    )
    step = (F.col("max_x") - F.col("min_x")) / (points - 1)
    grid = fit.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("min_x") + F.col("i") * step
    fitted = F.col("intercept") + F.col("slope") * at
    off = at - F.col("mean_x")
    se = F.col("sigma") * F.sqrt(1 / F.col("n") + off * off / F.col("sxx"))
    return grid.select(
        *by, "i", at.alias("x"), fitted.alias("fitted"),
        (fitted - F.col("t") * se).alias("lower"),
        (fitted + F.col("t") * se).alias("upper"),
    )

import functools
import itertools
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

import __spark_entry__ as entry
from helpers import DAY, chem, exponential, one, plan, scan
from tannin.operators.slopes import slope_ratio
from tannin.operators.spectra import suva_spectrum
from tannin.plans import metrics
from tannin.sources import sinks

NAMES = ["sampleID", "domainID", "siteID", "collectDate", "DOC", "SUVA254", "SUVA350",
         "E2E3", "SR"]


def test_one_exponential_sample(spark):
    got = one(metrics.sample_metrics(
        scan(spark, exponential("s")), chem(spark, ("s", "DOC", 2.0))))
    assert list(got) == NAMES
    assert got["SUVA254"] == pytest.approx(math.exp(-0.015 * 254) * 50)
    assert got["SUVA350"] == pytest.approx(math.exp(-0.015 * 350) * 50)
    near = (math.exp(-0.015 * 364) + math.exp(-0.015 * 366)) / 2
    assert got["E2E3"] == pytest.approx(math.exp(-0.015 * 250) / near)
    assert got["SR"] == pytest.approx(1.0)
    assert got["siteID"] == "A" and got["collectDate"] == DAY


def test_samples_with_gaps(spark):
    readings = (
        exponential("no254", skip={254}) + exponential("no250", skip={250})
        + exponential("no366", skip={366})
        + [("other", 300, 0.1), ("band", 276, 0.1), ("half", 350, 0.1)]
        + [("both", 276, 0.1), ("both", 360, 0.1)]
    )
    names = {r[0] for r in readings}
    got = {r.sampleID: r for r in metrics.sample_metrics(
        scan(spark, readings), chem(spark, *((n, "DOC", 1.0) for n in names))).collect()}
    assert set(got) == {"no254", "no250", "no366", "half", "both"}
    assert got["no254"].siteID is None and got["no254"].DOC is None
    assert got["no254"].SUVA254 is None and got["no254"].SR == pytest.approx(1.0)
    assert got["no250"].E2E3 is None and got["no250"].SUVA254 is not None
    assert got["no366"].E2E3 == pytest.approx(math.exp(0.015 * (364 - 250)))
    assert got["half"].SUVA350 == pytest.approx(10.0) and got["half"].SR is None
    assert got["both"].SR is None


def test_zero_doc_and_missing_absorbance(spark):
    readings = exponential("zero") + [("gap", 254, None), ("gap", 350, 0.1)]
    got = {r.sampleID: r for r in metrics.sample_metrics(
        scan(spark, readings), chem(spark, ("zero", "DOC", 0.0), ("gap", "DOC", 1.0))
    ).collect()}
    assert got["zero"].SUVA254 == math.inf and got["zero"].SR is None
    assert got["gap"].SUVA254 is None and got["gap"].SUVA350 == pytest.approx(10.0)


@pytest.mark.parametrize("wavelength", [254, 350, 366, 280])
def test_conflicting_attributes_raise(spark, wavelength):
    clash = scan(spark, [("s", wavelength, 0.1, "A"), ("s", wavelength, 0.1, "B"), ("s", 254, 0.1, "A")])
    with pytest.raises(Exception, match="attributes differ"):
        metrics.sample_metrics(clash, chem(spark, ("s", "DOC", 1.0))).collect()


def test_two_doc_rows(spark):
    readings = scan(spark, exponential("s", 0.02))
    lab = chem(spark, ("s", "DOC", 2.0), ("s", "DOC", 4.0))
    cross = metrics.sample_metrics(readings, lab, replicates="cross").collect()
    assert len(cross) == 8
    assert {(r.DOC, round(r.SUVA254 / r.SUVA350, 3)) for r in cross} == {
        (d, round(math.exp(0.02 * 96) * ratio, 3))
        for d, ratio in ((2.0, 1), (2.0, 2), (4.0, 1), (4.0, 0.5))
    }
    mean = one(metrics.sample_metrics(readings, lab))
    assert mean["DOC"] == 3.0
    assert all(r.SR == pytest.approx(mean["SR"]) for r in cross)


def test_analyses_without_value_are_left_out(spark):
    readings = scan(spark, exponential("s") + exponential("t"))
    lab = chem(spark, ("s", "DOC", 2.0), ("s", "DOC", None), ("s", "Fe", None),
               ("s", "Fe", 0.1), ("t", "DOC", None))
    for mode in ("mean", "cross"):
        got = one(metrics.corrected_metrics(readings, lab, replicates=mode))
        assert (got["sampleID"], got["DOC"], got["Fe"]) == ("s", 2.0, 0.1)


def reference_rows(readings, doc, iron):
    """Corrected and raw metric rows by nested loops over plain lists."""
    mean = {}
    for s, w, a in readings:
        mean.setdefault((s, w), []).append(a)
    mean = {k: None if None in v else sum(v) / len(v) for k, v in mean.items()}
    rows = []
    for sample in sorted({s for s, _ in mean}):
        values = {w: a for (s, w), a in mean.items() if s == sample and a is not None}
        docs = [d for s, d in doc if s == sample]
        irons = [f for s, f in iron if s == sample]
        full = [(w, a, d) for w, a in values.items() for d in docs if (a, d) != (0, 0)]

        def div(a, b):
            return a / b if b else math.copysign(math.inf, a)

        def at(w0):
            return [(a, d) for w, a, d in full if w == w0]

        def slope(points):
            points = [(w, math.log(v)) for w, v in points if 0 < v < math.inf]
            if len({w for w, _ in points}) < 2:
                return None
            mx = sum(w for w, _ in points) / len(points)
            my = sum(y for _, y in points) / len(points)
            return -sum((w - mx) * (y - my) for w, y in points) / sum(
                (w - mx) ** 2 for w, _ in points)

        def ratio(points, low=lambda w: 275 <= w <= 295, high=lambda w: 350 <= w <= 400):
            a = [p for p in points if low(p[0])]
            b = [p for p in points if high(p[0])]
            if not a or not b:
                return []
            x, y = slope(a), slope(b)
            return [None if x is None or y is None else div(x, y)]

        def outer(a, b):
            if not a and not b:
                return []
            return [x + y for x in (a or [(None,) * 2]) for y in (b or [(None,)])]

        s254 = [(d, div(a, d) * 100) for a, d in at(254)]
        s350 = [(div(a, d) * 100,) for a, d in at(350)]
        near = [a for w in (364, 366) for a, _ in at(w)]
        a365 = sum(near) / len(near) if near else None
        e2e3 = [(None if a365 is None else div(a, a365),) for a, _ in at(250)]
        e2e3 = e2e3 or ([(None,)] if near else [])
        sr = [(r,) for r in ratio([(w, div(a, d) * 100) for w, a, d in full])]
        raw = outer(s254, s350)
        for extra in (e2e3, sr):
            width = len(raw[0]) if raw else {0: 3, 1: 4}[[e2e3, sr].index(extra)]
            if raw or extra:
                raw = [x + y for x in (raw or [(None,) * width]) for y in (extra or [(None,)])]
        k = [(w, a, d, f) for w, a, d in full for f in irons]
        c254 = [(f, div(a - 0.0653 * f, d) * 100) for w, a, d, f in k if w == 254]
        c350 = [(div(a - 0.0323 * f, d) * 100,) for w, a, d, f in k if w == 350]
        csr = [(r,) for r in ratio([
            (w, div(a - (0.0570 if w <= 295 else 0.0118) * f, d) * 100)
            for w, a, d, f in k])]
        corrected = outer(c254, c350)
        if corrected or csr:
            corrected = [x + y for x in (corrected or [(None,) * 3]) for y in (csr or [(None,)])]
        for r in raw:
            for c in corrected or [(None,) * 4]:
                rows.append((sample, *r, *c))
    return rows


def comparable(rows):
    def cell(v):
        return "-" if v is None else v if isinstance(v, str) else f"{v:.6g}"
    return sorted(tuple(cell(v) for v in row) for row in rows)


@pytest.mark.parametrize("seed", range(3))
def test_cross_mode_against_nested_loops(spark, seed):
    random.seed(seed)
    pool = [250, 254, 350, 360, 364, 366, 370, 276, 280, 290, 300]
    readings, doc, iron = [], [], []
    for n in range(12):
        sample = f"s{n}"
        for w in random.sample(pool, random.randint(3, len(pool))):
            for _ in range(random.randint(1, 2)):
                absorbance = random.choice([0.3, 0.2, 0.11, 0.05, 0.01])
                readings.append((sample, w, absorbance * random.uniform(0.9, 1.1)))
        doc += [(sample, random.choice([2.0, 3.5, 0.5, -1.0]))
                for _ in range(random.randint(0, 2))]
        iron += [(sample, random.choice([0.1, 0.4, 0.0])) for _ in range(random.randint(0, 2))]
    lab = chem(spark, *((s, "DOC", d) for s, d in doc), *((s, "Fe", f) for s, f in iron))
    got = metrics.corrected_metrics(scan(spark, readings), lab, replicates="cross")
    values = [
        (r.sampleID, r.DOC, r.rawSUVA254, r.rawSUVA350, r.E2E3, r.rawSR, r.Fe,
         r.correctedSUVA254, r.correctedSUVA350, r.correctedSR) for r in got.collect()
    ]
    assert comparable(values) == comparable(reference_rows(readings, doc, iron))
    raw = metrics.sample_metrics(scan(spark, readings), lab, replicates="cross")
    only_raw = [(r.sampleID, r.DOC, r.SUVA254, r.SUVA350, r.E2E3, r.SR) for r in raw.collect()]
    expected = reference_rows(readings, doc, [])
    assert comparable(only_raw) == comparable(r[:6] for r in expected)


def test_iron_coefficients(spark):
    lab = chem(spark, ("s", "DOC", 2.0), ("s", "Fe", 0.1))
    readings = exponential("s", factor=10.0)
    got = one(metrics.corrected_metrics(scan(spark, readings), lab))
    a = {w: v for _, w, v in readings}
    assert got["correctedSUVA254"] == pytest.approx((a[254] - 0.00653) / 2 * 100)
    assert got["correctedSUVA350"] == pytest.approx((a[350] - 0.00323) / 2 * 100)
    bands = [("x", w, a[w] - 0.1 * (0.0570 if w <= 295 else 0.0118)) for w in a
             if 275 <= w <= 295 or w >= 350]
    spectrum = suva_spectrum(scan(spark, bands), chem(spark, ("x", "DOC", 2.0)))
    assert got["correctedSR"] == pytest.approx(one(slope_ratio(spectrum, ["sampleID"]))["Sr"])


def test_iron_edge_cases(spark):
    lab = chem(spark, ("none", "DOC", 2.0), ("zero", "DOC", 2.0), ("zero", "Fe", 0.0),
               ("neg", "DOC", 1.0), ("neg", "Fe", 1.0))
    readings = exponential("none") + exponential("zero") + [
        ("neg", 276, 0.01), ("neg", 280, 0.2), ("neg", 290, 0.1), ("neg", 360, 0.3),
        ("neg", 370, 0.2)]
    got = {r.sampleID: r for r in metrics.corrected_metrics(scan(spark, readings), lab).collect()}
    assert got["none"].rawSR == pytest.approx(1.0)
    assert got["none"].correctedSR is None and got["none"].Fe is None
    assert got["zero"].correctedSUVA254 == pytest.approx(got["zero"].rawSUVA254)
    assert got["zero"].correctedSR == pytest.approx(got["zero"].rawSR)
    low = math.log((0.2 - 0.057) / (0.1 - 0.057)) / 10
    high = math.log((0.3 - 0.0118) / (0.2 - 0.0118)) / 10
    assert got["neg"].correctedSR == pytest.approx(low / high)
    alone = metrics.corrected_metrics(scan(spark, readings), lab, with_raw=False)
    assert {r.sampleID for r in alone.collect()} == {"zero", "neg"}


def test_corrected_alone_has_no_empty_rows(spark):
    readings = [("only250", 250.0, 0.2), ("only364", 364.0, 0.2), ("at254", 254.0, 0.2), ("at350", 350.0, 0.2)]
    lab = chem(spark, *((s, a, 2.0) for s, _, _ in readings for a in ("DOC", "Fe")))
    alone = metrics.corrected_metrics(scan(spark, readings), lab, with_raw=False)
    assert {r.sampleID for r in alone.collect()} == {"at254", "at350"}
    assert metrics.corrected_metrics(scan(spark, readings), lab).count() == 4


def test_separate_tables_give_the_fused_result(spark):
    readings = scan(spark, exponential("s") + exponential("t", 0.01))
    lab = chem(spark, ("s", "DOC", 2.0), ("t", "DOC", 1.0), ("t", "Fe", 0.01))
    merged = metrics.raw_vs_corrected(
        metrics.sample_metrics(readings, lab),
        metrics.corrected_metrics(readings, lab, with_raw=False))
    fused = metrics.corrected_metrics(readings, lab)
    assert merged.columns == fused.columns

    def rows(df):
        return comparable((str(v) if hasattr(v, "year") else v for v in r) for r in df.collect())

    assert rows(merged) == rows(fused)


def test_slope_ratio_invariants(spark):
    random.seed(7)
    noisy = [(s, w, a * random.uniform(0.8, 1.2)) for s, w, a in exponential("s")]
    double = noisy + [(s, w, a * 1.1) for s, w, a in noisy]

    def ratio(readings, *doc, parts=1):
        lab = chem(spark, *(("s", "DOC", d) for d in doc))
        df = scan(spark, readings).repartition(parts)
        return one(metrics.sample_metrics(df, lab))["SR"]

    base = ratio(double, 2.0)
    assert ratio(double, 20.0) == pytest.approx(base)
    assert ratio(double[::-1], 2.0, parts=7) == pytest.approx(base)
    assert ratio(double, 1.0, 5.0) == pytest.approx(base)


def test_site_statistics(spark):
    rows = [("a", "X", 1.0, 2.0, 3.0, 4.0), ("b", "X", 3.0, 4.0, None, 6.0),
            ("c", "Y", 1.0, 1.0, 1.0, 1.0), ("d", None, None, None, 2.0, 1.0)]
    df = spark.createDataFrame(
        rows, "sampleID string, siteID string, DOC double, SUVA254 double, "
              "SUVA350 double, SR double")
    got = {r.siteID: r for r in metrics.site_statistics(df).collect()}
    assert got["X"].nSamples == 2 and got["X"].meanDOC == 2.0
    assert got["X"].sdDOC == pytest.approx(math.sqrt(2))
    assert got["X"].meanSUVA350 is None and got["X"].sdSUVA350 is None
    assert got["Y"].meanSR == 1.0 and got["Y"].sdSR is None
    assert got[None].nSamples == 1 and got[None].meanDOC is None


def test_hot_sample(spark):
    """One sample with most of the readings gives the same result."""
    many = [(s, w, a) for s, w, a in exponential("hot") for _ in range(50)]
    others = list(itertools.chain.from_iterable(exponential(f"s{n}") for n in range(10)))
    lab = chem(spark, ("hot", "DOC", 1.0), *((f"s{n}", "DOC", 1.0) for n in range(10)))
    rows = metrics.sample_metrics(scan(spark, many + others), lab).collect()
    assert len(rows) == 11 and all(r.SR == pytest.approx(1.0) for r in rows)


def test_plans_stay_in_the_jvm(spark):
    text = plan(metrics.corrected_metrics(
        scan(spark, exponential("s")), chem(spark, ("s", "DOC", 1.0))))
    for operator in ("EvalPython", "InPandas", "InArrow"):
        assert operator not in text


def test_clustered_tables_need_no_shuffle(spark):
    readings = scan(spark, exponential("s") + exponential("t"))
    lab = chem(spark, ("s", "DOC", 1.0), ("t", "DOC", 2.0), ("t", "Fe", 0.1))
    sinks.write_clustered(readings, "clustered_scan", ["sampleID"], 4, mode="overwrite")
    sinks.write_clustered(lab, "clustered_lab", ["sampleID"], 4, mode="overwrite")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = metrics.corrected_metrics(
            spark.table("clustered_scan"), spark.table("clustered_lab"))
        assert df.count() == 2
        assert "Exchange" not in plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_sample_in_clustered_tables(spark):
    """A sample with most of the readings: no bucket beyond its share, the same metrics."""
    many = [r for r in exponential("hot") for _ in range(40)]
    others = list(itertools.chain.from_iterable(exponential(f"s{n}") for n in range(12)))
    readings = scan(spark, many + others)
    lab = chem(spark, ("hot", "DOC", 1.0), *((f"s{n}", "DOC", 1.0 + n) for n in range(12)))
    buckets = 8
    sinks.write_clustered(readings, "salted_scan", ["sampleID"], buckets, mode="overwrite", most_rows=100)
    sinks.write_clustered(lab, "salted_lab", ["sampleID"], buckets, mode="overwrite", most_rows=100)
    main, hot = sinks.read_clustered(spark, "salted_scan")
    assert {r.sampleID for r in hot.select("sampleID").distinct().collect()} == {"hot"}
    share = (len(many) + len(others)) / buckets
    for part in (spark.table("salted_scan"), spark.table("salted_scan_hot")):
        sizes = [r["count"] for r in part.groupBy(F.input_file_name()).count().collect()]
        assert max(sizes) <= 2 * share
    # equal readings are dealt out as well
    assert spark.table("salted_scan_hot").select("_salt").distinct().count() > 4
    [lab_part] = sinks.read_clustered(spark, "salted_lab")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan(metrics.sample_metrics(main, lab_part))
        got = sinks.per_cluster([main, hot], lambda part: metrics.sample_metrics(part, lab_part)).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    expected = {r.sampleID: r for r in metrics.sample_metrics(readings, lab).collect()}
    assert len(got) == len(expected) == 13
    for row in got:
        for value, known in zip(row, expected[row.sampleID]):
            assert value == (pytest.approx(known, rel=1e-12) if isinstance(known, float) else known)
    # written again without a hot sample, the second table goes
    sinks.write_clustered(scan(spark, others), "salted_scan", ["sampleID"], buckets, mode="overwrite", most_rows=100)
    assert len(sinks.read_clustered(spark, "salted_scan")) == 1


def test_dates_may_differ_between_samples(spark):
    a = scan(spark, exponential("s"))
    b = scan(spark, exponential("t"), site="B", day=DAY + timedelta(days=3))
    lab = chem(spark, ("s", "DOC", 1.0), ("t", "DOC", 1.0))
    got = {r.sampleID: r for r in metrics.sample_metrics(a.union(b), lab).collect()}
    assert got["t"].siteID == "B" and got["t"].collectDate == DAY + timedelta(days=3)




def test_shuffles_of_the_metrics(spark):
    """Averages, spectrum by sample, analyses by sample; nothing after the join."""
    readings = scan(spark, exponential("s"))
    lab = chem(spark, ("s", "DOC", 1.0), ("s", "Fe", 0.1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(metrics.corrected_metrics(readings, lab))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tree = text.split("\n\n")[0]
    assert tree.count("Exchange") == 3
    above_join = tree.split("SortMergeJoin")[0]
    assert "Exchange" not in above_join


@pytest.mark.parametrize("name, columns, kept", [
    ("site_filter", ["sampleID", "siteID", "SR"], lambda r: r["siteID"] in ("N2", "N5")),
    ("month_range_filter", None, lambda r: datetime(2023, 11, 1) <= r["collectDate"] < datetime(2024, 2, 1)),
])
def test_source_filters_take_finished_metrics(spark, monkeypatch, name, columns, kept):
    """The registered queries compute the metrics of all samples and keep whole rows of them."""
    days = {"a": ("N2", 10, 31), "b": ("N5", 11, 1), "c": ("N3", 1, 31), "d": (None, 2, 1)}
    readings = [scan(spark, exponential(s, 0.01 + 0.001 * k), site, datetime(2024 if month < 3 else 2023, month, day))
                for k, (s, (site, month, day)) in enumerate(days.items())]
    lab = chem(spark, *((s, "DOC", 2.0) for s in days))
    tables = lambda s, d, water=None: (functools.reduce(DataFrame.union, readings), lab)
    monkeypatch.setattr(entry, "_inputs", tables)
    monkeypatch.setattr(entry.given, "scan", lambda *_: tables(*_)[0])
    metrics_ = entry.QUERIES["sample_metrics"](spark, "")
    found = entry.QUERIES[name](spark, "")
    names = columns or metrics_.columns
    assert found.columns == names
    rows = [r for r in metrics_.collect() if kept(r)]
    assert len(rows) == 2
    assert sorted(map(str, found.collect())) == sorted(str(Row(**{c: r[c] for c in names})) for r in rows)

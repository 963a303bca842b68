import gzip
from datetime import datetime, timedelta

import pytest

from helpers import DAY, chem, exponential, one, plan, scan
from tannin.functions.parsing import parse_timestamp
from tannin.operators.spectra import suva_spectrum
from tannin.plans import doc_fdom
from tannin.sources import schemas, sinks, tables
from tannin.streaming.sensor import fdom_stream, write_fdom_stream

NAME = "swc_externalLabAbsorbanceScan"


def product(spark, root, fmt="parquet"):
    rows = [
        ("s", "D", "A", datetime(2024, 1, 31, 23, 59, 59), 254.0, 0.1, "RELEASE"),
        ("t", "D", "A", datetime(2024, 2, 1), 254.0, 0.1, "PROVISIONAL"),
        ("u", "D", "B", datetime(2024, 3, 31, 23, 59, 59), 254.0, None, None),
        ("v", "D", "C", datetime(2024, 4, 1), 254.0, 0.1, "RELEASE"),
    ]
    df = spark.createDataFrame(rows, schemas.ABSORBANCE_SCAN)
    sinks.write_table(df, f"{root}/{NAME}", fmt=fmt)


def samples(spark, root, **options):
    df = tables.read_product(spark, str(root), [NAME], **options)[NAME]
    return {r.sampleID for r in df.collect()}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_product_filters(spark, tmp_path, fmt):
    product(spark, tmp_path, fmt)
    assert samples(spark, tmp_path, fmt=fmt) == set("stuv")
    assert samples(spark, tmp_path, fmt=fmt, sites="A") == set("st")
    assert samples(spark, tmp_path, fmt=fmt, sites=["B", "C"]) == set("uv")
    assert samples(spark, tmp_path, fmt=fmt, start="2024-02", end="2024-03") == set("tu")
    assert samples(spark, tmp_path, fmt=fmt, end="2023-12") == set()
    assert samples(spark, tmp_path, fmt=fmt, include_provisional=False) == set("suv")
    df = tables.read_product(spark, str(tmp_path), [NAME], fmt=fmt)[NAME]
    assert df.schema == schemas.ABSORBANCE_SCAN
    assert df.where("decadicAbsorbance is null").count() == 1


def test_product_filters_reach_the_scan(spark, tmp_path):
    product(spark, tmp_path)
    df = tables.read_product(spark, str(tmp_path), [NAME], sites=["A"], start="2024-02",
                             end="2024-12")[NAME]
    text = plan(df)
    for part in ("siteID", "GreaterThanOrEqual(collectDate,", "LessThan(collectDate,"):
        assert part in text.split("PushedFilters")[1].splitlines()[0]


def test_unknown_table(spark, tmp_path):
    with pytest.raises(ValueError, match="no schema"):
        tables.read_product(spark, str(tmp_path), ["swc_other"])


def test_pattern_and_views(spark):
    named = {"gwc_a": chem(spark, ("s", "DOC", 1.0)), "gwc_b": chem(spark)}
    assert tables.table_by_pattern(named, "a$") is named["gwc_a"]
    for pattern in ("gwc", "zzz"):
        with pytest.raises(ValueError):
            tables.table_by_pattern(named, pattern)
    tables.register_tables(named)
    assert spark.table("gwc_a").count() == 1


def test_csv_folder_is_stacked_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        '"","siteID","collectDate","wavelength","absorbance","DOC","SUVA"\n'
        '"1","A","2024-05-01 10:00:00",254,0.1,2,5\n"2","A","2024-05-01",256,NA,2,Inf\n')
    (tmp_path / "b.csv").write_text(
        '"","SUVA","DOC","absorbance","wavelength","collectDate","siteID"\n'
        '"1",7,3,0.21,258,"2024-05-02 10:00:00","B"\n')
    df = tables.read_csv_dir(spark, str(tmp_path), schemas.SUVA_SPECTRUM)
    assert df.schema == schemas.SUVA_SPECTRUM
    got = {r.wavelength: r for r in df.select("*", parse_timestamp("collectDate").alias("t")).collect()}
    assert (got[258.0].siteID, got[258.0].SUVA, got[258.0].DOC) == ("B", 7.0, 3.0)
    assert got[256.0].absorbance is None and got[256.0].SUVA == float("inf")
    assert got[254.0].t == datetime(2024, 5, 1, 10) and got[256.0].t is None


def test_equal_headers_are_checked(spark, tmp_path):
    rest = "collectDate,wavelength,absorbance,DOC"
    for name, header in (("a", f"siteID,SUVA,{rest}\nA,1,x,1,1,1\n"), ("b", f"SUVA,siteID,{rest}\n1,B,x,1,1,1\n")):
        (tmp_path / f"{name}.csv").write_text(header)
    # Spark's reader would raise on the folder as one scan; by header both files are read
    found = tables.read_csv_dir(spark, [str(tmp_path)], schemas.SUVA_SPECTRUM).collect()
    assert {(r.siteID, r.SUVA) for r in found} == {("A", 1.0), ("B", 1.0)}
    with pytest.raises(ValueError, match="no CSV"):
        tables.read_csv_dir(spark, [], schemas.SUVA_SPECTRUM)


def test_headers_are_found_in_one_pass(spark, tmp_path):
    columns = "siteID,collectDate,wavelength,absorbance,DOC,SUVA".split(",")

    def write(folder, files):
        folder.mkdir()
        for i in range(files):
            order = columns if i % 2 else columns[::-1]
            row = dict(zip(columns, (f"S{i}", "x", "254", "0.1", "2", str(i))))
            # a blank line before the header, and a data line that holds all names
            (folder / f"a {i}.csv").write_text(
                "\n" * (i % 3 == 0) + ",".join(order) + "\n" + ",".join(row[c] for c in order) + "\n")
        (folder / "empty.csv").write_text("")
        return str(folder)

    def jobs(path):
        context = spark.sparkContext
        group = f"read {path}"
        context.setJobGroup(group, group)
        found = tables.read_csv_dir(spark, path, schemas.SUVA_SPECTRUM)
        started = len(context.statusTracker().getJobIdsForGroup(group))
        context.setLocalProperty("spark.jobGroup.id", None)
        return started, {(r.siteID, r.SUVA) for r in found.collect()}

    few, many = jobs(write(tmp_path / "few", 4)), jobs(write(tmp_path / "many", 24))
    assert few[1] == {(f"S{i}", float(i)) for i in range(4)} and len(many[1]) == 24
    assert few[0] == many[0] > 0
    (tmp_path / "few" / "bad.csv").write_text("siteID,SUVA\nA,1\n")
    with pytest.raises(ValueError, match="collectDate"):
        tables.read_csv_dir(spark, str(tmp_path / "few"), schemas.SUVA_SPECTRUM)


def test_every_file_of_a_folder_is_read(spark, tmp_path):
    text = "siteID,collectDate,wavelength,absorbance,DOC,SUVA\n{},x,254,0.1,2,5\n"
    for site, name in zip("ABCD", ("a.csv", "b.CSV", "c", "d.txt")):
        (tmp_path / name).write_text(text.format(site))
    (tmp_path / "e.csv.gz").write_bytes(gzip.compress(text.format("E").encode()))
    read = tables.read_csv_dir(spark, str(tmp_path), schemas.SUVA_SPECTRUM)
    assert {r.siteID for r in read.collect()} == set("ABCDE")
    some = tables.read_csv_dir(spark, str(tmp_path), schemas.SUVA_SPECTRUM, pattern="*.csv")
    assert {r.siteID for r in some.collect()} == {"A"}


def test_absent_columns_and_wrong_values_raise(spark, tmp_path):
    product(spark, tmp_path)
    path = str(tmp_path / NAME)
    rows = spark.read.parquet(path)
    for column, options, error in (
        ("decadicAbsorbance", {}, "decadicAbsorbance"), ("release", {"include_provisional": False}, "release")):
        root = str(tmp_path / column)
        sinks.write_table(rows.drop(column), f"{root}/{NAME}", fmt="parquet")
        with pytest.raises(ValueError, match=error):
            tables.read_product(spark, root, [NAME], **options)
    assert tables.read_product(spark, str(tmp_path / "release"), [NAME])[NAME].count() == 4
    (tmp_path / "bad.csv").write_text(
        "siteID,collectDate,wavelength,absorbance,DOC,SUVA\nA,x,254,0.1,two,5\nB,x,254,NA,,5\n")
    bad = tables.read_csv_dir(spark, [str(tmp_path / "bad.csv")], schemas.SUVA_SPECTRUM)
    assert bad.where("siteID = 'B' and absorbance is null and DOC is null").select("siteID").count() == 1
    with pytest.raises(Exception, match="DOC is not double: two"):
        bad.collect()


def test_clustered_files(spark, tmp_path):
    sinks.write_clustered(spark.range(0, 1000, 1, 8), "clustered_ids", ["id"], 4)
    assert len(set(spark.table("clustered_ids").inputFiles())) == 4
    assert spark.table("clustered_ids").count() == 1000
    spark.sql("drop table clustered_ids")


def test_sites_file(spark, tmp_path):
    path = tmp_path / "sites.csv"
    path.write_text("extra,site_type,site_id,latitude\n1,Core Aquatic,A,12.5\n2,NA,B,NA\n")
    got = {r.site_id: r for r in tables.read_sites(spark, str(path)).collect()}
    assert got["A"].latitude == 12.5 and got["B"].site_type is None
    assert got["A"].lake_depth_mean_m is None


@pytest.mark.parametrize("options", [
    {"partition_by": ["siteID"]}, {"order_by": ["wavelength"]}, {},
    {"partition_by": ["siteID"], "order_by": ["wavelength"]},
])
def test_written_rows_come_back(spark, tmp_path, options):
    spectrum = suva_spectrum(scan(spark, exponential("s")), chem(spark, ("s", "DOC", 2.0)))
    path = str(tmp_path / "out")
    sinks.write_table(spectrum, path, fmt="parquet", **options)
    back = spark.read.parquet(path).select(*spectrum.columns)
    assert back.exceptAll(spectrum).isEmpty() and back.count() == spectrum.count()
    with pytest.raises(Exception, match="exists"):
        sinks.write_table(spectrum, path, fmt="parquet")


def test_csv_output_keeps_infinity_and_fraction(spark, tmp_path):
    moment = datetime(2024, 5, 1, 1, 2, 3, 250000)
    df = spark.createDataFrame([("A", moment, float("inf")), (None, None, None)],
                               "siteID string, collectDate timestamp, SUVA double")
    sinks.write_table(df, str(tmp_path / "out"))
    back = tables.read_csv_dir(spark, [str(tmp_path / "out")], schemas.SUVA_SPECTRUM,
                               optional=("wavelength", "absorbance", "DOC"))
    row = back.where("siteID = 'A'").select("*", parse_timestamp("collectDate").alias("t")).first()
    assert row.SUVA == float("inf") and row.t == moment
    assert back.where("siteID is null and collectDate is null and SUVA is null").count() == 1


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert sinks.scratch_path(spark, "x").startswith(configured)
    stored = sinks.materialize(spark.range(3))
    assert stored.count() == 3 and "Scan ExistingRDD" in plan(stored)


# --- pairing ----------------------------------------------------------------

GRAB = ("collectDate timestamp, siteID string, domainID string, analyte string, "
        "analyteConcentration double")
SENSOR = ("startDateTime timestamp, siteID string, horizontalPosition string, "
          "rawCalibratedfDOM double")


def grab(seconds, value, site="A", analyte="DOC"):
    return DAY + timedelta(seconds=seconds), site, "D", analyte, value


def reading(seconds, value, site="A", position="102"):
    return DAY + timedelta(seconds=seconds), site, position, value


@pytest.mark.parametrize("bound", ["10m", "-1"])
def test_pairing(spark, bound):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    try:
        check_pairing(spark)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def check_pairing(spark):
    lab = spark.createDataFrame([
        grab(10, 1.0), grab(10, 3.0), grab(20, 5.0), grab(700, 7.0), grab(1200, 8.0),
        grab(1200, None), (None, "A", "D", "DOC", 4.0), grab(10, 9.0, analyte="Fe"), grab(10, 6.0, site="B")], GRAB)
    sensor = spark.createDataFrame([
        reading(0, 10.0), reading(149, 20.0, position="112"), reading(150, 99.0),
        (None, "A", "102", 1.0), reading(5, 50.0, position="101"), reading(600, 1.0), reading(610, None)], SENSOR)
    got = doc_fdom.pair_doc_fdom(lab, sensor)
    assert got.columns == ["collectDate", "domainID", "siteID", "DOC", "fDOM"]
    rows = sorted(((r.siteID, (r.collectDate - DAY).seconds, r.DOC, r.fDOM)
                   for r in got.collect() if r.collectDate), key=str)
    assert one(got.where("collectDate is null"))["DOC"] == 4.0
    assert rows == [
        ("A", 0, 2.0, 15.0), ("A", 0, 5.0, 15.0), ("A", 1200, None, None),
        ("A", 600, 7.0, None), ("B", 0, 6.0, None),
    ]
    single = doc_fdom.pair_doc_fdom(lab.where("siteID = 'A'"), sensor.drop("siteID"), by=())
    assert single.count() == 5


def test_pairing_fit(spark):
    pairs = spark.createDataFrame(
        [(float(x), 2.0 * x + 1) for x in range(5)] + [(None, 3.0)], "fDOM double, DOC double")
    got = one(doc_fdom.doc_fdom_fit(pairs))
    assert got["n"] == 5 and got["slope"] == pytest.approx(2.0)
    assert got["residual_max"] == pytest.approx(0.0, abs=1e-9)


def test_stream_equals_batch_for_closed_buckets(spark, tmp_path):
    rows = [reading(30 * i, float(i % 7), site="AB"[i % 2]) for i in range(200)]
    source = str(tmp_path / "in")
    batch = spark.createDataFrame(rows, SENSOR)
    batch.coalesce(1).write.parquet(source)
    stream = fdom_stream(spark.readStream.schema(batch.schema).parquet(source))
    out = str(tmp_path / "out")
    query = write_fdom_stream(stream, out, str(tmp_path / "state"), availableNow=True)
    assert query.awaitTermination(120)
    got = {(r.startDateTime, r.siteID): r.fDOM for r in spark.read.parquet(out).collect()}
    whole = {(r.startDateTime, r.siteID): r.fDOM for r in doc_fdom.fdom_5min(batch).collect()}
    watermark = max(r[0] for r in rows) - timedelta(minutes=10)
    closed = {k: v for k, v in whole.items() if k[0] + timedelta(seconds=150) <= watermark}
    assert closed and got == closed


def test_pairing_shuffles_only_matching_readings(spark):
    lab = spark.createDataFrame([grab(10, 1.0)], GRAB)
    sensor = spark.createDataFrame([reading(0, 1.0), reading(9000, 2.0)], SENSOR)
    tree = plan(doc_fdom.pair_doc_fdom(lab, sensor)).split("\n\n")[0]
    # below the semi join, which Spark has moved under the average, the readings are only filtered
    semi = tree.index("BroadcastHashJoin LeftSemi")
    assert "HashAggregate" in tree[:semi]
    readings_side = tree[semi:].splitlines()[1:5]
    assert not any(line.lstrip(" :").startswith("+- Exchange") for line in readings_side)
    # without a broadcast the readings are averaged first, and only means are shuffled again
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tree = plan(doc_fdom.pair_doc_fdom(lab, sensor)).split("\n\n")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "HashAggregate" in tree[tree.index("LeftSemi"):]
    assert "Generate" not in tree

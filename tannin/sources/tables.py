"""Readers and filters for product tables, site metadata and CSV folders."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable, Mapping
from datetime import datetime
from functools import reduce
from operator import and_
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tannin.sources import schemas

ALL_SITES = "all"
PROVISIONAL = "PROVISIONAL"


def _typed(
    df: DataFrame, schema: T.StructType, optional: Collection[str] = ()
) -> DataFrame:
    """Pick the schema's columns by name.

    Absent ones are NULL if they are ``optional`` and raise ValueError if not;
    a value that is not of the column's type raises when it is read.  A time
    column without zone stays as it is: a cast would only keep filters from
    reaching the scan.
    """
    present = {f.name: f.dataType for f in df.schema.fields}
    absent = [n for n in schema.names if n not in present and n not in optional]
    if absent:
        raise ValueError(f"columns {absent} are not in the header, which has {df.columns}")

    def pick(field: T.StructField) -> Column:
        name, kind = field.name, field.dataType
        if name not in present:
            return F.lit(None).cast(kind).alias(name)
        column = F.col(f"`{name}`")
        kept = isinstance(present[name], T.TimestampNTZType) and isinstance(
            kind, T.TimestampType
        )
        if kept or present[name] == kind:
            return column.alias(name)
        cast = column.try_cast(kind)
        wrong = F.raise_error(F.concat(
            F.lit(f"{name} is not {kind.simpleString()}: "), column.cast("string")
        )).cast(kind)
        return F.when(column.isNull() | cast.isNotNull(), cast).otherwise(wrong).alias(name)

    return df.select(*(pick(f) for f in schema.fields))


def _csv_reader(spark: SparkSession) -> DataFrameReader:
    # enforceSchema off: every file's header is checked against the columns
    return (
        spark.read.option("header", True).option("nullValue", "NA")
        .option("enforceSchema", False)
    )


def _read_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _csv_reader(spark).csv(paths)


def site_filter(
    df: DataFrame, sites: str | Iterable[str] = ALL_SITES, column: str = "siteID"
) -> DataFrame:
    """Rows of one site or several; ``"all"`` keeps every row."""
    if sites == ALL_SITES:
        return df
    wanted = [sites] if isinstance(sites, str) else list(sites)
    return df.where(F.col(column).isin(wanted))


def _month(text: str, following: int = 0) -> datetime:
    first = datetime.strptime(text, "%Y-%m")
    months = first.year * 12 + first.month - 1 + following
    return datetime(months // 12, months % 12 + 1, 1)


def month_range_filter(
    df: DataFrame, start: str | None, end: str | None, column: str
) -> DataFrame:
    """Rows from month ``start`` to month ``end`` ("YYYY-MM"), both included.

    Compares the bare column with constants of its own type, so the bounds
    reach the scan and prune partitions and row groups.
    """
    def bound(moment: datetime) -> Column:
        return F.lit(moment.isoformat(sep=" ")).cast(df.schema[column].dataType)

    if start is not None:
        df = df.where(F.col(column) >= bound(_month(start)))
    if end is not None:
        df = df.where(F.col(column) < bound(_month(end, following=1)))
    return df


def read_product(
    spark: SparkSession,
    root: str,
    tables: Iterable[str],
    sites: str | Iterable[str] = ALL_SITES,
    start: str | None = None,
    end: str | None = None,
    include_provisional: bool = True,
    fmt: str = "parquet",
) -> dict[str, DataFrame]:
    """The named tables under ``root``, one folder or file each.

    Site and month restrictions are plain predicates: with a layout that is
    partitioned by site or date they prune folders.  Of the columns only
    ``release`` may be absent, and leaving out provisional rows needs it;
    rows without a release stay.
    """
    found = {}
    for name in tables:
        schema, date_column = _schema_of(name)
        path = f"{root.rstrip('/')}/{name}"
        if fmt == "csv":
            df = _read_csv(spark, path)
        else:
            df = spark.read.format(fmt).load(path)
        if not include_provisional and "release" not in df.columns:
            raise ValueError(f"{name} has no column release to tell provisional rows by")
        df = _typed(df, schema, optional=("release",))
        df = site_filter(df, sites)
        df = month_range_filter(df, start, end, date_column)
        if not include_provisional:
            df = df.where(
                F.col("release").isNull() | (F.col("release") != PROVISIONAL)
            )
        found[name] = df
    return found


def _schema_of(name: str) -> tuple[T.StructType, str]:
    for suffix, entry in schemas.PRODUCT_TABLES.items():
        if name.endswith(suffix):
            return entry
    raise ValueError(f"no schema known for table {name!r}")


def table_by_pattern(tables: Mapping[str, DataFrame], pattern: str) -> DataFrame:
    """The one table whose name matches ``pattern`` anywhere."""
    names = [n for n in tables if re.search(pattern, n)]
    if len(names) != 1:
        raise ValueError(f"{pattern!r} matches {names or 'no table'}, expected one")
    return tables[names[0]]


def register_tables(tables: Mapping[str, DataFrame]) -> None:
    """Make every table available to SQL under its own name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Site metadata from a CSV file with a header; only ``site_id`` must be there."""
    optional = [n for n in schemas.SITES.names if n != "site_id"]
    return _typed(_read_csv(spark, path), schemas.SITES, optional)


def read_result(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A result table that ``write_table`` has written as CSV, with its types."""
    return _typed(_read_csv(spark, path), schema)


def read_csv_dir(
    spark: SparkSession,
    paths: str | Iterable[str],
    schema: T.StructType,
    pattern: str = "*",
    optional: Collection[str] = (),
) -> DataFrame:
    """Stack CSV files by column name; row-name columns are left out.

    ``paths`` is a folder, or a list of files and folders.  All files in them
    are read, whatever their names, but for those that Spark takes for hidden
    (a leading dot or underscore) and empty ones; ``pattern`` may ask for
    fewer.  Every column of the schema but the ``optional`` ones must be in
    every header.

    Spark matches CSV columns by position, so files whose headers differ must
    not share a scan.  One distributed pass finds the header of every file,
    and files with equal headers are read together: the number of jobs grows
    with the number of different headers, not with that of files.
    """
    entries = [paths] if isinstance(paths, str) else list(paths)
    if not entries:
        raise ValueError(f"no CSV file in {paths!r}")
    required = [n for n in schema.names if n not in optional]
    lines = _all_files(spark.read, pattern).text(entries)
    headers = _headers(lines, required)
    # a row per different header; Spark's own list of the files is on the driver as well
    groups = headers.groupBy("header").agg(F.collect_list("path").alias("paths")).collect()
    found = {path for group in groups for path in group["paths"]}
    _without_lines(lines.where(~F.col("_metadata.file_path").isin(list(found)))
                   if len(found) < len(lines.inputFiles()) else None, schema, optional)
    if not groups:
        raise ValueError(f"no CSV file in {paths!r}")
    if len(groups) == 1:
        return _typed(_all_files(_csv_reader(spark), pattern).csv(entries), schema, optional)
    parts = [_typed(_read_csv(spark, sorted(map(unquote, g["paths"]))), schema, optional) for g in groups]
    return reduce(DataFrame.unionByName, parts)


def _all_files(reader: DataFrameReader, pattern: str) -> DataFrameReader:
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)


def _headers(lines: DataFrame, required: list[str]) -> DataFrame:
    """The header line of every file that has one: path, header.

    It is the first line of a file that is not blank.  Only lines that hold
    all required names are looked at, which few others do, and only those in
    the first block of a file.
    """
    named = reduce(and_, (F.col("value").contains(n) for n in required), F.trim("value") != "")
    placed = lines.select(
        "value", F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        # ascending within a block, which one task reads
        F.monotonically_increasing_id().alias("line"),
    )
    return placed.where((F.col("start") == 0) & named).groupBy("path").agg(
        F.min_by("value", "line").alias("header")
    )


def _without_lines(others: DataFrame | None, schema: T.StructType, optional: Collection[str]) -> None:
    """Raise if one of these files, in which no header was found, has a line."""
    first = None if others is None else others.where(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("path")).first()
    if first is not None:
        _typed(_read_csv(others.sparkSession, unquote(first["path"])), schema, optional)
        raise ValueError(f"no header in {first['path']}")

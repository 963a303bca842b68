"""Writers and intermediate storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tannin.operators.merging import merge_tables

CSV_TIME = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    mode: str = "error",
    partition_by: Iterable[str] = (),
    order_by: Iterable[str] = (),
) -> None:
    """Write a result table, with a header for CSV and without row names.

    ``partition_by`` lays out one folder per value; rows are rebalanced on
    those columns first, which keeps files few and splits an oversized value
    over several tasks.  ``order_by`` sorts the whole output by range.
    """
    partition_by, order_by = list(partition_by), list(order_by)
    if order_by:
        df = df.orderBy(*partition_by, *order_by)
    elif partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).option("nullValue", "NA") \
            .option("timestampFormat", CSV_TIME).option("timestampNTZFormat", CSV_TIME)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_clustered(
    df: DataFrame, table: str, keys: Iterable[str], buckets: int, mode: str = "error",
    most_rows: int = 1_000_000,
) -> None:
    """Store a table bucketed and sorted by ``keys``; hot keys apart, in salted buckets.

    Scans and analyte tables stored this way by ``sampleID`` are averaged,
    joined and summarised per sample without any shuffle.  All rows of one key
    lie in one bucket, so a key with more rows than a bucket's share makes one
    task as large as itself.  If these are more than ``most_rows`` too, they
    go to a second table, bucketed by the keys and a salt that deals them out
    evenly: whatever is computed per key is there combined per task, and the
    partial results are merged after a shuffle.  ``read_clustered`` gives
    both, ``per_cluster`` computes on both.
    """
    keys = list(keys)
    spark = df.sparkSession
    stored = store(df, "clustered")
    share = max(1, -(-stored.count() // buckets))
    counts = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # fewer than ``buckets`` rows, since each key holds more than such a part of all
    hot = store(counts.where(F.col("_n") > max(share, most_rows)).withColumnRenamed("_n", "_hot"), "hot")
    marked = merge_tables(stored, F.broadcast(hot), keys, "left", null_safe=True)
    kept = marked.where(F.col("_hot").isNull()).select(*df.columns)
    _write_buckets(kept, table, keys, buckets, mode)
    if hot.isEmpty():
        if mode == "overwrite":
            spark.sql(f"drop table if exists {_hot_table(table)}")
        return
    # a seeded draw, so equal rows are dealt out as well; several salts per share, as some meet in one bucket
    salt = F.floor(F.rand(SALT_SEED) * SALTS * F.ceil(F.col("_hot") / share)).cast("int")
    salted = marked.where(F.col("_hot").isNotNull()).withColumn(SALT, salt).select(*df.columns, SALT)
    _write_buckets(salted, _hot_table(table), [*keys, SALT], buckets, mode)


SALT, SALT_SEED, SALTS = "_salt", 42, 16


def _hot_table(table: str) -> str:
    return f"{table}_hot"


def _write_buckets(df: DataFrame, table: str, keys: list[str], buckets: int, mode: str) -> None:
    # one task per bucket, so one file per bucket
    df.repartition(buckets, *keys).write.format("parquet").mode(mode).bucketBy(buckets, *keys).sortBy(*keys) \
        .saveAsTable(table)


def read_clustered(spark: SparkSession, table: str) -> list[DataFrame]:
    """The parts of a clustered table, each with all rows of its keys: the bucketed one and, if any, the salted one."""
    parts = [spark.table(table)]
    if spark.catalog.tableExists(_hot_table(table)):
        parts.append(spark.table(_hot_table(table)).drop(SALT))
    return parts


def per_cluster(parts: Iterable[DataFrame], query: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A query whose rows each depend on one key only, over all parts of a clustered table."""
    return reduce(DataFrame.unionByName, map(query, parts))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate data.

    Taken from ``spark.checkpoint.dir``.  Only a local session may fall back
    to a temporary folder, since there every task sees the same disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="tannin-")
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for intermediate data under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tannin-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute once, store reliably and go on from the stored rows.

    For inputs that several later passes read: they are not recomputed and
    an executor loss cannot change them between passes.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def store(df: DataFrame, label: str) -> DataFrame:
    """Like ``materialize``, as a Parquet table, whose size in bytes Spark knows.

    For tables that others are joined with: Spark broadcasts one under
    ``spark.sql.autoBroadcastJoinThreshold`` without shuffling the other side first.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Batch table scans."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geomart.session import ensure_checkpoint_dir, scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Scan one Parquet table; naming the columns lets the scan prune the rest."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all partitions of the session, by ``keys``: a small file is a
    single scan task, too few where every row is a lot of work. The rows are
    written once, else a later filter moves below the exchange with all that
    its value takes."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).checkpoint()


def read_parquet_sql(spark: SparkSession, path: str) -> DataFrame:
    """Direct path scan in SQL, as ``SELECT * FROM parquet.`path```."""
    return spark.sql(f"SELECT * FROM parquet.`{path}`")


def write_seed(spark: SparkSession, rows: list[dict], schema, path: str) -> DataFrame:
    """Seed sink (S13): literal rows with a declared schema, fully replaced."""
    df = spark.createDataFrame(rows, schema)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Rows of a bucket of a stored table, on average at most.
BUCKET_ROWS = 2_000_000

_stored: dict[tuple[str, str, str], str] = {}


def stored_by_key(spark: SparkSession, source: str, name: str, key: str, build: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """A derived table of ``source``, written once and read by every later query
    of the application; ``refresh`` writes it anew.

    It is bucketed by ``key`` and sorted within the buckets, so joins on the key
    need no exchange on its side. The files are in the shared folder.
    """
    at = (spark.sparkContext.applicationId, source, name)
    if refresh or at not in _stored or not spark.catalog.tableExists(_stored[at]):
        ensure_checkpoint_dir(spark)
        table = f"geomart_{name}_{uuid.uuid4().hex[:12]}"
        counted = build().checkpoint()
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counted.count() // BUCKET_ROWS))
        # Dealt as the buckets are: one file per bucket.
        writer = counted.repartition(buckets, key).write.format("parquet").option("path", scratch_path(spark, "stored", name))
        writer.bucketBy(buckets, key).sortBy(key).saveAsTable(table)
        _stored[at] = table
    return spark.table(_stored[at])


def stored_name(spark: SparkSession, source: str, name: str) -> str:
    """The catalog name of a table that ``stored_by_key`` wrote."""
    return _stored[spark.sparkContext.applicationId, source, name]

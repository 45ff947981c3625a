"""Materialised sinks (S12): declared schema, partition columns, full replace."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomart.session import settings

#: Partition values of which a task holds an open file at a time, at most.
OPEN_FILES = 4


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast and order columns to a declared schema, carrying column comments
    (``metadata={"comment": ...}``) into the written files."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema.fields])


def write_partitioned(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str],
    sort_within: Sequence[str] = (),
    max_records_per_file: int = 5_000_000,
    unfold: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Full replace of a partitioned Parquet table.

    Rows are range-partitioned on the partition columns followed by the sort
    columns (or a row hash), so each partition folder receives few, large
    files (small-file compaction) while a partition value holding a large
    share of the rows is still split over several tasks. The sort inside the
    files (e.g. by origin for a travel matrix) makes row-group statistics
    selective for lookups by that column.

    ``unfold`` makes the rows to write out of those given, in their order and with
    their partition columns: many of each, so only the rows given are sorted, where
    they are, and should come in ranges as read. A task keeps a file open for each
    partition value it meets, up to ``OPEN_FILES``; beyond these Spark sorts.
    """
    tiebreak = [F.col(c) for c in sort_within] or [F.xxhash64(*[F.col(c) for c in df.columns])]
    keys = [F.col(c) for c in partition_by] + tiebreak
    if unfold is None:
        _write(df.repartitionByRange(*keys).sortWithinPartitions(*keys), path, partition_by, max_records_per_file)
        return
    spark = df.sparkSession
    tasks = spark.conf.get("spark.sql.shuffle.partitions")  # a small file is many rows
    with settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": OPEN_FILES, "spark.sql.files.minPartitionNum": tasks}):
        _write(unfold(df.sortWithinPartitions(*keys)), path, partition_by, max_records_per_file, compression="zstd")


def _write(out: DataFrame, path: str, partition_by: Sequence[str], max_records_per_file: int, **options: str) -> None:
    (
        out.write.mode("overwrite")
        .options(**options)
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy(*partition_by)
        .parquet(path)
    )

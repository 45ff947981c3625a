"""Incremental file landings with Structured Streaming.

A landing folder receives date-stamped files; each run appends every new
file exactly once to a Parquet table. The file source tracks processed
files in the checkpoint, ``trigger(availableNow=True)`` processes what is
there and stops, so a scheduled job re-running adds only new files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from geomart.sources.files import with_provenance


def read_landing_stream(
    spark: SparkSession,
    fmt: str,
    path: str,
    schema: StructType,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Streaming scan of every file under ``path`` (sub-folders included).

    A CSV file whose header names other columns, or in another order, than
    ``schema`` fails the run; its values never land under a wrong name."""
    reader = spark.readStream.format(fmt).schema(schema).option("recursiveFileLookup", "true")
    if fmt == "csv":
        reader = reader.option("enforceSchema", "false")
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    return reader.load(path)


def run_available_now(
    stream: DataFrame,
    sink_path: str,
    checkpoint_path: str,
    partition_by: list[str] | None = None,
) -> int:
    """Append everything available to a Parquet sink and stop; returns the
    number of micro-batches that carried rows."""
    writer = (
        stream.writeStream.format("parquet")
        .option("path", sink_path)
        .option("checkpointLocation", checkpoint_path)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    q = writer.start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return sum(1 for p in q.recentProgress if p.get("numInputRows", 0) > 0)


def bronze_append(
    spark: SparkSession,
    fmt: str,
    landing: str,
    schema: StructType,
    sink: str,
    checkpoint: str,
    source_tag: str | None = None,
    options: dict[str, str] | None = None,
    refine: Callable[[DataFrame], DataFrame] | None = None,
) -> int:
    """Landing files -> provenance columns -> optional refinement -> Parquet."""
    s = with_provenance(read_landing_stream(spark, fmt, landing, schema, options), source_tag=source_tag)
    if refine is not None:
        s = refine(s)
    return run_available_now(s, sink, checkpoint)


def refine_stream(
    spark: SparkSession,
    upstream_sink: str,
    sink: str,
    checkpoint: str,
    refine: Callable[[DataFrame], DataFrame],
) -> int:
    """Stream-to-stream refinement of an upstream Parquet table."""
    schema = spark.read.parquet(upstream_sink).schema
    s = spark.readStream.schema(schema).parquet(upstream_sink)
    return run_available_now(refine(s), sink, checkpoint)


def bronze_tables(
    spark: SparkSession,
    landing_root: str,
    bronze_root: str,
    checkpoint_root: str,
    entities: dict[str, StructType],
    fmt: str = "csv",
    options: dict[str, str] | None = None,
) -> dict[str, Callable[[], int]]:
    """One append job per file type (S5): ``{entity: run}`` where ``run()``
    streams ``<landing_root>/<entity>/`` into ``<bronze_root>/<entity>``."""

    def make(entity: str, schema: StructType) -> Callable[[], int]:
        def run() -> int:
            return bronze_append(
                spark, fmt, f"{landing_root}/{entity}", schema, f"{bronze_root}/{entity}",
                f"{checkpoint_root}/{entity}", source_tag=entity, options=options,
            )

        return run

    return {e: make(e, s) for e, s in entities.items()}


def infer_landing_schema(spark: SparkSession, fmt: str, path: str) -> StructType:
    """Column types inferred from the landed files (S3).

    File streams need a schema up front; inferring it with a batch read at
    the start of each run, and widening the sink with new columns, gives the
    additive evolution a hosted incremental loader provides. All rows are
    read: a column of unread rows would be lost."""
    reader = spark.read.format(fmt).option("recursiveFileLookup", "true")
    if fmt == "csv":
        reader = reader.option("header", "true").option("inferSchema", "true")
    return reader.load(path).schema


def evolving_bronze_append(
    spark: SparkSession, fmt: str, landing: str, sink: str, checkpoint: str, source_tag: str | None = None
) -> int:
    """Append new landing files with a freshly inferred schema; columns that
    appear later are NULL in rows written earlier when the sink is read with
    ``mergeSchema``."""
    schema = infer_landing_schema(spark, fmt, landing)
    opts = {"header": "true"} if fmt == "csv" else None
    return bronze_append(spark, fmt, landing, schema, sink, checkpoint, source_tag=source_tag, options=opts)


def read_sink(spark: SparkSession, sink: str) -> DataFrame:
    """Read a streaming Parquet sink, merging evolved file schemas."""
    return spark.read.option("mergeSchema", "true").parquet(sink)

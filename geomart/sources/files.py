"""File-level helpers: header cleanup, optional inputs, provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomart.functions.text import path_part


def trim_headers(df: DataFrame) -> DataFrame:
    """Trim every column name."""
    return df.toDF(*[c.strip() for c in df.columns])


def optional_parquet(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path`` or ``None`` when it does not exist.

    Resolving the schema only lists the path; no data is read.
    """
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def first_existing_table(spark: SparkSession, names: Sequence[str]) -> str | None:
    """First catalog table name that exists, in the given order."""
    for n in names:
        if spark.catalog.tableExists(n):
            return n
    return None


def with_provenance(
    df: DataFrame,
    source_pattern: str | None = None,
    run_date_pattern: str | None = r"(\d{4}-\d{2}-\d{2})",
    source_tag: str | None = None,
) -> DataFrame:
    """Add ``_source_file``, ``_source``, ``_run_date`` and ``_ingested_at``.

    Source and run date are regex groups of the file path (from the hidden
    ``_metadata`` column of file sources); an unparsable run date is NULL.
    """
    path = F.col("_metadata.file_path")
    out = df.withColumn("_source_file", path)
    if source_tag is not None:
        out = out.withColumn("_source", F.lit(source_tag))
    elif source_pattern is not None:
        out = out.withColumn("_source", path_part(path, source_pattern))
    if run_date_pattern is not None:
        out = out.withColumn("_run_date", F.try_to_date(path_part(path, run_date_pattern), "yyyy-MM-dd"))
    return out.withColumn("_ingested_at", F.current_timestamp())

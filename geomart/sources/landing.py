"""Landing-folder jobs: dated files, run log, hash-skip, retention (S3, S10,
S12, S14-S16)."""

from __future__ import annotations

import datetime
import functools
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomart.functions.text import path_part
from geomart.session import ensure_checkpoint_dir
from geomart.sources.files import optional_parquet
from geomart.sources.types import LATTICE, widest

DATE_IN_PATH = r"(\d{4}-\d{2}-\d{2})"

# Fixed run-log schema: one row per fetch attempt.
RUN_LOG_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("fetched_at", T.TimestampNTZType()),
        T.StructField("status", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("feed_version", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("file_count", T.IntegerType()),
        T.StructField("bytes_written", T.LongType()),
        T.StructField("target_path", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("notes", T.StringType()),
    ]
)


def write_landing(df: DataFrame, root: str, fmt: str, date_col: str, options: Mapping[str, str] | None = None) -> None:
    """Write ``df`` as date-stamped landing folders ``<root>/<date_col>=<date>/``.

    Rows are ranged by date (and, within a date, by a hash of the row), so a
    folder gets one file per task that its date is spread over, not one per task
    of the job, and a date that holds most rows is still written by many."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    w = df.repartitionByRange(F.col(date_col), row).write.mode("append").partitionBy(date_col).format(fmt)
    for k, v in (options or {}).items():
        w = w.option(k, v)
    w.save(root)


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path, length, run_date`` of the files under ``root``; files are listed,
    not opened. The date is the one in the path, if any."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length", F.try_to_date(path_part(F.col("path"), DATE_IN_PATH), "yyyy-MM-dd").alias("run_date"))


def newest_landings(spark: SparkSession, root: str, datasets: Sequence[str]) -> dict[str, tuple[datetime.date, list[str]]]:
    """Per dataset folder of ``root`` that has dated CSV files: the newest date and
    the files of that date. The listing is a table; what comes to the driver is
    the paths that will be opened."""
    name = path_part(F.col("path"), f"{re.escape(root.rstrip('/').rpartition('/')[2])}/([^/]+)/")
    files = list_files(spark, root, "*.csv").withColumn("dataset", name).filter(F.col("dataset").isin(list(datasets)) & F.col("run_date").isNotNull())
    newest = files.groupBy("dataset").agg(F.max("run_date").alias("run_date"))
    chosen = files.join(newest, ["dataset", "run_date"]).groupBy("dataset", "run_date").agg(F.collect_list("path").alias("paths"))
    return {r["dataset"]: (r["run_date"], sorted(r["paths"])) for r in chosen.collect()}


def latest_file_union(
    spark: SparkSession, root: str, datasets: Sequence[str], columns: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Per dataset folder, the rows of its latest dated landing, tagged with
    the dataset and unioned by name; missing datasets are skipped and an
    error is raised when none exists (S10). Older landings are not opened.

    ``columns`` maps each dataset to the source columns renamed, in order,
    to the shared output columns ``code`` and ``label``.
    """
    landings = newest_landings(spark, root, datasets)
    frames = []
    for ds in datasets:
        if ds not in landings:
            continue
        run_date, paths = landings[ds]
        code, label = columns[ds]
        rows = spark.read.option("header", "true").csv(paths)
        frames.append(rows.select(F.lit(ds).alias("dataset"), F.col(code).alias("code"), F.col(label).alias("label"), F.lit(run_date).alias("_run_date")))
    if not frames:
        raise FileNotFoundError(f"no dataset folder found under {root}")
    return functools.reduce(DataFrame.unionByName, frames)


def union_evolving(frames: Sequence[DataFrame]) -> DataFrame:
    """Additive schema evolution: union by name; columns missing from older
    landings become NULL, and a column whose type differs between landings has
    the least type that holds all, or text (S3)."""
    kinds: dict[str, str] = {}
    for f in frames:
        for name, kind in f.dtypes:
            before = kinds.setdefault(name, kind)
            if before != kind:
                kinds[name] = widest(before, kind) if before in LATTICE and kind in LATTICE else "string"
    cast = [f.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in f.columns]) for f in frames]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def run_log_rows(attempts: DataFrame) -> DataFrame:
    """Fetch attempts in the run-log schema: columns that ``attempts`` lacks are
    NULL, others are left behind; an attempt without a status or a source is an
    error in the caller and fails the write."""
    have = {c.lower(): c for c in attempts.columns}
    missing = [c for c in ("run_id", "source", "status") if c not in have]
    if missing:
        raise ValueError(f"a run needs {', '.join(missing)}")
    return attempts.select(*[(F.col(have[f.name]) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in RUN_LOG_SCHEMA.fields])


def append_run_log(spark: SparkSession, log_path: str, rows: DataFrame) -> None:
    """Append run rows; new columns are added to the log (older rows NULL)."""
    rows.write.mode("append").option("mergeSchema", "true").parquet(log_path)


def read_run_log(spark: SparkSession, log_path: str) -> DataFrame | None:
    return optional_parquet_merged(spark, log_path)


def optional_parquet_merged(spark: SparkSession, path: str) -> DataFrame | None:
    df = optional_parquet(spark, path)
    if df is None:
        return None
    return spark.read.option("mergeSchema", "true").parquet(path)


def hash_skip_status(
    runs: DataFrame,
    source: str = "source",
    order: Sequence[str] = ("fetched_at", "run_id"),
    content_hash: str = "content_hash",
    failed: Column | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Status per fetch attempt: ``failed`` when the fetch failed, ``skipped``
    when the content hash equals the hash of the source's latest earlier
    successful landing, else ``succeeded`` (S15).

    A skipped run carries the same hash as that landing, so the latest
    earlier non-failed hash is the latest succeeded one. Ordered by time
    with the run id as tie-break.

    The log is range-partitioned by source and time into slices, so a source that
    holds most runs has many. Each slice is scanned alone; its last hash (one row
    per source and slice) is carried to the slices of the source after it by a
    second, small scan.
    """
    ensure_checkpoint_dir(runs.sparkSession)
    is_failed = failed if failed is not None else F.col(content_hash).isNull()
    parts = slices or int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(source).asc(), *[F.col(c).asc() for c in order]]
    # Checkpointed: every later use sees the same slices.
    sliced = (
        runs.withColumn("_ok_hash", F.when(~is_failed, F.col(content_hash))).withColumn("_failed_run", is_failed)
        .repartitionByRange(parts, *keys).withColumn("_slice", F.spark_partition_id()).checkpoint()
    )
    ends = sliced.groupBy(source, "_slice").agg(
        F.max_by(F.when(F.col("_ok_hash").isNotNull(), F.col("_ok_hash")), F.when(F.col("_ok_hash").isNotNull(), F.struct(*order))).alias("_end")
    )
    before = Window.partitionBy(source).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).select(F.col(source).alias("_src"), F.col("_slice").alias("_of"), "_carried")
    joined = sliced.join(carried, F.col(source).eqNullSafe(F.col("_src")) & (F.col("_slice") == F.col("_of")))
    within = Window.partitionBy(source, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.coalesce(F.last("_ok_hash", ignorenulls=True).over(within), F.col("_carried"))
    status = F.when(F.col("_failed_run"), "failed").when(prev.eqNullSafe(F.col(content_hash)), "skipped").otherwise("succeeded")
    return joined.withColumn("status", status).drop("_ok_hash", "_failed_run", "_slice", "_src", "_of", "_carried")


def retention_candidates(landings: DataFrame, name_col: str, days: int, as_of: Column) -> DataFrame:
    """Landings whose date-named folder is more than ``days`` days before
    ``as_of``; names that do not parse as dates are ignored (S16)."""
    d = F.try_to_date(F.col(name_col), "yyyy-MM-dd")
    return landings.withColumn("landing_date", d).filter(
        F.col("landing_date").isNotNull() & (F.col("landing_date") < F.date_sub(as_of, days))
    )


class LandingTooSmall(ValueError):
    pass


def check_landing_floor(
    spark: SparkSession, path: str, min_bytes: int = 50_000, min_rows: int | None = None, fmt: str = "csv"
) -> tuple[int, int | None]:
    """Landing sanity floor (S22): total bytes of the files under ``path`` and,
    optionally, their row count must reach the floors, else the run fails.
    Both are single aggregates (file lengths from the file listing)."""
    size = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .agg(F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first().b
    )
    if size < min_bytes:
        raise LandingTooSmall(f"{path}: {size} bytes < {min_bytes}")
    rows = None
    if min_rows is not None:
        rows = spark.read.format(fmt).option("header", "true").option("recursiveFileLookup", "true").load(path).count()
        if rows < min_rows:
            raise LandingTooSmall(f"{path}: {rows} rows < {min_rows}")
    return size, rows

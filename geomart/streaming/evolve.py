"""CSV landings read by header name, with a sink schema that grows.

Every file has the columns that its own header names, in that order. New files
are found by the file source (its checkpoint takes each exactly once), grouped
by header, and each group is read under its own header, so values never land
under another name.

The sink keeps the text of every value; a stored, versioned schema says which
columns there are and what type they have. A column's type is the least one of
the lattice ``LATTICE`` that holds all values so far; a new file can add columns
and widen types, never narrow them. Because the text is kept, a widened column
reads back as it was written ("007" that becomes text stays "007"), and files of
all versions are read together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomart.sources.files import optional_parquet, with_provenance
from geomart.sources.types import LATTICE, widest
from geomart.streaming.landing import run_available_now

PROVENANCE = ("_source_file", "_source", "_run_date")
RESERVED = {*PROVENANCE, "_ingested_at"}

_SCHEMA_ROWS = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])


def _fits(value: Column, kind: str) -> Column:
    if kind == "boolean":
        return F.lower(value).isin("true", "false")
    if kind == "bigint":  # "007" and "+1" are no numbers, they would not read back
        return value.try_cast("bigint").cast("string").eqNullSafe(value)
    if kind == "double":
        return value.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$") & value.try_cast("double").isNotNull()
    if kind == "date":
        return value.rlike(r"^\d{4}-\d\d-\d\d$") & value.try_cast("date").isNotNull()
    return value.rlike(r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d(:\d\d(\.\d+)?)?$") & value.try_cast("timestamp_ntz").isNotNull()


def infer_types(rows: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """The narrowest type for all values of each text column, in one aggregate;
    ``None`` for a column without values."""
    kinds = [k for k in LATTICE if k != "string"]
    checks = [F.every(_fits(F.col(f"`{c}`"), k) | F.col(f"`{c}`").isNull()) for c in columns for k in kinds]
    some = [F.count(F.col(f"`{c}`")) for c in columns]
    found = rows.agg(*[x.alias(f"c{i}") for i, x in enumerate([*checks, *some])]).first()
    out: dict[str, str | None] = {}
    for i, c in enumerate(columns):
        if not found[len(checks) + i]:
            out[c] = None
            continue
        fits = [k for j, k in enumerate(kinds) if found[i * len(kinds) + j]]
        out[c] = min(fits, key=lambda k: -len(LATTICE[k]), default="string")
    return out


def _schema_path(sink: str) -> str:
    return f"{sink.rstrip('/')}.schema"


def stored_schema(spark: SparkSession, sink: str, before: int | None = None) -> dict[str, str | None]:
    """Columns of the sink and their types, in the newest version (of those
    numbered under ``before``); none before the first batch."""
    rows = optional_parquet(spark, _schema_path(sink))
    if rows is None:
        return {}
    if before is not None:  # a batch that is repeated stored its version already
        rows = rows.filter(F.col("version") < before)
    newest = rows.groupBy("version").agg(F.sort_array(F.collect_list(F.struct("position", "name", "type"))).alias("c")).orderBy(F.desc("version")).first()
    return {r["name"]: r["type"] for r in newest["c"]} if newest else {}


def _store_schema(spark: SparkSession, sink: str, version: int, columns: dict[str, str | None]) -> None:
    rows = [(i, c, t) for i, (c, t) in enumerate(columns.items())]
    # A batch that is repeated after a failure writes its version again.
    spark.createDataFrame(rows, _SCHEMA_ROWS).coalesce(1).write.mode("overwrite").parquet(f"{_schema_path(sink)}/version={version}")


def by_header(spark: SparkSession, paths: DataFrame, options: dict[str, str] | None = None) -> Iterator[tuple[list[str], DataFrame]]:
    """``(columns, rows)`` for every different header among the CSV files
    ``paths`` (column ``path``): all values as text, empty ones null.

    What comes to the driver is the listing of the new files, as in every read
    of files, and one row per header.
    """
    files = [r["path"] for r in paths.select("path").distinct().collect()]
    if not files:
        return
    lines = spark.read.text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("value"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
    )
    heads = lines.groupBy("file").agg(F.min_by("value", "at").alias("header"))
    for r in heads.groupBy("header").agg(F.collect_list("file").alias("files")).orderBy("header").collect():
        reader = spark.read.option("enforceSchema", "true")
        for k, v in (options or {}).items():
            reader = reader.option(k, v)
        # The header as a row, for a reader would rename columns that stand twice.
        names = [(n or "").lstrip("\ufeff").strip() for n in reader.option("header", "false").csv(r["files"][:1]).first()]
        if len({n.lower() for n in names}) < len(names):
            raise ValueError(f"{r['files'][0]}: a column name stands twice in {r['header']!r}")
        yield names, reader.option("header", "true").schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(r["files"])


def _run(spark: SparkSession, landing: str, checkpoint: str, take: Callable[[int, DataFrame], None]) -> int:
    """``take(batch, paths)`` for the files that are new since the run before;
    number of files.

    A file stream lists new files into an inbox, each exactly once. The batch is
    numbered by what is done; its mark is written last, so a run that failed
    half-way is repeated under the same number and replaces what it wrote.
    """
    listing = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    # The content column is never asked for: files are listed, not read.
    new = spark.readStream.format("binaryFile").schema(listing).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(landing).select("path")
    inbox, done = f"{checkpoint}/inbox", f"{checkpoint}/done"
    run_available_now(new, inbox, f"{checkpoint}/listing")
    paths, batch = spark.read.schema("path string").parquet(inbox), 0
    taken = optional_parquet(spark, done)
    if taken is not None:
        batch = taken.agg(F.max("batch")).first()[0] + 1
        paths = paths.join(taken.select("path"), "path", "left_anti")
    n = paths.count()
    if n:
        take(batch, paths)
        paths.write.mode("overwrite").parquet(f"{done}/batch={batch}")
    return n


def evolving_csv_append(spark: SparkSession, landing: str, sink: str, checkpoint: str, source_tag: str | None = None, options: dict[str, str] | None = None) -> int:
    """Append new CSV files of any header; columns are added and types widened
    as the files need it. Read the sink with ``read_evolving``."""

    def take(batch: int, paths: DataFrame) -> None:
        columns = stored_schema(spark, sink, before=batch)
        for part, (names, rows) in enumerate(by_header(spark, paths, options)):
            clash = RESERVED.intersection(names)
            if clash:
                raise ValueError(f"reserved column names in a header: {sorted(clash)}")
            for name, kind in infer_types(rows, names).items():
                columns[name] = widest(columns.get(name), kind)
            with_provenance(rows, source_tag=source_tag).write.mode("overwrite").parquet(f"{sink}/batch={batch}/header={part}")
        if columns:
            _store_schema(spark, sink, batch, columns)

    return _run(spark, landing, checkpoint, take)


def read_evolving(spark: SparkSession, sink: str) -> DataFrame:
    """The sink under its newest schema; columns that a file lacks are null."""
    columns = stored_schema(spark, sink)
    text = [T.StructField(c, T.StringType()) for c in columns]
    source = [T.StructField("_source_file", T.StringType()), T.StructField("_source", T.StringType()), T.StructField("_run_date", T.DateType())]
    rows = spark.read.schema(T.StructType([*text, *source])).option("recursiveFileLookup", "true").parquet(sink)
    return rows.select(*[F.col(f"`{c}`").cast(t or "string").alias(c) for c, t in columns.items()], *PROVENANCE)


def csv_append_by_name(spark: SparkSession, landing: str, schema: T.StructType, sink: str, checkpoint: str, source_tag: str | None = None, options: dict[str, str] | None = None) -> int:
    """Append new CSV files to a Parquet sink of a fixed ``schema``: columns are
    found by header name, in any order, missing ones are null and unknown ones
    are left behind."""

    def take(batch: int, paths: DataFrame) -> None:
        for part, (names, rows) in enumerate(by_header(spark, paths, options)):
            known = {n.lower(): n for n in names}
            columns = [F.col(f"`{known[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in known else F.lit(None).cast(f.dataType) for f in schema.fields]
            typed = with_provenance(rows, source_tag=source_tag).select(*[c.alias(f.name) for c, f in zip(columns, schema.fields)], *sorted(RESERVED))
            typed.write.mode("overwrite").parquet(f"{sink}/batch={batch}/header={part}")

    return _run(spark, landing, checkpoint, take)

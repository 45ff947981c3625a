"""Zip archives of CSV entity files.

Archives are read with the ``binaryFile`` source and unpacked inside tasks
(``mapInPandas``): one archive per task (zip is not splittable), lines
streamed out in bounded batches. Each entity file yields
``(archive, entity, line_no, line)``; a UTF-8 byte-order mark is stripped,
blank lines and header-only files are dropped and the feed version is read from
``feed_info.txt`` when present.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINES_SCHEMA = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("feed_version", T.StringType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("line", T.StringType()),
    ]
)

_BATCH = 50_000


def _feed_version(zf: zipfile.ZipFile) -> str | None:
    if "feed_info.txt" not in zf.namelist():
        return None
    lines = zf.read("feed_info.txt").decode("utf-8-sig").splitlines()
    if len(lines) < 2:
        return None
    header = [h.strip() for h in lines[0].split(",")]
    if "feed_version" not in header:
        return None
    values = lines[1].split(",")
    i = header.index("feed_version")
    return values[i].strip() if i < len(values) else None


def _entry_batches(zf: zipfile.ZipFile, name: str) -> Iterator[list[str]]:
    """Lines of one entry in batches of at most ``_BATCH``, streamed from
    the archive (never the whole entry in memory); the BOM is stripped and
    blank lines are left out."""
    with zf.open(name) as raw:
        text = io.TextIOWrapper(raw, encoding="utf-8-sig", newline="")
        batch: list[str] = []
        for line in text:
            if not line.strip():
                continue
            batch.append(line.rstrip("\r\n"))
            if len(batch) == _BATCH:
                yield batch
                batch = []
        if batch:
            yield batch


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as zf:
                version = _feed_version(zf)
                for name in zf.namelist():
                    if not name.endswith(".txt"):
                        continue
                    entity = name[: -len(".txt")]
                    start = 0
                    for lines in _entry_batches(zf, name):
                        if start == 0 and len(lines) <= 1:  # header-only file
                            break
                        yield pd.DataFrame(
                            {
                                "archive": path,
                                "entity": entity,
                                "feed_version": version,
                                "line_no": range(start, start + len(lines)),
                                "line": lines,
                            }
                        )
                        start += len(lines)


def read_archive_lines(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return raw.select("path", "content").mapInPandas(_unzip, LINES_SCHEMA)


# A comma outside double quotes: an even number of quotes follows it.
_FIELD_END = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _fields(line: Column) -> Column:
    """Fields of one CSV line; quotes around a field go, doubled ones become one."""
    unquoted = lambda f: F.when(F.trim(f).rlike('^".*"$'), F.replace(F.regexp_replace(F.trim(f), '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(f)
    return F.transform(F.split(F.regexp_replace(line, "^\ufeff", ""), _FIELD_END, -1), unquoted)


def entity_rows(lines: DataFrame, entity: str, schema: T.StructType) -> DataFrame:
    """Data rows of one entity, columns found by name in the header line of
    their own archive, so archives may order them differently or have more.

    A column that an archive lacks, an empty field and a value that does not
    cast are NULL. Headers are one row per archive."""
    own = lines.filter(F.col("entity") == entity)
    heads = own.filter(F.col("line_no") == 0).select("archive", F.transform(_fields(F.col("line")), lambda h: F.trim(h)).alias("_head"))
    rows = own.filter(F.col("line_no") > 0).select("archive", "feed_version", _fields(F.col("line")).alias("_f")).join(heads, "archive")

    def value(f: T.StructField) -> Column:
        at = F.array_position("_head", F.lit(f.name)).cast("int")
        return F.nullif(F.get("_f", at - 1), F.lit("")).try_cast(f.dataType).alias(f.name)

    return rows.select("archive", "feed_version", *[value(f) for f in schema.fields])

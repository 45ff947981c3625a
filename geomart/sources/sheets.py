"""Spreadsheet exports read as CSV.

``positional`` sheets: titles in row 0, data from a fixed row, known titles
mapped to output names by position, unparsable dates skipped, all-null rows
dropped, end-of-period dates moved to the first day of the quarter.
``tidy`` sheets: header cleanup, required-column check, row floor, rows with
NULL or unparsable dates dropped.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geomart.sources.files import trim_headers


class SheetValidationError(ValueError):
    pass


def read_positional(
    spark: SparkSession,
    path: str,
    titles: Mapping[str, str],
    data_from_row: int = 5,
    date_format: str = "yyyy-MM-dd",
) -> DataFrame:
    """Parse every sheet file under ``path``: ``(sheet_file, quarter, <names>)``.

    Row numbers are per file, by the place of the split in the file and of the
    row in the split; the per-file window only ranks one sheet. A sheet of whose
    titles none is known, or that gives no row, is an error that names it.
    """
    raw = (
        spark.read.option("header", "false").option("recursiveFileLookup", "true").csv(path)
        .withColumn("sheet_file", F.col("_metadata.file_path"))
        .withColumn("_split", F.col("_metadata.file_block_start"))
        .withColumn("_id", F.monotonically_increasing_id())
    )
    cols = [c for c in raw.columns if c.startswith("_c")]
    raw = raw.withColumn("_row", F.row_number().over(Window.partitionBy("sheet_file").orderBy("_split", "_id")) - 1)
    head = raw.filter(F.col("_row") == 0).select("sheet_file", *[F.col(c).alias(f"_t{c}") for c in cols[1:]])
    data = raw.filter(F.col("_row") >= data_from_row).join(head, "sheet_file")
    picked = []
    for title, name in titles.items():
        expr = None
        for c in cols[1:]:
            cond = F.trim(F.col(f"_t{c}")) == title
            expr = F.when(cond, F.col(c)) if expr is None else expr.when(cond, F.col(c))
        picked.append(F.trim(expr).try_cast("double").alias(name))
    date = F.try_to_date(F.trim(F.col(cols[0])), date_format)
    out = data.select("sheet_file", F.trunc(date, "quarter").alias("quarter"), *picked).filter(
        F.col("quarter").isNotNull()
    )
    any_value = F.lit(False)
    for name in titles.values():
        any_value = any_value | F.col(name).isNotNull()
    out = out.filter(any_value)
    titled = functools.reduce(lambda a, b: a | b, [F.trim(F.col(f"_t{c}")).isin(*titles) for c in cols[1:]])
    found = head.select("sheet_file", F.coalesce(titled, F.lit(False)).alias("titled"))
    rows = out.groupBy("sheet_file").agg(F.count(F.lit(1)).alias("n"))
    faulty = found.join(rows, "sheet_file", "left").filter(~F.col("titled") | F.col("n").isNull()).limit(5).collect()
    if faulty:
        what = [f"{r['sheet_file']}: " + ("no row with a date and a value" if r["titled"] else "none of the titles is known") for r in faulty]
        raise SheetValidationError("; ".join(what))
    return out


def read_tidy(
    spark: SparkSession,
    path: str,
    required: Sequence[str],
    date_col: str = "date",
    date_format: str = "yyyy-MM-dd",
    min_rows: int = 1,
) -> DataFrame:
    """Tidy sheet with header: names trimmed, required columns checked, a row
    floor enforced (one count), NULL/unparsable dates dropped."""
    df = trim_headers(spark.read.option("header", "true").option("recursiveFileLookup", "true").csv(path))
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise SheetValidationError(f"missing required columns: {missing}")
    out = df.withColumn(date_col, F.try_to_date(F.trim(F.col(date_col)), date_format)).filter(
        F.col(date_col).isNotNull()
    )
    n = out.count()
    if n < min_rows:
        raise SheetValidationError(f"only {n} valid rows, expected at least {min_rows}")
    return out

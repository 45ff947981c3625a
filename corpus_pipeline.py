"""Documents to training sequences: each stage works on what the one before
it kept, written as Parquet in between.

A stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of
``docs``. A null text is kept as null, an empty one as empty, texts of any length
go through whole, and an empty table gives an empty one. Rows with a null
``doc_id`` pass the near-duplicate stage, where they
belong to no class; rows that repeat both id and text count as copies there.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomart.llm.common import ship, table, text_key
from geomart.llm.linededup import remove_repeated_passages
from geomart.llm.ngramjoin import similar_documents
from geomart.llm.queries import good_documents, leaked, packed
from geomart.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(fn: Stage) -> Stage:
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, docs, sf_dir)

    return run_stage


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps."""
    return good_documents(spark, docs, sf_dir).select(*_columns(docs))


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of two lines or more that stand elsewhere before."""
    cut = remove_repeated_passages(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*_columns(docs))


def _pick(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` that are (or, with ``left_anti``, are not) in ``rows``
    by id and text."""
    keyed = docs.withColumns({"__llm_id": F.col("doc_id").cast("long"), "__llm_key": text_key()})
    rows = rows.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    return keyed.join(rows, F.col("__llm_id").eqNullSafe(F.col("__id")) & (F.col("__llm_key") == F.col("__key")), how)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the smallest id."""
    classes = similar_documents(docs.select("doc_id", "text"), width=5, threshold=0.8)
    kept = _pick(docs, classes.filter("doc_id = class_id"), "left_semi").dropDuplicates(["__llm_id", "__llm_key"])
    return kept.select(*_columns(docs)).unionByName(docs.filter("doc_id IS NULL"))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return _pick(docs, leaked(spark, docs, sf_dir), "left_anti").select(*_columns(docs))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 ids."""
    return packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: No SQL can express a stage; tests compare it with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline", name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

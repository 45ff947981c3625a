"""Expectations on streams (R2, Q1): rows that fail are counted per micro-batch
and, for dropping rules, left out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geomart.operators.quality import passes

REPORT_SCHEMA = "batch long, rule string, action string, failed_rows long, total_rows long"
_NAME = "expectations"


def append_with_expectations(
    stream: DataFrame,
    sink: str,
    checkpoint: str,
    report: str,
    keep: Mapping[str, Column | str] | None = None,
    drop: Mapping[str, Column | str] | None = None,
) -> int:
    """Append what is available to a Parquet sink; number of batches with rows.

    The counts are observed while the rows pass (no second read) and come with
    the progress of each batch; they are stored by batch, so a batch that runs
    again replaces its counts. ``report`` gets a row per rule and batch.
    """
    spark = stream.sparkSession
    rules = [(n, "warn", p) for n, p in (keep or {}).items()] + [(n, "drop", p) for n, p in (drop or {}).items()]
    counts = [F.count_if(~passes(p)).alias(f"r{i}") for i, (_, _, p) in enumerate(rules)]
    out = stream.observe(_NAME, F.count(F.lit(1)).alias("total_rows"), *counts)
    for p in (drop or {}).values():
        out = out.filter(passes(p))
    # Progress of every batch of this run is kept until it is read below.
    setting = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "1000000")
    try:
        q = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(setting, before)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    n = 0
    for p in q.recentProgress:
        seen = p.observedMetrics.get(_NAME) if p.numInputRows else None
        if seen is None:
            continue
        rows = [(p.batchId, name, action, seen[f"r{i}"], seen["total_rows"]) for i, (name, action, _) in enumerate(rules)]
        spark.createDataFrame(rows, REPORT_SCHEMA).drop("batch").coalesce(1).write.mode("overwrite").parquet(f"{report}/batch={p.batchId}")
        n += 1
    return n


def read_report(spark: SparkSession, report: str) -> DataFrame:
    return spark.read.schema("rule string, action string, failed_rows long, total_rows long, batch long").parquet(report).select("batch", "rule", "action", "failed_rows", "total_rows")

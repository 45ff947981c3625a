"""Time-series marts: quarter labels, lagged growth, growth screens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quarter_start(col: Column | str) -> Column:
    """First day of the quarter holding ``col`` (a date or timestamp)."""
    return F.trunc(F.to_date(col), "quarter")


def quarter_label(date_col: Column | str) -> Column:
    """Human label of the form ``2024-Q1``."""
    d = F.to_date(date_col)
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def lag_growth_pct(
    value: str,
    partition_by: Sequence[str],
    order_by: str,
    periods: int = 4,
    scale: int = 2,
) -> Column:
    """Percent change against the row ``periods`` rows earlier in the series.

    NULL when there is no earlier row or it is zero; rounded half-up.
    The window is per series key, so each task holds one series.
    """
    w = Window.partitionBy(*partition_by).orderBy(order_by)
    prev = F.lag(value, periods).over(w)
    return F.when(
        prev.isNotNull() & (prev != 0),
        F.round((F.col(value) - prev) / prev * 100, scale),
    )


def with_yoy(
    df: DataFrame,
    value: str,
    partition_by: Sequence[str],
    order_by: str,
    out: str = "yoy_pct",
    periods: int = 4,
) -> DataFrame:
    return df.withColumn(out, lag_growth_pct(value, partition_by, order_by, periods))


def growth_screen(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: str,
    fast: str,
    slow: str,
    fast_above: float = 8.0,
    slow_below: float = 3.0,
    periods: int = 4,
) -> DataFrame:
    """Rows where ``fast`` grew more than ``fast_above`` % while ``slow`` grew
    less than ``slow_below`` % over ``periods`` rows (A24)."""
    return (
        df.withColumn(f"{fast}_yoy_pct", lag_growth_pct(fast, partition_by, order_by, periods))
        .withColumn(f"{slow}_yoy_pct", lag_growth_pct(slow, partition_by, order_by, periods))
        .filter((F.col(f"{fast}_yoy_pct") > fast_above) & (F.col(f"{slow}_yoy_pct") < slow_below))
    )


def cliff_watch(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: str,
    fast: str,
    slow: str,
    n_sigma: float = 2.0,
    trailing: int = 4,
    periods: int = 4,
) -> DataFrame:
    """Rows where the growth gap ``fast - slow`` exceeds ``n_sigma`` sample
    standard deviations of the gap over the previous ``trailing`` rows (A23).

    Only rows with a full trailing window are judged.
    """
    gap = F.col(f"{fast}_yoy_pct") - F.col(f"{slow}_yoy_pct")
    trail = Window.partitionBy(*partition_by).orderBy(order_by).rowsBetween(-trailing, -1)
    return (
        df.withColumn(f"{fast}_yoy_pct", lag_growth_pct(fast, partition_by, order_by, periods))
        .withColumn(f"{slow}_yoy_pct", lag_growth_pct(slow, partition_by, order_by, periods))
        .withColumn("growth_gap", gap)
        .withColumn("gap_n", F.count("growth_gap").over(trail))
        .withColumn("gap_sd", F.stddev_samp("growth_gap").over(trail))
        .filter((F.col("gap_n") == trailing) & (F.col("growth_gap") > n_sigma * F.col("gap_sd")))
        .drop("gap_n")
    )

"""Weighted bridges between geographies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomart.session import ensure_checkpoint_dir


def overlap_shares(pairs: DataFrame, unit: str, area: str, scale: int = 6) -> DataFrame:
    """Overlap counts between ``unit`` and ``area`` and the share of each
    side's total, rounded to ``scale`` places (G9, A3).

    Totals come from per-key aggregates joined back rather than
    ``sum() over (partition by key)``: a window would put a whole key on one
    task, an aggregate combines map-side first.
    """
    ensure_checkpoint_dir(pairs.sparkSession)
    # Used three times below: counted once.
    n = pairs.groupBy(unit, area).agg(F.count(F.lit(1)).alias("n_overlap")).checkpoint()
    unit_tot = n.groupBy(unit).agg(F.sum("n_overlap").alias("unit_total"))
    area_tot = n.groupBy(area).agg(F.sum("n_overlap").alias("area_total"))
    # By unit last: who joins the shares on it needs no further exchange.
    return (
        n.join(area_tot, area)
        .join(unit_tot, unit)
        .select(
            unit,
            area,
            "n_overlap",
            (F.col("n_overlap") / F.col("unit_total")).alias("unit_share_raw"),
            F.round(F.col("n_overlap") / F.col("unit_total"), scale).alias("unit_share"),
            F.round(F.col("n_overlap") / F.col("area_total"), scale).alias("area_share"),
        )
    )


def allocate(
    totals: DataFrame,
    bridge: DataFrame,
    unit: str,
    area: str,
    period: str,
    value: str,
    share: str,
    out: str = "allocated",
    places: int | None = None,
) -> DataFrame:
    """Re-allocate unit totals to areas by bridge share.

    Units without a bridge row drop (inner join); values are summed per
    (area, period) and rounded to an integer **after** the sum; results
    <= 0 are dropped. With ``places`` the values (of that many decimal places)
    are multiplied and summed as decimals, so the order of the sum is no matter.
    """
    rate = F.col(share)
    if places is not None:
        totals = totals.withColumn(value, F.col(value).cast(f"decimal({15 + places},{places})"))
        rate = rate.cast("decimal(8,6)")
    # A unit's periods meet its areas as one row and part only where an area's rows
    # are: a group is then held once, and not in every task that has one of its units.
    held = totals.groupBy(unit).agg(F.collect_list(F.struct(F.col(period).alias("p"), F.col(value).alias("v"))).alias("_h"))
    held = held.select(unit, F.transform("_h", lambda h: h.p).alias("_periods"), F.transform("_h", lambda h: h.v).alias("_values"))
    met = bridge.select(unit, area, share).join(held, unit).select(area, rate.alias("_rate"), "_periods", "_values").repartition(area)
    each = met.select(area, "_rate", F.inline(F.arrays_zip(F.col("_periods").alias("p"), F.col("_values").alias("v"))).alias(period, "_value"))
    return (
        each.groupBy(area, period)
        .agg(F.sum(F.col("_value") * F.col("_rate")).alias("_raw"))
        .select(area, period, F.round("_raw", 0).cast("bigint").alias(out))
        .filter(F.col(out) > 0)
    )


def rollup(df: DataFrame, keys: Sequence[str], sum_col: str, max_col: str) -> DataFrame:
    """Grouped SUM + MAX at the given grain (G1)."""
    return df.groupBy(*keys).agg(
        F.sum(sum_col).alias(f"total_{sum_col}"), F.max(max_col).alias(f"max_{max_col}")
    )


def one_to_one_violations(df: DataFrame, name: str, code: str) -> DataFrame:
    """Names mapped to more than one code, or codes to more than one name.

    A bridge keyed by name while its shares are per code double-counts when
    two codes share a name; run this before joining on the name and fail
    on any row. Two aggregates, no window."""
    by_name = (
        df.groupBy(name).agg(F.countDistinct(code).alias("n")).filter("n > 1")
        .select(F.lit(name).alias("side"), F.col(name).cast("string").alias("value"), "n")
    )
    by_code = (
        df.groupBy(code).agg(F.countDistinct(name).alias("n")).filter("n > 1")
        .select(F.lit(code).alias("side"), F.col(code).cast("string").alias("value"), "n")
    )
    return by_name.unionByName(by_code)

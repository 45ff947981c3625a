"""Area scoring: exact distributed NTILE, hazard levels, affordability
(W4, G10, A12, A13, A22)."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geomart.session import ensure_checkpoint_dir

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the partition id above bit 33


def exact_ntile(
    df: DataFrame, n: int, order_by: Sequence[str], out: str = "ntile", partitions: int | None = None
) -> DataFrame:
    """``NTILE(n) OVER (ORDER BY order_by)`` without a single-partition window.

    The ordering key alone is range-partitioned, sorted and checkpointed, so
    every later use sees the same partitions; per-partition row counts (one
    row per partition, a bounded table) give each partition's global offset,
    which makes the exact global row number and the bucket. The bucket joins
    back on the key. The first ``N % n`` buckets get one extra row, as NTILE
    does. ``order_by`` must be a total order (end it with a unique key).
    """
    ensure_checkpoint_dir(df.sparkSession)
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_key{i}" for i in range(len(order_by))]
    narrow = df.select(*[F.col(c).alias(k) for c, k in zip(order_by, keys)])
    ranged = narrow.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ided = ranged.withColumn("_mid", F.monotonically_increasing_id()).checkpoint().select(
        *keys,
        F.shiftright("_mid", _LOCAL_BITS).alias("_pid"),
        F.col("_mid").bitwiseAND((1 << _LOCAL_BITS) - 1).alias("_local"),
    )
    counts = ided.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # One row per partition: a single-task window over it is bounded.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_offset"),
        F.sum("_cnt").over(Window.partitionBy()).alias("_total"),
    )
    rn = F.col("_offset") + F.col("_local") + 1
    q = F.floor(F.col("_total") / n)
    r = F.col("_total") % n
    big = r * (q + 1)
    bucket = F.when(rn <= big, F.floor((rn - 1) / (q + 1)) + 1).otherwise(r + F.floor((rn - 1 - big) / q) + 1)
    ranks = ided.join(F.broadcast(offsets), "_pid").select(*keys, bucket.cast("int").alias(out))
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(order_by, keys)]
    return df.join(ranks, functools.reduce(Column.__and__, same)).drop(*keys)


# Hazard levels -----------------------------------------------------------------

RISK_RANK = {"low": 1, "medium": 2, "high": 3}


def hazard_levels(flags: DataFrame, key: str) -> DataFrame:
    """Per ``key``: flood high if any plain; medium if any prone, sensitive
    or regional zone; else low. Coastal high if any 1 % AEP; medium if any
    100-year; else low. Overall is the worst; sources are de-duplicated and
    sorted; ``cells_examined`` counts hazard rows (A12)."""
    agg = flags.groupBy(key).agg(
        F.bool_or("in_flood_plain").alias("_plain"),
        F.bool_or(
            F.col("in_flood_prone_area") | F.col("in_flood_sensitive_area") | F.col("in_regional_flood_zone")
        ).alias("_prone"),
        F.bool_or("in_coastal_inundation_1_aep").alias("_c1"),
        F.bool_or("in_coastal_inundation_100yr").alias("_c100"),
        # collect_set of per-cell source lists is bounded by the number of
        # layer combinations, not by the number of cells of the area.
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("hazard_sources")))).alias("hazard_sources"),
        F.count(F.lit(1)).alias("cells_examined"),
    )
    flood = F.when(F.col("_plain"), "high").when(F.col("_prone"), "medium").otherwise("low")
    coastal = F.when(F.col("_c1"), "high").when(F.col("_c100"), "medium").otherwise("low")
    out = agg.select(key, flood.alias("flood_risk"), coastal.alias("coastal_risk"), "hazard_sources", "cells_examined")
    return out.withColumn("overall_risk", worst_level("flood_risk", "coastal_risk"))


def _rank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    expr = None
    for name, v in RISK_RANK.items():
        expr = F.when(c == name, v) if expr is None else expr.when(c == name, v)
    return expr


def worst_level(*levels: str) -> Column:
    g = F.greatest(*[_rank(lv) for lv in levels])
    expr = None
    for name, v in RISK_RANK.items():
        expr = F.when(g == v, name) if expr is None else expr.when(g == v, name)
    return expr


# Affordability --------------------------------------------------------------------


def weighted_mean(value: str, weight: Column) -> Column:
    """``sum(x*w)/sum(w)`` over rows where x is set (NULL weights count as 1)."""
    w = F.when(F.col(value).isNotNull(), F.coalesce(weight, F.lit(1)))
    return F.sum(F.col(value) * w) / F.sum(w)


def affordability_band(ratio: Column, moderate_from: float = 0.25, stressed_above: float = 0.35) -> Column:
    """< 0.25 affordable, 0.25-0.35 inclusive moderate stress, > 0.35 stressed,
    NULL ratio (income <= 0 or missing) unknown; thresholds are parameters."""
    return (
        F.when(ratio.isNull(), "unknown")
        .when(ratio < moderate_from, "affordable")
        .when(ratio <= stressed_above, "moderate stress")
        .otherwise("housing stressed")
    )


def affordability(
    areas: DataFrame,
    group: str,
    rent: str = "weekly_rent",
    income: str = "income",
    weight: str = "population",
    decile: str | None = "income_decile",
) -> DataFrame:
    """Population-weighted rent and income per group, annual rent = weekly x 52,
    rent-to-income percent and band, weighted decile (A13, G10).

    Rounding follows the tool's half-even rounding (``bround``)."""
    w = F.col(weight)
    aggs = [
        weighted_mean(rent, w).alias("_rent"),
        weighted_mean(income, w).alias("_income"),
    ]
    if decile:
        aggs.append(weighted_mean(decile, w).alias("_decile"))
    g = areas.groupBy(group).agg(*aggs)
    annual = F.col("_rent") * 52
    ratio = F.when(F.col("_income") > 0, annual / F.col("_income"))
    cols = [
        group,
        F.bround("_rent", 0).cast("bigint").alias("median_rent_weekly"),
        F.bround(annual, 0).cast("bigint").alias("annual_rent"),
        F.bround("_income", 0).cast("bigint").alias("household_income_annual"),
        F.bround(ratio * 100, 1).alias("rent_to_income_pct"),
        affordability_band(ratio).alias("affordability_band"),
    ]
    if decile:
        cols.append(F.bround("_decile", 0).cast("int").alias("income_decile"))
    return g.select(*cols)


def affordability_latest(
    area_years: DataFrame,
    areas: DataFrame,
    group: str,
    household_income: float | None = None,
    year: str = "year",
    rent: str = "weekly_rent",
    income: str = "income",
    weight: str = "population",
) -> DataFrame:
    """Affordability per group from the newest year of each of its areas.

    ``area_years`` is ``(area_id, year, rent, income)``, ``areas`` is ``(area_id,
    group, weight)``. The rent is that of each area's newest year with one;
    ``data_year`` is the newest among them. The income is ``household_income`` if
    given, else the weighted mean over the areas that have one in the newest year
    of all, and then the decile is theirs among all areas of that year.
    """
    newest = area_years.filter(F.col(rent).isNotNull()).groupBy("area_id").agg(F.max_by(F.struct(rent, year), year).alias("_n"))
    paid = newest.join(areas, "area_id").select(group, F.col(weight), F.col(f"_n.{rent}").alias(rent), F.col(f"_n.{year}").alias(year))
    w = F.coalesce(F.col(weight), F.lit(1))
    rents = paid.groupBy(group).agg((F.sum(F.col(rent) * w) / F.sum(w)).alias("_rent"), F.max(year).alias("data_year"))
    if household_income is None:
        last = area_years.select(F.max(year)).scalar()
        earned = area_years.filter((F.col(year) == last) & F.col(income).isNotNull()).select("area_id", income)
        earned = exact_ntile(earned, 10, [income, "area_id"], out="_d").join(areas, "area_id")
        incomes = earned.groupBy(group).agg((F.sum(F.col(income) * w) / F.sum(w)).alias("_income"), (F.sum(F.col("_d") * w) / F.sum(w)).alias("_decile"))
        both, source = rents.join(incomes, group, "left"), "area_median"
    else:
        both = rents.select("*", F.lit(float(household_income)).alias("_income"), F.lit(None).cast("double").alias("_decile"))
        source = "user_provided"
    ratio = F.when(F.col("_income") > 0, F.col("_rent") * 52 / F.col("_income"))
    return both.select(
        group,
        "data_year",
        F.lit(source).alias("income_source"),
        F.bround("_rent", 0).cast("bigint").alias("median_rent_weekly"),
        F.bround(F.col("_rent") * 52, 0).cast("bigint").alias("annual_rent"),
        F.bround("_income", 0).cast("bigint").alias("household_income_annual"),
        F.bround(ratio * 100, 1).alias("rent_to_income_pct"),
        affordability_band(ratio).alias("affordability_band"),
        F.bround("_decile", 0).cast("int").alias("income_decile"),
    )

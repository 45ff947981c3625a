"""Transit service-day expansion (A1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def expand_service_days(calendar: DataFrame, exceptions: DataFrame, key: str | Sequence[str] = "service_id") -> DataFrame:
    """``(*key, service_date)`` for every day a service runs; with several
    feeds ``key`` names the feed too, because feeds reuse service ids.

    Calendar ranges are exploded day by day (one row per active day; the
    range length bounds the fan-out), kept where the weekday flag is 1; added
    exception days (type 1) are unioned; removed days (type 2) are taken out
    with an anti join, so a removal wins over an addition; duplicates go.
    """
    keys = [key] if isinstance(key, str) else list(key)
    days = calendar.select(
        *keys, *WEEKDAYS, F.explode(F.sequence("start_date", "end_date")).alias("service_date")
    )
    dow = F.dayofweek("service_date")  # 1 = Sunday ... 7 = Saturday
    flag = F.when(dow == 1, F.col("sunday"))
    for i, d in enumerate(WEEKDAYS[:6]):
        flag = flag.when(dow == i + 2, F.col(d))
    regular = days.filter(flag == 1).select(*keys, "service_date")
    added = exceptions.filter(F.col("exception_type") == 1).select(*keys, F.col("date").alias("service_date"))
    removed = exceptions.filter(F.col("exception_type") == 2).select(*keys, F.col("date").alias("service_date"))
    return (
        regular.unionByName(added)
        .join(removed, [*keys, "service_date"], "left_anti")
        .distinct()
    )

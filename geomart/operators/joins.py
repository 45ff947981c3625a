"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def left_join_drop_key(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left join on differently named keys, dropping the right key."""
    return left.join(right, left[left_key] == right[right_key], "left").drop(right[right_key])

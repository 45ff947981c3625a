"""Data-quality expectations (Q1, Q2).

``expect`` keeps every row and counts violations; ``expect_or_drop`` drops
failing rows (a NULL predicate fails). Counts are gathered in the same pass
as the data through ``DataFrame.observe`` or returned as a report DataFrame.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _pred(p: Column | str) -> Column:
    return F.expr(p) if isinstance(p, str) else p


def passes(p: Column | str) -> Column:
    return F.coalesce(_pred(p), F.lit(False))


def apply_expectations(
    df: DataFrame,
    keep: Mapping[str, Column | str] | None = None,
    drop: Mapping[str, Column | str] | None = None,
    observation: Observation | None = None,
) -> DataFrame:
    """Apply ``keep`` rules (count only) and ``drop`` rules (filter).

    With an ``Observation`` the failure counts per rule are recorded while
    the result is computed (no second scan).
    """
    keep, drop = dict(keep or {}), dict(drop or {})
    out = df
    if observation is not None:
        metrics = [F.count_if(~passes(p)).alias(f"failed_{name}") for name, p in {**keep, **drop}.items()]
        metrics.append(F.count(F.lit(1)).alias("rows_in"))
        out = out.observe(observation, *metrics)
    for p in drop.values():
        out = out.filter(passes(p))
    return out


def expectation_report(
    df: DataFrame,
    keep: Mapping[str, Column | str] | None = None,
    drop: Mapping[str, Column | str] | None = None,
) -> DataFrame:
    """One row per rule: ``(rule, action, failed_rows, total_rows)`` from a
    single aggregate pass."""
    rules = [(n, "warn", p) for n, p in (keep or {}).items()] + [
        (n, "drop", p) for n, p in (drop or {}).items()
    ]
    agg = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(~passes(p)).alias(f"r{i}") for i, (_, _, p) in enumerate(rules)],
    )
    stack = F.array(
        *[
            F.struct(F.lit(n).alias("rule"), F.lit(a).alias("action"), F.col(f"r{i}").alias("failed_rows"))
            for i, (n, a, _) in enumerate(rules)
        ]
    )
    return agg.select(F.inline(stack), "total_rows")


# Coordinate plausibility box used by the address and stop
# rules and by the polygon-centroid filter.
LAT_RANGE = (-47.5, -34.0)
LON_RANGE = (166.0, 179.0)

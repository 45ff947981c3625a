"""Reshaping: unpivot, manifest-driven pivots, sentinels, guarded ratios
(P8, P11-P13, G3, G4, A4)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot_columns(
    df: DataFrame, ids: Sequence[str], value_cols: Sequence[str], name: str = "field", value: str = "value"
) -> DataFrame:
    """Wide -> long ``(ids..., field, value)`` over the listed columns."""
    return df.unpivot(list(ids), list(value_cols), name, value)


def unpivot_prefixed(df: DataFrame, ids: Sequence[str], prefix: str, **kw) -> DataFrame:
    """Unpivot every column whose name starts with ``prefix`` (e.g. ``VAR_``)."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    return unpivot_columns(df, ids, cols, **kw)


def sentinel_to_null(
    col: Column | str, sentinels: Iterable = (), negative_is_null: bool = False
) -> Column:
    """NULL for listed sentinel values (``-999``, ``'All'``) and, optionally,
    for any negative number (P8; which rule applies is a parameter)."""
    c = F.col(col) if isinstance(col, str) else col
    cond = F.lit(False)
    for s in sentinels:
        cond = cond | (c == F.lit(s))
    if negative_is_null:
        cond = cond | (c < 0)
    return F.when(~F.coalesce(cond, F.lit(False)), c)


def guarded_ratio(num: Column | str, den: Column | str, scale: float = 1.0) -> Column:
    """``num / den * scale``, NULL unless ``den > 0``."""
    n = F.col(num) if isinstance(num, str) else num
    d = F.col(den) if isinstance(den, str) else den
    return F.when(d > 0, n / d * scale)


def first_present(df: DataFrame, candidates: Sequence[str], dtype: str = "string") -> Column:
    """First of several candidate column names present in ``df``, coalesced;
    a typed NULL when none exists (P12)."""
    present = [F.col(c) for c in candidates if c in df.columns]
    if not present:
        return F.lit(None).cast(dtype)
    return F.coalesce(*present).cast(dtype)


def manifest_pivot(
    long_df: DataFrame,
    keys: Sequence[str],
    manifest: Sequence[tuple[str, str, str]],
    dataset_col: str = "dataset",
    field_col: str = "field",
    value_col: str = "value",
    agg=F.max,
) -> DataFrame:
    """Long -> wide with one conditional aggregate per manifest entry.

    ``manifest`` rows are ``(output_name, dataset, field)``; the schema is
    fixed by the manifest, so it is one hash aggregate with map-side combine.
    """
    exprs = [
        agg(F.when((F.col(dataset_col) == ds) & (F.col(field_col) == fld), F.col(value_col))).alias(out)
        for out, ds, fld in manifest
    ]
    return long_df.groupBy(*keys).agg(*exprs)


def series_pivot(
    long_df: DataFrame,
    keys: Sequence[str],
    series: Sequence[tuple[str, str, str]],
    series_col: str = "series",
    value_col: str = "value",
    tiebreak: str | None = None,
) -> DataFrame:
    """Conditional first-non-null pivot (G4) made deterministic: per entry
    ``(series_value, output_name, type)`` the non-null value with the least
    ``tiebreak`` (default: the least value)."""
    exprs = []
    for s, out, typ in series:
        v = F.when((F.col(series_col) == s) & F.col(value_col).isNotNull(), F.col(value_col))
        if tiebreak:
            e = F.min_by(v, F.when(v.isNotNull(), F.col(tiebreak)))
        else:
            e = F.min(v)
        exprs.append(e.cast(typ).alias(out))
    return long_df.groupBy(*keys).agg(*exprs)

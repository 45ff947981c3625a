"""Latest-row and de-duplication operators.

All of them are aggregations (``max_by`` / ``min_by`` over a struct of the
row) rather than ``row_number()`` windows: an aggregate combines map-side,
so a key holding a third of all rows never lands whole on one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    latest: bool,
    null_keys_distinct: bool,
) -> DataFrame:
    cols = [c for c in df.columns]
    payload = F.struct(*[F.col(c) for c in cols])
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    agg = F.max_by if latest else F.min_by
    if not null_keys_distinct:
        return df.groupBy(*keys).agg(agg(payload, rank).alias("_row")).select("_row.*")
    # Rows with a NULL key each get their own group through a row id (one
    # scan, one shuffle); rows with full keys share ``_nk = NULL``.
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    tagged = df.withColumn("_nk", F.when(any_null, F.monotonically_increasing_id()))
    return tagged.groupBy(*keys, "_nk").agg(agg(payload, rank).alias("_row")).select("_row.*")


def latest_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    null_keys_distinct: bool = True,
) -> DataFrame:
    """One row per key: the greatest by ``order`` (include a unique column
    last as the tie-break). Rows with a NULL key are each kept (W1, W2)."""
    return _pick(df, keys, order, latest=True, null_keys_distinct=null_keys_distinct)


def dedup_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Deterministic ``dropDuplicates(keys)``: keep the least row by ``order`` (U4)."""
    return _pick(df, keys, order, latest=False, null_keys_distinct=False)


def latest_snapshot(df: DataFrame, source_col: str, date_col: str) -> DataFrame:
    """Rows of each source's latest landing date (G8, R3), per source.

    The per-source maxima form a table with one row per source; joining it
    back is a broadcast whenever adaptive execution measures it as small.
    """
    latest = df.groupBy(source_col).agg(F.max(date_col).alias("_latest"))
    return (
        df.join(latest, source_col)
        .filter(F.col(date_col) == F.col("_latest"))
        .drop("_latest")
    )


def current_state(
    facts: DataFrame, key: str, date_col: str, value_cols: Sequence[str], nonnull: str | None = None
) -> DataFrame:
    """Per key, the value columns at the latest date (T3): ``max_by`` per key.

    ``nonnull`` restricts the candidates to rows where that column is set.
    """
    f = facts if nonnull is None else facts.filter(F.col(nonnull).isNotNull())
    picked = F.max_by(F.struct(F.col(date_col), *[F.col(c) for c in value_cols]), F.col(date_col))
    return f.groupBy(key).agg(picked.alias("_s")).select(key, "_s.*")


def latest_asof_join(
    dim: DataFrame,
    facts: DataFrame,
    dim_key: str,
    fact_key: str,
    date_col: str,
    value_cols: Sequence[str],
    nonnull: str | None = None,
) -> DataFrame:
    """Left join each dimension row to its key's latest fact.

    Replaces ``date = (SELECT max(date) ... WHERE key = outer.key)`` with one
    aggregate per key and one join; dimension rows without facts keep NULLs.
    """
    cur = current_state(facts, fact_key, date_col, value_cols, nonnull)
    if fact_key == dim_key:
        return dim.join(cur, dim_key, "left")
    return dim.join(cur, dim[dim_key] == cur[fact_key], "left").drop(cur[fact_key])

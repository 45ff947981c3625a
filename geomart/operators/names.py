"""Name resolution: exact match first, else case-insensitive contains, top-k
by population (A10, U2, T1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geomart.session import ensure_checkpoint_dir


def top_k_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salt_buckets: int = 16, salt_on: str | None = None
) -> DataFrame:
    """Rows ranked 1..k per group by ``order`` (a total order).

    Two stages so a hot group never sorts whole in one task: first the top k
    within ``salt_buckets`` hash slices of each group, then the top k of
    those (at most ``k * salt_buckets`` rows per group).
    """
    salt = F.pmod(F.hash(F.col(salt_on)), F.lit(salt_buckets)) if salt_on else F.lit(0)
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    stage1 = df.withColumn("_salt", salt).withColumn("_rn", F.row_number().over(w1)).filter(F.col("_rn") <= k)
    return stage1.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k).drop("_salt", "_rn")


#: Characters of an indexed gram, and shares that a gram's postings are cut into.
GRAM = 3
POSTING_SHARES = 16


def grams(text: Column, size: Column) -> Column:
    """Distinct runs of ``size`` characters of the lower-cased ``text``; an empty
    text has itself."""
    t = F.lower(text)
    n = F.length(t)
    runs = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(t, i, size))
    return F.when((n == 0) & (size == 0), F.array(F.lit(""))).when((size > 0) & (n >= size), F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def gram_postings(targets: DataFrame, name_col: str, sizes: Column) -> DataFrame:
    """Inverted index: a row of ``targets`` per gram of its name, for gram sizes
    in the array ``sizes``."""
    per_size = targets.filter(F.col(name_col).isNotNull()).select("*", F.explode(sizes).alias("_size"))
    return per_size.select(*targets.columns, F.explode(grams(F.col(name_col), F.col("_size"))).alias("gram"))


def contains_matches(
    queries: DataFrame, targets: DataFrame, query_col: str, name_col: str, id_col: str, gram: int = GRAM, shares: int = POSTING_SHARES
) -> DataFrame:
    """``(query, *targets)`` for every target whose name contains the query,
    ignoring case.

    A query probes the index by the rarest of its grams (a query shorter than
    ``gram`` characters is one gram itself) and the name is then compared. The
    postings of every gram are cut into ``shares`` by target id and the probes
    sent to each, so a gram that most names have is no single key. The sizes of
    exploded and checkpointed rows are not known to the planner, which would take
    them for those of the table and broadcast the postings; so the joins are
    shuffled and hash the side of the probes.
    """
    ensure_checkpoint_dir(queries.sparkSession)
    size = F.least(F.lit(gram), F.length(F.lower(F.col(query_col))))
    # At most `gram + 1` sizes.
    sizes = queries.select(F.collect_set(size)).scalar()
    # Read by the count of each gram and by the probes: written once.
    postings = gram_postings(targets, name_col, sizes).checkpoint()
    count = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    probes = queries.select(query_col, F.explode(grams(F.col(query_col), size)).alias("gram")).join(count.hint("shuffle_hash"), "gram", "left")
    rarest = probes.groupBy(query_col).agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    rarest = rarest.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    shared = postings.withColumn("_share", F.pmod(F.hash(id_col), F.lit(shares)))
    found = shared.join(rarest.hint("shuffle_hash"), ["gram", "_share"])
    return found.filter(F.contains(F.lower(F.col(name_col)), F.lower(F.col(query_col)))).select(query_col, *targets.columns)


def resolve_names(
    queries: DataFrame,
    targets: DataFrame,
    query_col: str = "query",
    name_col: str = "name",
    id_col: str = "id",
    rank_col: str = "population",
    limit: int = 10,
) -> DataFrame:
    """Per query: all exact name matches; only when there are none, up to
    ``limit`` case-insensitive substring matches by ``rank_col`` desc nulls
    last (id as tie-break). Returns ``(query, id, name, match)``.

    An exact match contains the query too, so one probe of the index gives both.
    """
    ensure_checkpoint_dir(queries.sparkSession)
    q = queries.select(query_col).filter(F.col(query_col).isNotNull()).distinct().checkpoint()
    # Two names that differ in case are one match each, so compare as written.
    cand = contains_matches(q, targets.select(id_col, name_col, rank_col), query_col, name_col, id_col).checkpoint()
    is_exact = F.col(name_col) == F.col(query_col)
    exact = cand.filter(is_exact).select(query_col, id_col, name_col, F.lit("exact").alias("match"))
    rest = cand.filter(query_col + " <> ''").join(exact.select(query_col).distinct().hint("shuffle_hash"), query_col, "left_anti")
    fuzzy = top_k_per_group(
        rest,
        [query_col],
        [F.col(rank_col).desc_nulls_last(), F.col(id_col)],
        limit,
        salt_on=id_col,
    ).select(query_col, id_col, name_col, F.lit("contains").alias("match"))
    return exact.unionByName(fuzzy)

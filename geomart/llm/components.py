"""Connected components of an edge table, by alternating large-star and
small-star steps (Kiveris et al., 2014) as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomart.llm.common import materialise


#: Shares of a node's edges, each a key of its own.
SHARES = 8


def _meet(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with ``m`` of their ``a``."""
    shares = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share")
    dealt = edges.withColumn("share", F.pmod(F.xxhash64("b"), F.lit(SHARES)).cast("int"))
    return dealt.join(least.select("*", shares), ["a", "share"]).drop("share")


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a``, ``b``: long); a
    component is named by its smallest node.

    Each step is written as a table; the number of steps grows with the
    logarithm of the longest chain. A hub is aggregated map-side, and its
    neighbours meet its smallest one in ``SHARES`` shares, so no task holds them
    all.
    """
    kept = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    kept = materialise(kept, name)
    before = None
    while True:
        both = kept.unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _meet(both, least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.filter("a != b").distinct(), name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _meet(large, least).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        kept = materialise(small, name)
        now = kept.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if now == before:
            break
        before = now
    centres = kept.select(F.col("b").alias("node")).distinct()
    return kept.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres.select("node", F.col("node").alias("component")))

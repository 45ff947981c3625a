"""Mixing sources to target weights by systematic sampling.

Each source has a target (words the mix shall take of it), so every document of
the source has the same expected number of copies: target / words of the
source. These are summed up along the source's documents, a random offset (one
per source) is added, and a document is emitted once per integer boundary that
its part of the sum crosses. Documents are walked by size, so what a source
gives differs from its target by less than its largest document (times the
copies over whole ones, a fraction).

Sums are exact integers, in units of ``1 / ONE`` copies, so runs agree whatever
the partitions are.

Cases: a null text has size 0, a null source is a source of its own (the last);
documents without words count as rows, but give no words; rows that repeat a
``doc_id`` are documents of their own; an empty table gives no rows; columns
named like one that is added give way to it.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomart.llm.common import materialise
from geomart.llm.positions import positions

WORD = r"[^\x20\x09-\x0D]+"
#: Units of one copy: 24 bits. Sums stay exact up to 10^11 documents a source.
ONE_BITS = 24
ONE = 1 << ONE_BITS
#: Rows of a source that are joined with its target under one key.
SLICE_ROWS = 1_000_000
ADDED = ["size", "source_size", "target", "copies", "taken"]


def source_targets(sources: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """``sources`` (``source``, ``source_size``) with ``weight`` and ``target``.

    Sources by code point, null last, weigh ``weights`` in turn and share the
    sum of all sizes; a target stops at ``most`` times its source's size, and
    the excess goes to the others by weight, until none is above.
    """
    ranked = positions(sources, [], [F.col("source").asc_nulls_last()], "mix_sources", out="rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = materialise(ranked.withColumn("weight", weight).drop("rank"), "mix_weights")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    number = lambda x: F.lit(Decimal(x)).cast("decimal(18,0)")
    total, weighed = (int(x or 0) for x in ranked.agg(F.sum(exact("source_size")), F.sum(exact("weight"))).first())
    # Sources at their limit: those whose share of what the others leave reaches
    # it. Each round can only add some; three sums a round come to the driver.
    limit, left, share, full = exact("source_size") * F.lit(most), total, weighed, -1
    while True:
        at_limit = limit * number(share) <= number(left) * exact("weight") if share else F.lit(True)
        n, held, gone = ranked.filter(at_limit).agg(F.count("*"), F.sum(limit), F.sum(exact("weight"))).first()
        if n == full:
            break
        full, left, share = n, total - int(held or 0), weighed - int(gone or 0)
    by_weight = F.lit(float(left)) * F.col("weight") / F.lit(float(share or 1))
    return ranked.withColumn("target", F.when(at_limit, (F.col("source_size") * most).cast("double")).otherwise(by_weight))


def mix_sources(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: str = "mix-1"
) -> DataFrame:
    """Columns ``keep`` of every document (``doc_id, source, text``) with its
    ``size`` in words, its ``source_size`` and ``target``, the ``copies`` the
    mix takes and the words they have, ``taken``.

    ``keep=docs.columns`` hands whole documents on, for ``emitted``.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    names = [c for c in keep if c.lower() not in ADDED]
    also = [F.col(f"`{c}`") for c in dict.fromkeys(["doc_id", "source", *names])]
    sized = docs.select(*also, size.alias("size"), F.xxhash64("text").alias("__text"))
    order = [F.col("size"), F.col("doc_id").asc_nulls_first(), F.col("__text")]
    placed = positions(sized, ["source"], order, "mix", out="__pos").withColumn("__slice", F.floor(F.col("__pos") / SLICE_ROWS))
    sources = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("__slice").alias("__slices"))
    sources = source_targets(sources, weights, most)
    units = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * ONE)).otherwise(0).cast("long")
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))), 256), 1, ONE_BITS // 4), 16, 10).cast("long")
    sliced = sources.select(
        F.col("source").alias("__source"), "source_size", "target", units.alias("__units"), drawn.alias("__offset"),
        F.explode(F.sequence(F.lit(0).cast("long"), "__slices")).alias("__of"),
    )
    # A slice of a source is one key, so a hot source is joined by many tasks.
    mixed = placed.join(sliced, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__slice") == F.col("__of")))
    passed = lambda n: F.shiftright(F.col("__units") * (F.col("__pos") + n) + F.col("__offset"), ONE_BITS)
    mixed = mixed.withColumn("copies", passed(1) - passed(0)).withColumn("taken", F.col("copies") * F.col("size"))
    return mixed.select(*[F.col(f"`{c}`") for c in names], *ADDED)


def emitted(mixed: DataFrame) -> DataFrame:
    """One row per copy, ``copy`` from 1; documents without copies go."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))

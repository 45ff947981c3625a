"""Merkle manifest of a table: a digest for every row, one for every group and
one for the whole, and for every row the siblings that prove it.

Nodes of a level are numbered within their group. Each node asks for the
siblings of its run of ``arity`` nodes by their computed numbers (for ``arity``
2 its number XOR 1, otherwise its slot shifted by every offset), an equijoin of
the level with itself; the row in slot zero, with its siblings in order, emits
the parent. Levels are stored tables and shrink by ``arity``, so their number is
the logarithm of the largest group. Proofs are handed down the same levels: a
node's path is its siblings and its parent's path.

Cases: null values count as ``-``; a null group is a group of its own (the
first); null ids come first, ties are ordered by digest, rows that are equal in
all fields are leaves of their own with equal digests; an empty table has no
root and gives no rows; other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomart.llm.common import materialise
from geomart.llm.positions import positions

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SIDES = "array<struct<l:string,r:string>>"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Hex SHA-256 of the fields: each ``-`` if null, else its number of UTF-8
    bytes, a colon and the value."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _climb(nodes: DataFrame, arity: int, name: str) -> list[DataFrame]:
    """Levels over ``nodes`` (``g``, ``idx``, ``digest``, ``own``), lowest first,
    as stored tables: ``l`` and ``r`` are the digests of a node's siblings before
    and after it, ``last`` tells the one node that is left of its group. ``own``
    is handed on at the lowest level only."""
    levels = []
    own_type = nodes.schema["own"].dataType
    while True:
        slot = F.col("idx") % arity
        asked = nodes.select("g", "idx", F.explode(F.sequence(F.lit(0), F.lit(arity - 1))).alias("shift"), "own")
        sibling = F.col("idx").bitwiseXOR(F.col("shift")) if arity == 2 else F.col("idx") - slot + (slot + F.col("shift")) % arity
        asked = asked.select("g", "idx", sibling.alias("sibling"), F.when(F.col("shift") == 0, F.col("own")).alias("own"))
        others = nodes.select(F.col("g").alias("og"), F.col("idx").alias("sibling"), "digest")
        met = asked.join(others, (asked.g == others.og) & (asked.sibling == others.sibling)).select("g", "idx", asked.sibling, "digest", "own")
        # At most `arity` rows each.
        run = met.groupBy("g", "idx").agg(F.array_sort(F.collect_list(F.struct("sibling", "digest"))).alias("run"), F.max("own").alias("own"))
        text = lambda keep: F.array_join(F.transform(F.filter("run", keep), lambda x: x.digest), "")
        level = materialise(
            run.select(
                "g", "idx", "own",
                F.element_at(F.filter("run", lambda x: x.sibling == F.col("idx")), 1).digest.alias("digest"),
                text(lambda x: x.sibling < F.col("idx")).alias("l"),
                text(lambda x: x.sibling > F.col("idx")).alias("r"),
                ((F.col("idx") == 0) & (F.size("run") == 1)).alias("last"),
            ),
            f"{name}_level",
        )
        levels.append(level)
        zero = level.filter(~F.col("last") & (F.col("idx") % arity == 0))
        if zero.isEmpty():
            return levels
        parents = zero.select("g", F.floor(F.col("idx") / arity).alias("idx"), F.sha2(F.concat("digest", "r"), 256).alias("digest"))
        nodes = materialise(parents.withColumn("own", F.lit(None).cast(own_type)), f"{name}_nodes")


def _tops(levels: list[DataFrame]) -> DataFrame:
    """``g, digest`` of the node that is left of each group."""
    out = levels[0].filter("last")
    for level in levels[1:]:
        out = out.unionByName(level.filter("last"))
    return out.select("g", "digest")


def _descend(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """The lowest level with ``top`` and ``path``: siblings of a node and of its
    ancestors, ``tops`` (``g, top, path``) saying how it goes on above a group."""
    above = None
    for level in reversed(levels):
        entry = F.array(F.struct("l", "r"))
        here = level.filter("last").join(tops, "g").select("g", "idx", "own", "digest", "top", "path")
        if above is not None:
            up = above.select(F.col("g").alias("ug"), F.col("idx").alias("up"), "top", "path")
            inner = level.filter(~F.col("last"))
            inner = inner.join(up, (inner.g == up.ug) & (F.floor(inner.idx / arity) == up.up))
            here = here.unionByName(inner.select("g", "idx", "own", "digest", "top", F.concat(entry, "path").alias("path")))
        above = here
    return above


def manifest(rows: DataFrame, tampered: dict[str, Column], arity: int = 8, group: str = "lang", order: str = "doc_id", fields: Sequence[str] = FIELDS) -> DataFrame:
    """``order, group, leaf, subroot, root, path, folded_root`` of every row.

    ``path`` holds, from the leaf up, the digests of the siblings before (``l``)
    and after (``r``) a node. ``folded_root`` is what a verifier gets who has the
    path and the row with the columns of ``tampered`` in place of its own.
    """
    own = [F.col(c) for c in fields]
    digest, other = leaf_digest(own), leaf_digest([tampered.get(c, F.col(c)) for c in fields])
    # A group's key is no null: "" for the null group, which so comes first.
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    changed = F.when(F.lit(False), F.lit(""))
    for name, column in tampered.items():
        changed = F.when(~column.eqNullSafe(F.col(name)), other).otherwise(changed)
    leaves = rows.select(key.alias("g"), F.struct(F.col(order), F.col(group), changed.alias("other")).alias("own"), F.col(order).alias("__order"), digest.alias("digest"))
    leaves = positions(leaves, ["g"], [F.col("__order").asc_nulls_first(), F.col("digest")], "merkle", out="idx").drop("__order")
    levels = _climb(leaves, arity, "merkle")
    subroots = _tops(levels).withColumnRenamed("g", "name")
    ranked = positions(subroots, [], [F.col("name")], "merkle_tops", out="idx")
    heads = _climb(ranked.select(F.lit("").alias("g"), "idx", "digest", F.col("name").alias("own")), arity, "merkle_head")
    root = next((r.digest for r in _tops(heads).take(1)), None)
    start = _tops(heads).select("g", F.col("digest").alias("top"), F.array().cast(_SIDES).alias("path"))
    above = _descend(heads, start, arity).select(F.col("own").alias("g"), F.col("digest").alias("top"), "path")
    proved = _descend(levels, above, arity)
    first = F.coalesce("own.other", "digest")
    folded = F.aggregate("path", first, lambda acc, x: F.sha2(F.concat(x.l, acc, x.r), 256))
    return proved.select(
        F.col(f"own.{order}").alias(order), F.col(f"own.{group}").alias(group), F.col("digest").alias("leaf"), F.col("top").alias("subroot"),
        F.lit(root).cast("string").alias("root"), "path", folded.alias("folded_root"),
    )


def proof_text(path: str = "path") -> Column:
    """The digests of a path in one text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x.l, x.r)), "")

"""Prefix trie of conversations, with totals of every subtree.

A node is a sequence of turns that some conversation starts with, known by its
depth and a rolling hash of its turns (modulo the prime 2^127 - 1, base fixed).
Turns are range-sorted by (conversation, place); each task rolls the hash along
its rows, and what a conversation has in the tasks before is one pair per task.
Nodes are then one aggregate over (depth, hash), combined before the shuffle.

Totals go up the trie by time-forward processing: nodes are sorted by reverse
level order (Spark's external sort) and read in that order; a node takes the
messages that its children left for it in a priority queue, which spills
sorted runs to disk, and leaves its own total for its parent. The trie is cut
into shards of bounded size first: with ``below`` the number of turns under a
node, a *unit* is a subtree with at most ``unit`` of them whose parent has more,
so units are dealt over the tasks however common a first turn is. The nodes
above (at most a few for each task and level) are cut into slabs of ``SLAB``
levels, for conversations of very many turns; totals of the unit roots are added
up by parent and go through the slabs, then across the roots of the slabs.

Cases: rows with a null conversation belong to none; null places come first;
turns that tie are ordered by their digest; a conversation without turns is a
member of the root only; no conversations give no nodes.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomart.llm.common import materialise
from geomart.llm.mixing import WORD
from geomart.llm.positions import PARTITION_ROWS, positions, sorted_ranges

PRIME = (1 << 127) - 1
BASE = 0x5DEECE66D1B54A32D192ED03A7F3C14B
ROOT = bytes(16)
#: Levels of a slab of the nodes above the units.
SLAB = 4096
#: Messages that a queue keeps in memory.
QUEUE_MESSAGES = 200_000


def turn_digests(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, digest, words``: 16 bytes for role and text (null:
    empty), and the words of the text. Texts are not read again."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256), 1, 32))
    words = F.regexp_count(t, F.lit(WORD)).cast("long")
    rows = conversations.filter(F.col(conv).isNotNull())
    return rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), words.alias("words"))


def in_order(turns: DataFrame) -> DataFrame:
    """``turns`` with their place from 0 in the conversation, by turn, nulls first."""
    return positions(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest")], "trie", out="place").drop("turn")


def _bytes(h: int) -> bytes:
    return h.to_bytes(16, "big")


def _roll(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Depth and hash of every prefix, as if each task's first conversation
    began there; ``head`` marks the rows of that conversation."""
    part, at, last, head = TaskContext.get().partitionId(), 0, None, True
    depth = h = 0
    for frame in frames:
        out = []
        for conv, digest, words in zip(frame["conv_id"].tolist(), frame["digest"], frame["words"].tolist()):
            if conv != last:
                head, last, depth, h = last is None, conv, 0, 0
            parent, h, depth = h, (h * BASE + int.from_bytes(digest, "big")) % PRIME, depth + 1
            out.append((part, at, head, conv, depth, _bytes(h), _bytes(parent), words))
            at += 1
        yield pd.DataFrame(out, columns=["part", "at", "head", "conv_id", "depth", "key", "parent", "words"])


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, key, parent, words`` of every prefix of every
    conversation, from ``conv_id, place, digest, words``; a stored table."""
    spark = turns.sparkSession
    stored = materialise(turns.select("conv_id", "place", "digest", "words"), "trie_turns")
    ranges = sorted_ranges(stored, [F.col("conv_id"), F.col("place"), F.col("digest")])
    rolled = materialise(
        ranges.mapInPandas(_roll, "part int, at long, head boolean, conv_id long, depth long, key binary, parent binary, words long"), "trie_rolled"
    )
    ends = rolled.groupBy("part").agg(F.min_by("conv_id", "at").alias("first"), F.max_by(F.struct("conv_id", "depth", "key", "head"), "at").alias("last"))
    carried, before = None, {}
    # One row per task.
    for r in sorted(ends.collect(), key=lambda r: r["part"]):
        conv, depth, key, head = r["last"]
        h = int.from_bytes(key, "big")
        if carried and carried[0] == r["first"]:
            before[r["part"]] = carried[1:]
            if head:
                h, depth = (carried[2] * pow(BASE, depth, PRIME) + h) % PRIME, depth + carried[1]
        carried = (conv, depth, h)
    columns = ["conv_id", "depth", "key", "parent", "words"]
    if not before:
        return rolled.select(*columns)

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for part, conv, depth, key, parent, words in frame.itertuples(index=False):
                more, h = before[part]
                step = h * pow(BASE, depth - 1, PRIME) % PRIME
                key = _bytes((step * BASE + int.from_bytes(key, "big")) % PRIME)
                out.append((conv, depth + more, key, _bytes((step + int.from_bytes(parent, "big")) % PRIME), words))
            yield pd.DataFrame(out, columns=columns)

    cut = F.col("head") & F.col("part").isin(*before)
    mended = rolled.filter(cut).select("part", *columns).mapInPandas(join, "conv_id long, depth long, key binary, parent binary, words long")
    return materialise(rolled.filter(~cut).select(*columns).unionByName(mended), "trie_prefixes")


class SpillingQueue:
    """Messages in ascending order of their key; beyond ``most`` in memory they
    go to sorted runs in unnamed files, which end with the task."""

    def __init__(self, most: int = QUEUE_MESSAGES) -> None:
        self.most, self.heap, self.runs, self.heads = most, [], [], []

    def push(self, key: tuple, value: tuple) -> None:
        heapq.heappush(self.heap, (key, value))
        if len(self.heap) > self.most:
            run = tempfile.TemporaryFile()  # noqa: SIM115
            for item in sorted(self.heap):
                pickle.dump(item, run)
            run.seek(0)
            self.heap = []
            self.runs.append(run)
            self._refill(len(self.runs) - 1)

    def _refill(self, run: int) -> None:
        try:
            heapq.heappush(self.heads, (*pickle.load(self.runs[run]), run))
        except EOFError:
            self.runs[run].close()

    def take(self, key: tuple) -> Iterator[tuple]:
        """The values left for ``key``; smaller keys must be gone already."""
        while self.heap and self.heap[0][0] == key:
            yield heapq.heappop(self.heap)[1]
        while self.heads and self.heads[0][0] == key:
            _, value, run = heapq.heappop(self.heads)
            self._refill(run)
            yield value


def time_forward(nodes: DataFrame, shard: list[str], most: int = QUEUE_MESSAGES) -> DataFrame:
    """``nodes`` with ``children``, ``leaves`` and ``saved`` added up from the
    nodes below in the same shard (these come in as a node's own part). A node
    with ``top`` is the root of its shard and leaves no message."""
    fields = nodes.schema.fieldNames()
    at = {c: fields.index(c) for c in ("depth", "key", "parent", "top", "children", "leaves", "saved")}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queue = SpillingQueue(most)
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                row = list(row)
                children, leaves, saved = row[at["children"]], row[at["leaves"]], row[at["saved"]]
                for a, b in queue.take((-row[at["depth"]], row[at["key"]])):
                    children, leaves, saved = children + 1, leaves + a, saved + b
                row[at["children"]], row[at["leaves"]], row[at["saved"]] = children, leaves, saved
                if not row[at["top"]]:
                    queue.push((1 - row[at["depth"]], row[at["parent"]]), (leaves, saved))
                out.append(row)
            yield pd.DataFrame(out, columns=fields)

    least = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("depth").desc(), F.col("key")]
    return nodes.repartition(least, *shard).sortWithinPartitions(*order).mapInPandas(run, nodes.schema)


def _messages(done: DataFrame, where: str) -> DataFrame:
    """What the shard roots of ``done`` leave for their parents, by parent."""
    roots = done.filter(where).groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("key"))
    return roots.agg(F.count("*").alias("c"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))


def _with(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    joined = nodes.join(messages, ["depth", "key"], "left")
    for own, sent in (("children", "c"), ("leaves", "l"), ("saved", "s")):
        joined = joined.withColumn(own, F.col(own) + F.coalesce(sent, F.lit(0)))
    return joined.select(*nodes.columns)


def _ends_digest(ends: DataFrame) -> DataFrame:
    """``depth, key, ends_sha256``: the conversations that end in a node. Sorted
    ids are written out in runs by many tasks; only the text of a node's runs
    meets in one task, which reads it as a stream."""

    def spell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at = TaskContext.get().partitionId(), 0
        for frame in frames:
            new = ((frame["depth"] != frame["depth"].shift()) | (frame["key"] != frame["key"].shift())).cumsum()
            out = []
            for _, g in frame.groupby(new, sort=False):
                out.append((g["depth"].iloc[0], g["key"].iloc[0], part, at, ",".join(map(str, g["conv_id"].tolist()))))
                at += 1
            yield pd.DataFrame(out, columns=["depth", "key", "part", "at", "ids"])

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, sha = None, None
        for frame in frames:
            out = []
            for depth, key, ids in zip(frame["depth"].tolist(), frame["key"], frame["ids"]):
                if (depth, key) == last:
                    sha.update(b"," + ids.encode())
                    continue
                if last is not None:
                    out.append((*last, sha.hexdigest()))
                last, sha = (depth, key), hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["depth", "key", "ends_sha256"])
        if last is not None:
            yield pd.DataFrame([(*last, sha.hexdigest())], columns=["depth", "key", "ends_sha256"])

    least = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = sorted_ranges(ends, [F.col("depth"), F.col("key"), F.col("conv_id")])
    runs = runs.mapInPandas(spell, "depth long, key binary, part int, at long, ids string")
    runs = runs.repartition(least, "depth", "key").sortWithinPartitions("depth", "key", "part", "at")
    return runs.mapInPandas(digest, "depth long, key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame, unit: int | None = None, slab: int = SLAB, most: int = QUEUE_MESSAGES) -> DataFrame:
    """Nodes of the trie over ``turns`` (``conv_id, place, digest, words``) of the
    conversations ``members`` (``conv_id``, distinct): ``conv_id`` (the smallest
    member) and ``depth`` name a node; with its ``key`` and its parent's, members
    (``n_convs``), children, leaves of its subtree, tokens that sharing saves in
    it, and the digest of the members that end in it. ``unit`` defaults to a
    quarter of a task's share of the turns.
    """
    spark = turns.sparkSession
    paths = prefixes(turns)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = paths.count()
    unit = max(1, total // (4 * max(least, total // PARTITION_ROWS))) if unit is None else unit

    reached = paths.groupBy("conv_id").agg(F.max("depth").alias("turns"), F.max_by("key", "depth").alias("key"))
    ends = materialise(
        members.join(reached, "conv_id", "left").select("conv_id", F.coalesce("turns", F.lit(0)).alias("depth"), F.coalesce("key", F.lit(ROOT)).alias("key")), "trie_ends"
    )
    head = ends.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    root = head.select(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"), F.lit(ROOT).alias("parent"), F.lit(0).cast("long").alias("words"), "n_convs", "conv_id", F.lit(total).cast("long").alias("below"))
    longer = paths.join(ends.select("conv_id", F.col("depth").alias("turns")), "conv_id")
    inner = longer.groupBy("depth", "key").agg(
        F.min("parent").alias("parent"), F.max("words").alias("words"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum(F.col("turns") - F.col("depth")).alias("below")
    )
    leaf = (F.col("below") == 0).cast("long")
    nodes = root.unionByName(inner).withColumns(
        {"high": (F.col("below") > unit) | (F.col("depth") == 0), "children": F.lit(0).cast("long"), "leaves": leaf, "saved": (F.col("n_convs") - 1) * F.col("words")}
    )
    nodes = materialise(nodes.drop("words"), "trie_nodes")
    high = nodes.filter("high")

    # The first node below the high ones on each conversation's path.
    marks = paths.join(high.select("depth", "key", "high"), ["depth", "key"], "left")
    units = marks.groupBy("conv_id").agg(F.min(F.when(F.col("high").isNull(), F.struct(F.col("depth").alias("unit_depth"), F.col("key").alias("unit_key")))).alias("u"))
    low = nodes.filter("NOT high").join(units.filter("u IS NOT NULL").select("conv_id", "u.*"), "conv_id")
    low = low.withColumn("top", (F.col("depth") == F.col("unit_depth")) & (F.col("key") == F.col("unit_key")))
    low = materialise(time_forward(low, ["unit_depth", "unit_key"], most), "trie_low").drop("unit_depth", "unit_key")

    high = _with(high, _messages(low, "top")).withColumn("slab", F.floor(F.col("depth") / slab))
    levels = high.agg(F.max("slab")).first()[0] or 0
    if not levels:
        high = time_forward(high.withColumn("top", F.col("depth") == 0), ["slab"], most)
    else:
        high = _across_slabs(materialise(high, "trie_high"), paths, slab, most)
    high = materialise(high.select(*low.columns), "trie_high")

    done = low.unionByName(high).join(_ends_digest(ends), ["depth", "key"], "left")
    done = done.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    # A parent with very many children is high, and high nodes are few.
    parents = lambda n: n.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    under_high = done.filter(F.col("high") | F.col("top")).join(parents(high), ["depth", "parent"], "left")
    under_low = done.filter(~F.col("high") & ~F.col("top")).join(parents(low), ["depth", "parent"], "left")
    return under_high.unionByName(under_low).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), "ends_sha256", "key", "parent",
    )


def _across_slabs(high: DataFrame, paths: DataFrame, slab: int, most: int) -> DataFrame:
    """Totals of ``high`` nodes in slabs of levels: within each slab, then across
    the slab roots, then within each slab again with what comes from below."""
    starts = paths.filter(F.col("depth") % slab == 0).select(F.col("conv_id").alias("sc"), F.floor(F.col("depth") / slab).alias("ss"), F.col("key").alias("slab_key"))
    nodes = high.join(starts, (high.conv_id == starts.sc) & (high.slab == starts.ss), "left").drop("sc", "ss")
    nodes = nodes.withColumn("slab_key", F.coalesce("slab_key", F.lit(ROOT))).withColumn("top", F.col("depth") % slab == 0)
    nodes = materialise(nodes, "trie_slabs")
    within = materialise(time_forward(nodes, ["slab", "slab_key"], most), "trie_within").filter("top")
    # Slab roots as a trie of their own: depth is the slab, the parent the root
    # of the slab above.
    over = starts.select("sc", (F.col("ss") + 1).alias("ss"), F.col("slab_key").alias("over"))
    tops = within.join(over, (within.conv_id == over.sc) & (within.slab == over.ss), "left")
    tops = tops.select(
        F.col("slab").alias("depth"), "key", F.coalesce("over", F.lit(ROOT)).alias("parent"), (F.col("slab") == 0).alias("top"), "children", "leaves", "saved",
        F.col("depth").alias("at"), F.col("parent").alias("up"), F.lit(0).alias("one"),
    )
    full = time_forward(tops, ["one"], most).filter("NOT top").select(F.col("at").alias("depth"), F.col("up").alias("parent"), "leaves", "saved")
    sent = materialise(_messages(full, "true"), "trie_sent")
    return time_forward(_with(nodes, sent), ["slab", "slab_key"], most)

"""Similarity self-join of documents on word n-gram sets: MinHash banding,
then verification of every candidate pair on the full sets.

Steps: texts with the same words collapse into one representative; each
representative gets ``bands`` hashes of ``rows`` minima, with both numbers
chosen for the target recall at the threshold; representatives that share a
band hash are joined by an edge to the smallest of them, and components of
these edges are the groups in which pairs are verified. A large group is cut
into blocks, and each pair of blocks is verified in a task of its own, so no
task holds a group and no row is made per pair: a task returns, per document,
its number of links and one edge to the smallest document linked to it.

The recall of the candidate search is at least ``RECALL`` for a pair at the
threshold and rises with its similarity; what is verified is exact up to
64-bit hashes of the n-grams.

Cases: words are runs of bytes other than ASCII white space, unchanged; a text
of fewer than n words has one n-gram, all its words; texts without words
(null, empty or blank) are copies of each other; rows that repeat a ``doc_id``
are counted like other rows; a row with a null ``doc_id`` belongs to no class
and has no links; an empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomart.llm.common import materialise, passes, text_key
from geomart.llm.components import components
from geomart.llm.words import mix, token_hashes, window_hashes

THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 128
#: Documents in a block of a group, and in a task's unit of small groups.
BLOCK = 512
#: Bits of the filter that keeps texts without candidates from the shuffle (8 MB).
FILTER_BITS = 1 << 26

_SIGNED = "doc_id long, _k long, w1 long, w2 long, n_grams int, bands array<long>"


def choose_bands(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows (fewest chance candidates) with which a
    pair at the threshold shares a band with probability ``recall`` and at most
    ``most`` hashes are needed; bands of one row, as many as that takes, where
    even these need more."""
    found = None
    for rows in range(1, most + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if found and bands * rows > most:
            break
        found = (bands, rows)
    return found


def gram_hashes(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's word n-grams (in order, repeats kept) and offsets."""
    words, offsets = token_hashes(texts)
    grams, at = window_hashes(words, offsets, width)
    short = np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) < width))
    if not len(short):
        return grams, at
    # A short text is one n-gram; the seed keeps it apart from longer ones.
    lone = [_sequence_hash(words[offsets[i] : offsets[i + 1]], 7) for i in short.tolist()]
    count = np.diff(at)
    count[short] = 1
    return np.insert(grams, at[short], np.array(lone, np.uint64)), np.concatenate([[0], np.cumsum(count)])


def _sequence_hash(words: np.ndarray, seed: int) -> int:
    power = np.cumprod(np.full(len(words) + 1, 0xD1342543DE82EF95 + 2 * seed, np.uint64), dtype=np.uint64)
    return int(mix(np.sum(words * power[1:], dtype=np.uint64, keepdims=True) + power[-1:] * np.uint64(seed + 1))[0])


def _signatures(width: int, bands: int, rows: int):
    rng = np.random.default_rng(20_240_805)
    scale = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    shift = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in passes(frames):
            texts = part["text"].tolist()
            words, offsets = token_hashes(texts)
            grams, at = gram_hashes(texts, width)
            some = np.flatnonzero(np.diff(at))
            low = (grams >> np.uint64(32)).astype(np.uint32)
            key = np.zeros((len(texts), bands), np.uint64)
            for band in range(bands):
                for r in range(band * rows, (band + 1) * rows):
                    if len(some):
                        least = np.minimum.reduceat((low ^ shift[r]) * scale[r], at[some])
                        key[some, band] = mix(key[some, band] * np.uint64(31) + least + np.uint64(1))
            lists = [k.view(np.int64).tolist() if n else [] for k, n in zip(key, np.diff(at))]
            cut = [words[a:b] for a, b in zip(offsets, offsets[1:])]
            yield pd.DataFrame({
                "doc_id": part["doc_id"].to_numpy(), "_k": part["_k"].to_numpy(),
                "w1": np.array([_sequence_hash(w, 1) for w in cut], np.uint64).view(np.int64),
                "w2": np.array([_sequence_hash(w, 2) for w in cut], np.uint64).view(np.int64),
                "n_grams": np.diff(at), "bands": lists,
            })

    return sign


def _verify(width: int, threshold: float):
    """One unit: documents of whole small groups, or of two blocks of a large
    one. Counts links and joins linked documents; makes no row per pair."""

    def unit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["node", "one", "two"]).reset_index(drop=True)
        sets: list[np.ndarray] = []
        for part in passes(iter([frame])):
            grams, at = gram_hashes(part["text"].tolist(), width)
            sets += [np.unique(grams[a:b]) for a, b in zip(at, at[1:])]
        node, copies = frame["node"].to_numpy(), frame["copies"].to_numpy()
        links, weight, parent = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64), node.copy()
        for (_, one, two), rows in frame.groupby(["component", "one", "two"]).indices.items():
            rows = rows[np.argsort(node[rows])]
            sizes = np.array([len(sets[i]) for i in rows])
            values, place = np.unique(np.concatenate([sets[i] for i in rows]), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            block = frame["block"].to_numpy()[rows]
            has = np.zeros(len(values), bool)
            root = np.arange(len(rows))
            for i, row in enumerate(rows):
                if not sizes[i]:
                    continue
                mine = place[starts[i] : starts[i] + sizes[i]]
                has[mine] = True
                shared = np.add.reduceat(has[place].astype(np.int64), np.minimum(starts, len(place) - 1))
                has[mine] = False
                linked = (sizes > 0) & (shared >= threshold * (sizes[i] + sizes - shared) - 1e-9)
                linked[i] = False
                if one != two:
                    linked &= block != block[i]
                near = np.flatnonzero(linked)
                links[row] = len(near)
                weight[row] = copies[rows[near]].sum()
                for j in near[near < i]:
                    a, b = _find(root, i), _find(root, int(j))
                    root[max(a, b)] = min(a, b)
            parent[rows] = node[rows[[_find(root, i) for i in range(len(rows))]]]
        return pd.DataFrame({"node": node, "links": links, "weight": weight, "parent": parent})

    return unit


def _find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = int(root[i])
    return i


def _among(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``docs`` without most rows that are not ``members`` (by ``doc_id, _k``):
    those whose bit is not set in a bitmap of ``FILTER_BITS`` bits, which comes
    to the driver in at most ``FILTER_BITS / 64`` words and goes to the tasks."""
    bit = F.xxhash64("doc_id", "_k").bitwiseAND(FILTER_BITS - 1)
    words = members.select(bit.alias("b")).groupBy(F.shiftright("b", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b & 63 AS INT))")).alias("bits")).toPandas()
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def has_bit(b: pd.Series) -> pd.Series:
        b = b.to_numpy()
        return pd.Series((shared.value[b >> 6] >> (b & 63)) & 1 == 1)

    return docs.filter(has_bit(bit))


def similar_documents(docs: DataFrame, width: int = 5, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_key, class_id, n_links,
    n_text_links``.

    ``class_id`` is the smallest ``doc_id`` that links lead to (the document's
    own if it has none). ``n_links`` counts other rows whose n-gram set has a
    Jaccard similarity of at least ``threshold``, copies included;
    ``n_text_links`` counts the different texts among them.
    """
    bands, rows = choose_bands(threshold, recall)
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), text_key(text).alias("_k"))
    signed = materialise(keyed.mapInPandas(_signatures(width, bands, rows), _SIGNED).withColumn("row", F.monotonically_increasing_id()), "signed")
    named = signed.filter("doc_id IS NOT NULL")
    # Copies: the row of the smallest id stands for all, found by its number.
    texts = named.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "row")).alias("least"), F.count("*").alias("copies"))
    texts = materialise(texts.select("w1", "w2", F.col("least.doc_id").alias("least"), F.col("least.row").alias("node"), "copies"), "texts")
    nodes = materialise(named.withColumnRenamed("row", "node").join(texts.select("node", "copies"), "node").drop("w1", "w2"), "nodes")
    keys = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    least = keys.groupBy("band", "key").agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n > 1")
    edges = keys.join(least, ["band", "key"]).select(F.col("node").alias("a"), "b")
    groups = components(edges, "candidates")

    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    total = groups.count()
    units = max(1, -(-total // block))
    blocked = groups.join(sizes, "component").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = materialise(blocked.join(nodes.select("node", "doc_id", "_k", "copies"), "node"), "members")
    # Few texts have candidates: the others are left out before the shuffle.
    body = _among(keyed.filter("doc_id IS NOT NULL"), members).join(members, ["doc_id", "_k"])
    spread = body.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "component", "node", "copies", "block", "text",
        F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(units))).otherwise(F.lit(-1)).alias("shared"),
    )
    unit = F.xxhash64("shared", F.when(F.col("shared") < 0, F.col("component")), "one", "two")
    verified = spread.withColumn("unit", unit).groupBy("unit").applyInPandas(_verify(width, threshold), "node long, links long, weight long, parent long")
    verified = materialise(verified, "verified")
    counted = verified.groupBy("node").agg(F.sum("links").alias("links"), F.sum("weight").alias("weight"))
    classes = components(verified.select(F.col("node").alias("a"), F.col("parent").alias("b")), "classes")
    own = texts.join(counted, "node", "left").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = own.groupBy("component").agg(F.min("least").alias("class_id"))
    own = own.join(names, "component").select("w1", "w2", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("weight", F.lit(0)).alias("weight"))
    out = signed.join(own, ["w1", "w2"], "left")
    counted_row = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id", F.col("_k").alias("text_key"), F.when(counted_row, F.col("class_id")).alias("class_id"),
        F.when(counted_row, F.col("weight") + F.col("copies") - 1).otherwise(0).alias("n_links"),
        F.when(counted_row, F.col("links")).otherwise(0).alias("n_text_links"),
    )

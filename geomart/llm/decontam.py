"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Both sides are words in lower case without punctuation (of any script). An n-gram of a test
item is a seed if it is rare, that is if its words together carry at least
``RARE_NATS`` nats under the unigram frequencies of the whole corpus; so a seed
hits one position in exp(RARE_NATS) by chance at any corpus size, and an item
that was copied into very many documents keeps its seeds. Rare
n-grams often stand around one word, and a copy edited there has none of them, so
every stretch of an item without a rare one has its rarest as a seed. Passages around seed
hits are aligned with the whole item; the score is the best local alignment
over that of a perfect copy.

Items go to the tasks in blocks of bounded size, all documents being read for
each block, so a benchmark of any size is joined whole.

Cases: a null or empty text has no passage; an item with fewer words than a
seed never matches; rows that repeat an ``item_id`` or ``doc_id`` are items and
documents of their own; a null id stays null in the result; empty tables give
an empty result. Other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomart.llm.common import passes, text_key
from geomart.llm.words import WORDS_ONLY, token_hashes, window_hashes

SEED_WORDS = 3
RARE_NATS = 18.0
LEAST_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bytes of item text in a block, on average; a block is broadcast with its task.
BLOCK_BYTES = 4 << 20

FOUND = "doc_id long, text_key long, item_id long, score double, first_word long, last_word long, n_item_words int"


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and the place in ``passage`` where it ends
    (exclusive). Rows of the table are computed at once: the best way to come
    from the left is a running maximum."""
    slope = np.arange(len(passage) + 1) * GAP
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        step = np.where(passage == word, MATCH, MISMATCH)
        into = np.zeros_like(row)
        into[1:] = np.maximum(0, np.maximum(row[:-1] + step, row[1:] + GAP))
        row = np.maximum.accumulate(into - slope) + slope
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


#: Which characters beyond ASCII are punctuation.
_PUNCTUATION = np.array([c >= 0x80 and unicodedata.category(chr(c))[0] == "P" for c in range(1 << 16)])


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return token_hashes([t.lower() if isinstance(t, str) else None for t in texts], WORDS_ONLY, _PUNCTUATION)


def _count_words(vocabulary: np.ndarray):
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, total = np.zeros(len(vocabulary) + 1, np.int64), 0
        for part in passes(frames):
            words, _ = _words(part["text"].tolist())
            at = np.searchsorted(vocabulary, words)
            at[at == len(vocabulary)] = 0
            known = vocabulary[at] == words
            found[:-1] += np.bincount(at[known], minlength=len(vocabulary))
            found[-1] += len(words)
        some = np.flatnonzero(found)
        yield pd.DataFrame({"word": some, "n": found[some]})

    return count


def rare_seeds(items: list[np.ndarray], nats: dict[int, float], width: int, rare: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted seed hashes, and for each its item and place in the item."""
    seeds, of, place = [], [], []
    for i, words in enumerate(items):
        grams, _ = window_hashes(words, np.array([0, len(words)]), width)
        if not len(grams):
            continue
        carried = np.convolve([nats[w] for w in words.tolist()], np.ones(width), "valid")
        # The rarest of each stretch that one edited word can spoil, and all rare ones.
        stretches = [a + int(carried[a : a + width].argmax()) for a in range(0, len(grams), width)]
        spoiled = [s for s in stretches if not (carried[s // width * width :][:width] >= rare).any()]
        chosen = np.unique(np.concatenate([np.flatnonzero(carried >= rare), np.array(spoiled, np.int64)]))
        seeds.append(grams[chosen])
        of.append(np.full(len(chosen), i))
        place.append(chosen)
    if not seeds:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    s, o, p = np.concatenate(seeds), np.concatenate(of), np.concatenate(place)
    order = np.argsort(s, kind="stable")
    return s[order], o[order], p[order]


def regions(starts: np.ndarray, length: int, n_words: int) -> list[tuple[int, int]]:
    """Parts of a document to align with an item of ``length`` words, from the
    places where seeds say that it starts; slack for insertions on both sides."""
    slack = length // 4 + 5
    out: list[tuple[int, int]] = []
    for s in np.sort(starts).tolist():
        a, b = max(0, s - slack), min(n_words, s + length + slack)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _align(names: list[int | None], items: list[np.ndarray], seeds: np.ndarray, of: np.ndarray, place: np.ndarray, width: int, least_score: float):
    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in passes(frames):
            words, offsets = _words(part["text"].tolist())
            grams, at = window_hashes(words, offsets, width)
            low = np.searchsorted(seeds, grams, "left")
            hits = np.flatnonzero((low < len(seeds)) & (seeds[np.minimum(low, len(seeds) - 1)] == grams))
            many = np.searchsorted(seeds, grams[hits], "right") - low[hits]
            hit = np.repeat(hits, many)
            seed = np.repeat(low[hits], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            doc = np.searchsorted(at, hit, "right") - 1
            start = hit - at[doc] - place[seed]
            rows = []
            for (d, i), found in pd.DataFrame({"doc": doc, "item": of[seed]}).groupby(["doc", "item"]).indices.items():
                mine, item = words[offsets[d] : offsets[d + 1]], items[i]
                best = (0, 0, 0, 0)
                for a, b in regions(start[found], len(item), len(mine)):
                    score, end = smith_waterman(item, mine[a:b])
                    best = max(best, (score, -a, a, a + end))
                score, _, a, end = best
                if score >= least_score * MATCH * len(item):
                    _, back = smith_waterman(item[::-1], mine[a:end][::-1])
                    rows.append((part["doc_id"].iloc[d], part["_k"].iloc[d], names[i], score / (MATCH * len(item)), end - back, end, len(item)))
            if rows:
                frame = pd.DataFrame(rows, columns=["doc_id", "text_key", "item_id", "score", "first_word", "last_word", "n_item_words"])
                yield frame.astype({"doc_id": "Int64", "item_id": "Int64"})

    return align


def leaks(
    docs: DataFrame,
    items: DataFrame,
    width: int = SEED_WORDS,
    rare: float = RARE_NATS,
    least_score: float = LEAST_SCORE,
    block_bytes: int = BLOCK_BYTES,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """One row per document and item found in it: the score (1: whole copy) and
    the words of the document that the best alignment covers (end exclusive).
    ``text_key`` tells rows with the same ``doc_id`` apart."""
    spark = docs.sparkSession
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), text_key(text).alias("_k")).filter(F.length("text") > 0)
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).filter(F.length("text") > 0)
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    dealt = asked.withColumn("_b", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    out = spark.createDataFrame([], FOUND)
    for b in range(blocks):
        rows = dealt.filter(F.col("_b") == b).collect()  # bounded: one block of the benchmark
        words, offsets = _words([r["text"] for r in rows])
        mine = [words[x:y] for x, y in zip(offsets, offsets[1:])]
        vocabulary = np.unique(words)
        if not len(vocabulary):
            continue
        counted = named.mapInPandas(_count_words(vocabulary), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
        n = np.zeros(len(vocabulary) + 1)
        for r in counted:
            n[r["word"]] = r["n"]
        share = (n[:-1] + 1) / (n[-1] + len(vocabulary))
        seeds, of, place = rare_seeds(mine, dict(zip(vocabulary.tolist(), (-np.log(share)).tolist())), width, rare)
        if len(seeds):
            out = out.unionByName(named.mapInPandas(_align([r["item_id"] for r in rows], mine, seeds, of, place, width, least_score), FOUND))
    return out

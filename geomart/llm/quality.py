"""Quality filter by importance resampling of hashed n-grams.

Two generative models over hashed word unigrams and bigrams are counted: the
target from documents labelled good and the raw one from all documents. A
document's importance weight is the ratio of its probabilities under both; a
sample of documents without replacement, in proportion to their weights, is
what the Gumbel top-k trick keeps: the k largest log weights after adding
Gumbel noise (drawn from a keyed hash of the id, so a rerun draws the same).

The target is counted on at most ``MOST_LABELLED`` labelled documents (a
documented bound; those with the smallest keyed hash of their id); the raw
model covers all words of all documents. k is a share of all documents.

Cases: a null or empty text has weight 1 (log 0); a null label is no label; if
no document is labelled good all weights are 1; a null ``doc_id`` draws its
noise from the text; rows tied at the cut (repeated rows) are all kept; an
empty table gives an empty result. Other columns are carried along; one named
like an added column gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomart.llm.common import carried, materialise, passes
from geomart.llm.words import WORD_PUNCT, mix, token_hashes

BUCKETS = 1 << 16
MOST_LABELLED = 20_000
SEED = 17


def gram_buckets(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every unigram and bigram, and the number in front of each text.

    Tokens are runs of letters, digits and other characters, or of ASCII
    punctuation."""
    h, offsets = token_hashes(texts, WORD_PUNCT)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[owner[:-1] == owner[1:]] if len(h) else h
    grams = np.concatenate([h, pair]) % np.uint64(buckets)
    of = np.concatenate([owner, owner[:-1][owner[:-1] == owner[1:]]]) if len(h) else owner
    return grams.astype(np.int64), of


def _counter(target: np.ndarray, buckets: int):
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for part in passes(frames):
            grams, of = gram_buckets(part["text"].tolist(), buckets)
            raw += np.bincount(grams, minlength=buckets)
            mine = np.isin(part["doc_id"].fillna(-1).to_numpy(np.int64), target) & part["doc_id"].notna().to_numpy()
            if mine.any():
                good += np.bincount(grams[mine[of]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": some, "raw": raw[some], "good": good[some]})

    return count


def labelled_sample(labels: DataFrame, good: Column, most: int, doc_id: str = "doc_id") -> np.ndarray:
    """Ids of at most ``most`` labelled documents, those with the smallest hash."""
    ids = labels.filter(good & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id")).distinct()
    rows = ids.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(most).collect()
    return np.sort(np.array([r["id"] for r in rows], np.int64))


def fit_log_ratio(docs: DataFrame, target: np.ndarray, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """Log ratio of target to raw probability of each bucket (add-one smoothed).

    Each task sums its counts first and sends at most one row per bucket; the
    driver gets one row per bucket."""
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = named.mapInPandas(_counter(target, buckets), "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()
    raw, good = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    if not good.any():
        return np.zeros(buckets)
    return np.log((good + 1) / (good.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))


def log_weight(ratio: np.ndarray, text: str = "text") -> Column:
    """Log importance weight of a text: the sum over its n-grams."""
    buckets = len(ratio)

    @F.pandas_udf("double")
    def weigh(texts: pd.Series) -> pd.Series:
        out = []
        for part in passes(iter([pd.DataFrame({"text": texts})])):
            grams, of = gram_buckets(part["text"].tolist(), buckets)
            out.append(np.bincount(of, weights=ratio[grams], minlength=len(part)))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return weigh(F.col(text))


def gumbel_key(weight: Column, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> Column:
    """Log weight plus Gumbel noise from a hash of the id."""
    named = F.xxhash64(F.col(doc_id).cast("long"), F.lit(seed))
    drawn = F.when(F.col(doc_id).isNotNull(), named).otherwise(F.xxhash64(F.col(text), F.lit(seed)))
    u = (F.pmod(drawn, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return weight - F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int, pieces: int = 4096) -> float:
    """The k-th largest value of the column ``key``, exactly: the interval that
    holds it is cut into ``pieces`` and counted, until it is one value."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    while low < high:
        width = (high - low) / pieces
        piece = F.least(F.lit(pieces - 1), F.floor((F.col("key") - low) / width)).alias("piece") if width > 0 else (F.col("key") > low).cast("long").alias("piece")
        inside = keys.filter((F.col("key") >= low) & (F.col("key") <= high))
        rows = inside.groupBy(piece).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for r in sorted(rows, key=lambda r: -r["piece"]):
            if k <= r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return low


def resample(
    docs: DataFrame,
    labels: DataFrame,
    good: Column,
    share: float | None = None,
    buckets: int = BUCKETS,
    most_labelled: int = MOST_LABELLED,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that are kept, with ``log_weight`` and ``sample_key``.

    ``good`` is a condition over ``labels``. ``share`` is the share of all rows
    to keep; by default that of good ones among the labelled."""
    if share is None:
        share = labels.agg(F.avg(good.cast("int"))).first()[0]
        share = 1.0 if share is None else share
    ratio = fit_log_ratio(docs, labelled_sample(labels, good, most_labelled), buckets, doc_id, text)
    scored = docs.withColumn("__llm_weight", log_weight(ratio, text)).withColumn("__llm_key", gumbel_key(F.col("__llm_weight"), doc_id, text))
    keys = materialise(scored.select(F.col("__llm_key").alias("key")), "sample_keys")
    k = -(-keys.count() * share // 1)
    kept = scored.filter(F.col("__llm_key") >= kth_largest(keys, int(k))) if k else scored.limit(0)
    return kept.select(*carried(docs, ["log_weight", "sample_key"]), F.col("__llm_weight").alias("log_weight"), F.col("__llm_key").alias("sample_key"))

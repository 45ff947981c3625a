"""Toxicity scores by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on toxic
text, the latter on the words that carry n-grams over-represented among the
words of toxic documents, so that it holds what ordinary text lacks. Every window of a text is
compressed with the ordinary dictionary and with both; the bytes saved by the
toxic one are what the window says. A logistic model over statistics of all
windows of a document turns them into a probability; it is calibrated to the
label shares of the whole labelled table.

Where there are fewer than 200 samples, a dictionary is the samples themselves.

Labels are learned from a bounded sample: at most ``MOST_TOXIC`` toxic and
``MOST_ORDINARY`` ordinary documents, those with the smallest keyed hash of
their id. Everything that is collected comes from that sample. All windows of
all documents are scored.

Cases: a null or empty text is one empty window; null labels are no labels; if
either class has no labelled document, every score is the share of toxic
labels (0 without labels); an empty table gives an empty result; rows that
repeat a ``doc_id`` are scored each by its text. Other columns are carried
along; one named like an added column gives way to it.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomart.llm.common import carried, materialise
from geomart.llm.quality import labelled_sample

MOST_TOXIC = 4_000
MOST_ORDINARY = 8_000
MOST_WINDOWS = 40_000
MOST_WORDS = 20_000
WINDOW_BYTES = 24
ORDINARY_BYTES = 16_384
TOXIC_BYTES = 4_096
GRAM = 5
#: An n-gram marks toxic text if at least ``LEAST_WORDS`` of its words (and this
#: share of the number of its documents) have it, and its share of all words is
#: higher there by one of ``ODDS`` at least; it weighs by how many of these it
#: reaches, so no single bound decides. Words count once a document. By words,
#: because a long ordinary document has most n-grams of its language once.
#: Five-fold cross-validation over the learning rows of sf0.1 alone
#: (``tests/llm/choose_odds.py``): log loss 0.121, as for the best single bound (8).
LEAST_SHARE, LEAST_WORDS, ODDS = 0.01, 8, (5.0, 8.0, 12.0, 20.0)
#: Times that a word stands in the training text of the toxic dictionary at most:
#: the trainer weighs substrings by frequency, and one word must not fill it.
MOST_REPEATS = 500
LEVELS = (1, 2, 3, 4, 5, 6)

_BLANK = bytes(32 if chr(b) in string.punctuation or chr(b) in string.digits or b < 32 else b for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_BLANK).split() if isinstance(text, str) else []


def windows(text: str | None, size: int = WINDOW_BYTES) -> list[bytes]:
    """Runs of whole words of at least ``size`` bytes; the last may be shorter."""
    out: list[bytes] = []
    held: list[bytes] = []
    n = 0
    for word in plain_words(text):
        held.append(word)
        n += len(word) + 1
        if n >= size:
            out.append(b" " + b" ".join(held) + b" ")
            held, n = [], 0
    if held or not out:
        out.append(b" " + b" ".join(held) + b" ")
    return out


def train(samples: list[bytes], size: int, segment: int) -> bytes:
    """Dictionary content from samples; the samples themselves if they are few."""
    import zstandard

    if len(samples) < 200 or sum(map(len, samples)) < 4 * size:
        return b"".join(samples)[-size:]
    return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray | None = None
    prior: float = 0.0

    def statistics(self, texts: Iterator[str | None]) -> np.ndarray:
        """Per text: statistics of the bytes that the toxic dictionary saves."""
        import zstandard

        how = zstandard.ZstdCompressionParameters(
            window_log=17, chain_log=16, hash_log=16, search_log=8, min_match=5, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )

        def compressor(content: bytes):
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=how)
            return zstandard.ZstdCompressor(compression_params=how, dict_data=known).compress

        plain, both = compressor(self.ordinary), compressor(self.toxic + self.ordinary)
        rows = []
        for text in texts:
            saved = np.sort(np.array([len(plain(w)) - len(both(w)) for w in windows(text)], float))[::-1]
            over = [(saved >= level).sum() for level in LEVELS]
            rows.append([saved[0], saved[:3].mean(), saved[:8].mean(), saved.mean(), *np.log1p(over), *(np.array(over) / len(saved)), np.log(len(saved))])
        return np.array(rows).reshape(-1, 5 + 2 * len(LEVELS))

    def score(self, texts: Iterator[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(list(texts)), self.prior)
        x = self.statistics(texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights and intercept of a ridge logistic model, by Newton's method."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    a = np.hstack([(x - centre) / scale, np.ones((len(x), 1))])
    ridge = penalty * np.eye(a.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (p - y)) + ridge @ w)
        w -= step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    out = w[:-1] / scale
    return np.append(out, w[-1] - out @ centre)


def _document_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        n: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(frame["text"], frame["toxic"]):
            n[toxic].update(set(plain_words(text)))
        words = list(n[0] | n[1])
        yield pd.DataFrame({"word": words, "t": [n[1][w] for w in words], "o": [n[0][w] for w in words]})


def _word_grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(g, t, o) for w, t, o in zip(frame["word"], frame["t"], frame["o"]) for g in _grams(b" " + w + b" ")]
        yield pd.DataFrame(rows, columns=["gram", "t", "o"])


def word_weight(word: bytes, marks: dict[bytes, float]) -> float:
    """Weight of a word's strongest mark; all words count if there are no marks."""
    return max((marks.get(g, 0.0) for g in _grams(word)), default=0.0) if marks else 1.0


def repeats(n: int, weight: float) -> int:
    return max(1, round(min(n, MOST_REPEATS) * weight))


def _grams(word: bytes) -> set[bytes]:
    return {word[i : i + GRAM] for i in range(len(word) - GRAM + 1)}


def fit(docs: DataFrame, labels: DataFrame, toxic: Column, learn: Column, most_toxic: int = MOST_TOXIC, most_ordinary: int = MOST_ORDINARY, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learn from labelled rows for which ``learn`` (a condition over ``labels``)
    holds; ``toxic`` is true, false or null for a row of ``labels``."""
    usable = labels.filter(learn & toxic.isNotNull())
    of = {r["t"]: r["n"] for r in usable.groupBy(toxic.alias("t")).agg(F.count("*").alias("n")).collect()}
    chosen = [labelled_sample(usable, ~toxic, most_ordinary, doc_id), labelled_sample(usable, toxic, most_toxic, doc_id)]
    prior = of.get(True, 0) / max(1, sum(of.values()))
    if not len(chosen[0]) or not len(chosen[1]):
        return Model(b"", b"", None, prior)

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = frame["doc_id"].fillna(-1).to_numpy(np.int64)
            kind = np.where(np.isin(ids, chosen[1]), 1, np.where(np.isin(ids, chosen[0]), 0, -1))
            kind[frame["doc_id"].isna().to_numpy()] = -1
            yield pd.DataFrame({"text": frame["text"][kind >= 0], "toxic": kind[kind >= 0]})

    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sample = materialise(named.mapInPandas(pick, "text string, toxic int"), "labelled")
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model(b"", b"", None, prior)
    both = [F.sum("t").alias("t"), F.sum("o").alias("o")]
    by_word = materialise(sample.mapInPandas(_document_words, "word binary, t long, o long").groupBy("word").agg(*both), "words")
    of_words = by_word.agg(*both).first()
    grams = by_word.mapInPandas(_word_grams, "gram binary, t long, o long").groupBy("gram").agg(*both)
    odds = (F.col("t") / max(1, of_words["t"] or 0)) / ((F.col("o") + 1) / max(1, of_words["o"] or 0))
    reached = sum((odds >= bound).cast("int") for bound in ODDS)
    strong = grams.filter((F.col("t") >= max(LEAST_WORDS, LEAST_SHARE * n[1])) & (odds >= min(ODDS)))
    marks = {bytes(r["gram"]): r["reached"] / len(ODDS) for r in strong.select("gram", reached.alias("reached")).collect()}

    def marked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for t in frame["text"]:
                words = [b" " + w + b" " for w in plain_words(t)]
                weights = [word_weight(w, marks) for w in words]
                yield pd.DataFrame([(w, x) for w, x in zip(words, weights) if x], columns=["word", "weight"])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"window": [w for t in frame["text"] for w in windows(t)]})

    counted = sample.filter("toxic = 1").mapInPandas(marked, "word binary, weight double").groupBy("word").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))
    top = counted.orderBy(F.desc(F.col("n") * F.col("weight")), "word").limit(MOST_WORDS).collect()
    words = [bytes(r["word"]) for r in top for _ in range(repeats(r["n"], r["weight"]))]
    plain = sample.filter("toxic = 0").mapInPandas(cut, "window binary").distinct()
    ordinary = [bytes(r["window"]) for r in plain.orderBy(F.xxhash64("window"), "window").limit(MOST_WINDOWS).collect()]
    np.random.default_rng(7).shuffle(words)
    model = Model(train(ordinary, ORDINARY_BYTES, 32), train(words, TOXIC_BYTES, 16), None, prior)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"x": model.statistics(frame["text"].tolist()).tolist(), "toxic": frame["toxic"]})

    rows = sample.mapInPandas(measure, "x array<double>, toxic int").collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float)
    # The sample is balanced; the weights bring back the shares of all labels.
    weight = np.where(y == 1, of[True] / n[1], of[False] / n[0])
    model.weights = fit_logistic(x, y, weight * len(y) / weight.sum())
    return model


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability that a text is toxic."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()))

    return docs.select(*carried(docs, ["score"]), score(F.col(text)).alias("score"))

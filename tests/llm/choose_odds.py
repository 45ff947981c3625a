"""Cross-validates ``toxicity.ODDS`` against single bounds on the rows that op4 learns from (those
whose crc32(doc_id) % 4 is not 2); the held-out rows are not read.

usage: python tests/llm/choose_odds.py [folder of documents and labels]
"""

import os
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from geomart.llm import toxicity as X  # noqa: E402

FOLDS = 5


def learning_rows(folder):
    docs = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pandas()
    labels = pq.read_table(f"{folder}/labels.parquet", columns=["doc_id", "toxic"]).to_pandas().dropna()
    rows = docs.merge(labels, on="doc_id")
    crc = np.array([zlib.crc32(str(i).encode()) for i in rows.doc_id])
    learn = crc % 4 != 2
    return rows.text[learn].tolist(), rows.toxic[learn].to_numpy().astype(int), np.arange(learn.sum()) % FOLDS


def model(texts, toxic, odds):
    """The fit of ``toxicity.fit`` in plain Python."""
    counts, grams = (Counter(), Counter()), (Counter(), Counter())
    for t, y in zip(texts, toxic):
        counts[y].update(set(X.plain_words(t)))
    for c in (0, 1):
        for w, n in counts[c].items():
            for g in X._grams(b" " + w + b" "):
                grams[c][g] += n
    all_toxic, all_other = sum(counts[1].values()), sum(counts[0].values())
    least = max(X.LEAST_WORDS, X.LEAST_SHARE * sum(toxic))
    odds_of = {g: (n / all_toxic) / ((grams[0][g] + 1) / all_other) for g, n in grams[1].items() if n >= least}
    marks = {g: sum(o >= b for b in odds) / len(odds) for g, o in odds_of.items() if o >= min(odds)}
    marked, weight = Counter(), {}
    for t, y in zip(texts, toxic):
        for w in X.plain_words(t) if y else []:
            w = b" " + w + b" "
            if w not in weight:
                weight[w] = X.word_weight(w, marks)
            marked[w] += weight[w] > 0
    top = sorted((w for w in marked if weight[w]), key=lambda w: (-marked[w] * weight[w], w))[: X.MOST_WORDS]
    words = [w for w in top for _ in range(X.repeats(marked[w], weight[w]))]
    plain = sorted({w for t, y in zip(texts, toxic) if not y for w in X.windows(t)}, key=zlib.crc32)[: X.MOST_WINDOWS]
    np.random.default_rng(7).shuffle(words)
    out = X.Model(X.train(plain, X.ORDINARY_BYTES, 32), X.train(words, X.TOXIC_BYTES, 16))
    out.weights = X.fit_logistic(out.statistics(texts), np.array(toxic, float), np.ones(len(texts)))
    return out


def main(folder):
    texts, toxic, fold = learning_rows(folder)
    for odds in (X.ODDS, *[(x,) for x in X.ODDS]):
        p = np.zeros(len(texts))
        for f in range(FOLDS):
            inside, out = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            p[out] = model([texts[i] for i in inside], toxic[inside], odds).score([texts[i] for i in out])
        loss = -np.mean(np.log(np.clip(np.where(toxic == 1, p, 1 - p), 1e-6, 1)))
        print(f"odds {odds}: log loss {loss:.4f}, recall {(p >= 0.3)[toxic == 1].mean():.3f}, precision {toxic[p >= 0.3].mean():.3f}")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")

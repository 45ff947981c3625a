"""Substring removal: words covered by a window of ``width`` words that also
starts in an earlier document.

Every window gets a Rabin-Karp hash (64 bits; two different windows among n
share one with probability n**2 / 2**65). A task sends each distinct hash once
per run of documents it reads, with the smallest ``doc_id`` that has it, as
sorted blobs dealt by hash range; so a passage in a third of all documents
sends a few entries per task. Reducers find the smallest document per hash and
answer each document with the hashes to remove (in blobs for groups of
documents, regrouped to one row per document), and its repeated windows merge
into maximal removal intervals.

Cases: a null or empty text has no words; a document shorter than the window
keeps all its words; rows that share a ``doc_id`` do not remove each other's
words; a row with a null ``doc_id`` neither removes nor loses words; an empty
table gives an empty result. Other columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomart.llm.common import carried, partitions_for, passes, text_key, total_text_bytes
from geomart.llm.words import SLICE, mix, token_hashes, window_hashes

#: Bytes of text whose windows one reducer compares, and that one run covers.
REDUCER_BYTES = 24 << 20
RUN_BYTES = 16 << 20


def _squeeze(a: np.ndarray) -> bytes:
    """Sorted or short integers as zstandard-compressed byte planes."""
    import zstandard

    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unsqueeze(blob: bytes, dtype: type) -> np.ndarray:
    import zstandard

    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1) if blob else np.zeros((size, 0), np.uint8)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The arrays in one; the list is emptied."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def _window_blobs(width: int, buckets: int):
    """Sends the windows of a run of documents: per bucket of hashes the sorted
    distinct hashes and, for each, the place in ``docs``/``keys`` of the first
    document; and (``later``) the other documents of the run that have them."""

    def run(frame: pd.DataFrame) -> Iterator[dict]:
        frame = frame.sort_values("doc_id", kind="stable")
        hashes, owners = [], []
        names = frame["doc_id"].to_numpy(np.int64)
        keys = frame["_k"].to_numpy(np.int64)
        done = 0
        for part in passes(iter([frame])):
            h, offsets = window_hashes(*token_hashes(part["text"].tolist()), width)
            hashes.append(h)
            owners.append(np.repeat(np.arange(done, done + len(part), dtype=np.uint32), np.diff(offsets)))
            done += len(part)
        # An array goes as soon as the next is made of it: all of them at once
        # are many times the text, and more the shorter its words are.
        h = _joined(hashes)
        owner = _joined(owners)
        order = np.argsort(h, kind="stable")  # within a hash by document
        h = h[order]
        owner = owner[order]
        del order
        if not len(h):
            return
        new_hash = np.concatenate([[True], h[1:] != h[:-1]])
        group = np.cumsum(new_hash, dtype=np.uint32) - np.uint32(1)
        first_name = names[owner[new_hash]]
        later = np.empty(len(h), bool)  # known to be repeated
        for a in range(0, len(h), SLICE):
            later[a : a + SLICE] = names[owner[a : a + SLICE]] > first_name[group[a : a + SLICE]]
        del group, first_name
        twice = np.concatenate([[False], (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])])
        same = ~new_hash & ~later & ~twice  # other rows of the first doc_id
        sent, late = new_hash | same, later & ~twice
        edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
        cut = np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])
        for b, (x, y) in enumerate(zip(cut, cut[1:])):
            if x == y:
                continue
            s, l = np.flatnonzero(sent[x:y]) + x, np.flatnonzero(late[x:y]) + x
            used, place = np.unique(owner[np.concatenate([s, l])], return_inverse=True)
            place = place.astype(np.uint16 if len(used) < 65536 else np.uint32)
            yield {
                "bucket": b, "wide": place.dtype.itemsize, "docs": _squeeze(names[used]), "keys": keys[used].tobytes(),
                "hashes": _squeeze(h[s]), "owners": _squeeze(place[: len(s)]), "late_hashes": _squeeze(h[l]), "late_owners": _squeeze(place[len(s) :]),
            }

    def blobs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for part in passes(frames):
            held.append(part)
            size += int(part["text"].str.len().sum())
            if size >= RUN_BYTES:
                yield from (pd.DataFrame([r]) for r in run(pd.concat(held)))
                held, size = [], 0
        if held:
            yield from (pd.DataFrame([r]) for r in run(pd.concat(held)))

    return blobs


_BLOBS = "bucket int, wide int, docs binary, keys binary, hashes binary, owners binary, late_hashes binary, late_owners binary"


def _answers(frame: pd.DataFrame, groups: int) -> pd.DataFrame:
    """For one bucket: the windows that also start in a document with a smaller
    id, in one blob for each group of documents to answer."""
    hashes, places, told, names, keys = [], [], [], [], []
    base = 0
    for r in frame.itertuples(index=False):
        kind = np.uint16 if r.wide == 2 else np.uint32
        docs, key = _unsqueeze(r.docs, np.int64), np.frombuffer(r.keys, np.int64)
        for h, o, late in ((r.hashes, r.owners, False), (r.late_hashes, r.late_owners, True)):
            h, o = _unsqueeze(h, np.uint64), _unsqueeze(o, kind)
            hashes.append(h)
            places.append(o.astype(np.uint32) + np.uint32(base))
            told.append(np.full(len(h), late))
        names.append(docs)
        keys.append(key)
        base += len(docs)
    # A window has the place of its document; ids and keys follow for those that go.
    h, place, gone, name_at, key_at = _joined(hashes), _joined(places), _joined(told), _joined(names), _joined(keys)
    order = np.argsort(h, kind="stable")
    h = h[order]
    place = place[order]
    gone = gone[order]
    del order
    if len(h):
        name = name_at[place]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        gone |= name > np.repeat(np.minimum.reduceat(name, starts), np.diff(np.append(starts, len(h))))
        del name, starts
    h, place = h[gone], place[gone]
    name, key = name_at[place], key_at[place]
    group = (mix(name.view(np.uint64) ^ key.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((h, key, name, group))
    h, name, key, group = h[order], name[order], key[order], group[order]
    if not len(h):
        return pd.DataFrame({"to": [], "ids": [], "keys": [], "counts": [], "hashes": []})
    docs = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (key[1:] != key[:-1])]))
    counts = np.diff(np.append(docs, len(h)))
    some, cut = np.unique(group[docs], return_index=True)
    rows = []
    for g, x, y in zip(some.tolist(), cut.tolist(), [*cut[1:].tolist(), len(docs)]):
        d, last = docs[x:y], docs[y - 1] + counts[y - 1]
        rows.append((g, _squeeze(name[d]), _squeeze(key[d]), _squeeze(counts[x:y]), _squeeze(h[d[0] : last])))
    return pd.DataFrame(rows, columns=["to", "ids", "keys", "counts", "hashes"])


def _per_document(frame: pd.DataFrame) -> pd.DataFrame:
    """The answers to a group of documents, one row per document."""
    name, key, count = (np.concatenate([_unsqueeze(x, np.int64) for x in frame[c]]) for c in ("ids", "keys", "counts"))
    name, key = np.repeat(name, count), np.repeat(key, count)
    h = np.concatenate([_unsqueeze(x, np.uint64) for x in frame["hashes"]])
    order = np.lexsort((key, name))
    h, name, key = h[order], name[order], key[order]
    cut = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (key[1:] != key[:-1])]))
    return pd.DataFrame({"__llm_id": name[cut], "__llm_key": key[cut], "__llm_gone": [x.tobytes() for x in np.split(h, cut[1:])]})


def remove_repeated_windows(docs: DataFrame, width: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``removed`` (maximal intervals
    of removed words, ends exclusive) and ``kept_text`` (kept words joined by one
    space). Words are runs of bytes other than ASCII white space."""
    spark = docs.sparkSession
    buckets = partitions_for(spark, total_text_bytes(docs, text), REDUCER_BYTES)
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), text_key(text).alias("_k"))
    sent = keyed.filter(F.col("doc_id").isNotNull() & (F.length("text") > 0)).mapInPandas(_window_blobs(width, buckets), _BLOBS)
    answers = sent.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(lambda f: _answers(f, buckets), "to long, ids binary, keys binary, counts binary, hashes binary")
    per_doc = answers.groupBy("to").applyInPandas(_per_document, "__llm_id long, __llm_key long, __llm_gone binary")
    joined = docs.withColumns({"__llm_id": F.col(doc_id).cast("long"), "__llm_key": text_key(text)}).join(per_doc, ["__llm_id", "__llm_key"], "left")

    @F.pandas_udf("n_words long, n_removed long, removed array<struct<first:long,last:long>>, kept_text string")
    def remove(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        frame = pd.DataFrame({"text": texts, "gone": gone})
        for part in passes(iter([frame])):
            words, offsets = token_hashes(part["text"].tolist())
            windows, at = window_hashes(words, offsets, width)
            for i, (t, lists) in enumerate(zip(part["text"], part["gone"])):
                n = int(offsets[i + 1] - offsets[i])
                covered = np.zeros(n + 1, np.int64)
                if lists is not None:
                    hit = np.flatnonzero(np.isin(windows[at[i] : at[i + 1]], np.frombuffer(lists, np.uint64)))
                    np.add.at(covered, hit, 1)
                    np.add.at(covered, hit + width, -1)
                mask = np.cumsum(covered[:n]) > 0
                kept = t.encode("utf-8", "surrogatepass").split() if isinstance(t, str) else []
                if mask.any():
                    kept = [w for w, m in zip(kept, mask.tolist()) if not m]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                spans = [{"first": int(a), "last": int(b)} for a, b in zip(edge[::2], edge[1::2])]
                out.append((n, int(mask.sum()), spans, b" ".join(kept).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "removed", "kept_text"])

    done = joined.withColumn("__llm_kept", remove(F.col(text), "__llm_gone"))
    added = ["n_words", "n_removed", "removed", "kept_text"]
    return done.select(*carried(docs, added), *[F.col(f"__llm_kept.{c}") for c in added])

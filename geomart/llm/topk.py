"""Exact top-k inner products by a dual-tree search of cover trees.

Vectors are dealt into blocks; each block becomes a cover tree: a node has one
of its points as centre, a covering radius, and children around a net of its
points, taken farthest first until their radii are smaller by ``BASE`` or there
are ``FANOUT`` of them (in many dimensions a finer net is nearly all points).
Queries are taken a block at a time, form a tree
of their own and meet every block of the index: a pair of nodes is skipped if
no inner product of a query below the one and a vector below the other can
reach the worst kth score found so far for the queries below the first,

    <q, r> <= <c_q, c_r> + rho_q |c_r| + rho_r |c_q| + rho_q rho_r.

Scores are exact: components are integers, kept in doubles as long as sums
stay under 2**53 and as Python integers beyond.

Cases: a vector that is null or holds a null or non-finite component takes no
part; a shorter vector counts as padded with zeros; equal scores rank by
smaller id; a row's own id is never its candidate; repeated rows are candidates
of their own but one query; a null id takes no part; fewer candidates than k
give all of them; a score must fit a long; an empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geomart.llm.common import materialise
from geomart.session import scratch_path

BLOCK = 4096
QUERY_BLOCK = 1024
LEAF = 128
FANOUT = 16
BASE = 1.3
_EXACT = float(1 << 53)


class CoverTree:
    """Nodes in preorder; the points below a node are a slice of ``order``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.order = points, np.arange(len(points))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self.squares = np.einsum("ij,ij->i", points, points)
        if len(points):
            self._grow(leaf)

    def _distances(self, members: np.ndarray, centre: int) -> np.ndarray:
        gap = self.points[members] - self.points[centre]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def _add(self, a: int, b: int, centre: int, radius: float) -> int:
        self.centre.append(centre)
        self.radius.append(radius)
        self.span.append((a, b))
        self.children.append([])
        return len(self.centre) - 1

    def _grow(self, leaf: int) -> None:
        first = int(self.order[0])
        todo = [(self._add(0, len(self.order), first, float(self._distances(self.order, first).max())))]
        while todo:
            node = todo.pop()
            (a, b), radius = self.span[node], self.radius[node]
            if b - a <= leaf or radius == 0:
                continue
            members = self.order[a:b].copy()
            # A net of the node: points farther than radius / BASE from every
            # centre before become centres; every point joins its nearest one.
            near = self._distances(members, self.centre[node])
            centres, owner = [self.centre[node]], np.zeros(len(members), np.int64)
            while near.max() > radius / BASE and len(centres) < FANOUT:
                centres.append(int(members[near.argmax()]))
                d = self._distances(members, centres[-1])
                closer = d < near
                owner[closer], near[closer] = len(centres) - 1, d[closer]
            sort = np.argsort(owner, kind="stable")
            self.order[a:b] = members[sort]
            cut = a + np.searchsorted(owner[sort], np.arange(len(centres) + 1))
            for i, centre in enumerate(centres):
                below = near[sort][cut[i] - a : cut[i + 1] - a]
                child = self._add(int(cut[i]), int(cut[i + 1]), centre, float(below.max()))
                self.children[node].append(child)
                todo.append(child)


def dual_search(queries: CoverTree, query_ids: np.ndarray, tree: CoverTree, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best ``(scores, ids)`` in ``tree`` for each query, best first;
    unused places have the score -inf."""
    n = len(query_ids)
    best = np.full((n, k), -np.inf)
    names = np.full((n, k), np.iinfo(np.int64).max)
    if not n or not len(ids):
        return best, names
    cq, cr = queries.points[queries.centre], tree.points[tree.centre]
    nq, nr = np.sqrt(queries.squares[queries.centre]), np.sqrt(tree.squares[tree.centre])
    rq, rr = np.array(queries.radius), np.array(tree.radius)
    bound = cq @ cr.T + rq[:, None] * nr[None, :] + nq[:, None] * rr[None, :] + rq[:, None] * rr[None, :]
    bound += 1e-9 * np.abs(bound) + 1e-6  # rounding must not prune
    heap = [(-bound[0, 0], 0, 0)]
    while heap:
        at, i, j = heapq.heappop(heap)
        a, b = queries.span[i]
        mine = queries.order[a:b]
        if -at < best[mine, k - 1].min():
            continue
        down_q, down_r = queries.children[i], tree.children[j]
        if not down_q and not down_r:
            _meet(queries, mine, query_ids, tree, tree.order[slice(*tree.span[j])], ids, best, names, k)
        elif down_r and (not down_q or rr[j] >= rq[i]):
            for c in down_r:
                heapq.heappush(heap, (-bound[i, c], i, c))
        else:
            for c in down_q:
                heapq.heappush(heap, (-bound[c, j], c, j))
    return best, names


def _meet(queries: CoverTree, mine: np.ndarray, query_ids: np.ndarray, tree: CoverTree, theirs: np.ndarray, ids: np.ndarray, best: np.ndarray, names: np.ndarray, k: int) -> None:
    score = queries.points[mine] @ tree.points[theirs].T
    score[ids[theirs][None, :] == query_ids[mine][:, None]] = -np.inf
    least = best[mine, k - 1]
    if score.shape[1] > k:  # what is under the k-th best here is not among the k best
        least = np.maximum(least, np.partition(score, score.shape[1] - k, axis=1)[:, -k])
    row, col = np.nonzero((score >= least[:, None]) & np.isfinite(score))
    if not len(row):
        return
    changed = np.unique(row)
    row = np.concatenate([np.repeat(changed, k), row])
    name = np.concatenate([names[mine[changed]].ravel(), ids[theirs[col]]])
    value = np.concatenate([best[mine[changed]].ravel(), score[row[len(changed) * k :], col]])
    order = np.lexsort((name, -value, row))
    row, name, value = row[order], name[order], value[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = place < k
    best[mine[row[kept]], place[kept]] = value[kept]
    names[mine[row[kept]], place[kept]] = name[kept]


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _search_block(queries: list[tuple[int, list[float]]], k: int):
    ids = np.array([q for q, _ in queries], np.int64)
    vectors = [np.array(v) for _, v in queries]

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for names, values, lengths in zip(frame["ids"], frame["points"], frame["lengths"]):
                theirs = np.frombuffer(names, np.int64)
                lengths = np.frombuffer(lengths, np.int64)
                rows = np.split(np.frombuffer(values, np.float64), np.cumsum(lengths)[:-1])
                width = max(max(map(len, vectors)), int(lengths.max()))
                q, r = _matrix(vectors, width), _matrix(rows, width)
                if width * np.abs(q).max(initial=0) * np.abs(r).max(initial=0) >= _EXACT:
                    yield _plain(ids, q, theirs, r, k)
                    continue
                best, found = dual_search(CoverTree(q), ids, CoverTree(r), theirs, k)
                some = np.isfinite(best)
                yield pd.DataFrame({"query_id": np.repeat(ids, some.sum(1)), "key": np.repeat(np.arange(len(ids)), some.sum(1)), "vec_id": found[some], "score": best[some].astype(np.int64)})

    return search


def _plain(ids: np.ndarray, q: np.ndarray, theirs: np.ndarray, r: np.ndarray, k: int) -> pd.DataFrame:
    """Scores too large for doubles, with Python integers."""
    wide = [[int(x) for x in row] for row in r]
    rows = []
    for at, (name, query) in enumerate(zip(ids.tolist(), q)):
        query = [int(x) for x in query]
        scores = sorted((-sum(x * y for x, y in zip(query, v)), t) for v, t in zip(wide, theirs.tolist()) if t != name)
        rows += [(name, at, t, -s) for s, t in scores[:k]]
    return pd.DataFrame(rows, columns=["query_id", "key", "vec_id", "score"])


def _block_rows(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("vec_id")
    vectors = [np.asarray(v, np.float64) for v in frame["v"]]
    return pd.DataFrame([{"ids": frame["vec_id"].to_numpy(np.int64).tobytes(), "points": np.concatenate(vectors).tobytes(), "lengths": np.array([len(v) for v in vectors], np.int64).tobytes()}])


def quantised(vectors: DataFrame, scale: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, v``: floor(scale * x) of each component; vectors that are null
    or hold a null or non-finite component are left out."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).filter(finite)
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: F.rint(x * scale) - F.when(F.rint(x * scale) > x * scale, 1.0).otherwise(0.0)).alias("v"))


def top_k(candidates: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k highest inner products of each
    query; both tables have ``vec_id`` and ``v`` (array of whole doubles).

    Query blocks are bounded and go to the tasks one after the other; results
    of a block are k rows per query and index block.
    """
    spark = candidates.sparkSession
    blocks = max(1, -(-candidates.count() // block))
    dealt = candidates.withColumn("_b", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)))
    index = materialise(dealt.repartition(blocks, "_b").groupBy("_b").applyInPandas(_block_rows, "ids binary, points binary, lengths binary"), "blocks")
    asked = queries.distinct()
    query_blocks = max(1, -(-asked.count() // query_block))
    asked = materialise(asked.withColumn("_b", F.pmod(F.xxhash64("vec_id", "v"), F.lit(query_blocks))).repartition("_b"), "queries")
    path = scratch_path(spark, "llm", "found")
    schema = "query_id long, key int, vec_id long, score long"
    for b in range(query_blocks):
        mine = [(r["vec_id"], r["v"]) for r in asked.filter(F.col("_b") == b).orderBy("vec_id", "v").collect()]
        found = index.mapInPandas(_search_block(mine, k), schema) if mine else spark.createDataFrame([], schema)
        found.withColumn("_b", F.lit(b)).write.mode("append").parquet(path)
    found = spark.read.schema(f"{schema}, _b int").parquet(path)
    rank = F.row_number().over(Window.partitionBy("_b", "key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

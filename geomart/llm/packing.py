"""Best-fit packing of token pieces into sequences of bounded length, after
Martello-Toth dominance reduction.

Packing needs only how many pieces of each length there are. That histogram
has at most ``capacity`` rows whatever the size of the corpus, so the plan is
made on the driver from it; the pieces themselves stay in Spark, where each
one finds its place from its length and its rank among the pieces of that
length.

Cases: a null text counts as empty, an empty document is its end id alone;
every row is packed, also rows that repeat a ``doc_id``; a null ``doc_id``
stays null; an empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geomart.llm.common import materialise, passes
from geomart.llm.tokens import encoder

#: Pieces of one length are ranked in slices, of this many rows on average at
#: most, so that a length that very many pieces share is ranked by many tasks.
SLICE_ROWS = 100_000
LEAST_SLICES = 128


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids`` of every document: its ids and
    ``end_id``. Only a document over ``capacity`` ids is cut, into pieces of
    ``capacity`` ids of which the first may be shorter."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in passes(frames):
            names, pieces, starts, lengths, ids = [], [], [], [], []
            for name, x in zip(frame["doc_id"].astype("Int64"), encoder(tokenizer_path).encode(frame["text"].tolist())):
                x += end
                n = len(x) // 4
                at = [0, *range(n % capacity or capacity, n, capacity), n]
                names += [name] * (len(at) - 1)
                pieces += range(len(at) - 1)
                starts += at[:-1]
                lengths += [b - a for a, b in zip(at, at[1:])]
                ids += [x[4 * a : 4 * b] for a, b in zip(at, at[1:])]
            yield pd.DataFrame({"doc_id": pd.array(names, "Int64"), "piece": pieces, "start": starts, "length": lengths, "ids": ids})

    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return named.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids binary")


@dataclass
class Plan:
    """Places of the pieces of each length by rank. Row i says: pieces of
    ``length[i]`` with a rank from ``rank[i]`` on go ``per[i]`` to a sequence,
    to sequences from ``sequence[i]`` on, at offsets from ``offset[i]`` on."""

    capacity: int
    sequences: int = 0
    fixed: int = 0
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    used: dict[int, int] = field(default_factory=dict)

    def place(self, length: int, pieces: int, per: int, sequence: int, offset: int) -> None:
        at = self.used.get(length, 0)
        self.rows.append((length, at, per, sequence, offset))
        self.used[length] = at + pieces

    def open(self, items: list[int], sequences: int) -> None:
        """New sequences that each hold ``items`` and nothing else."""
        offset = 0
        for length in dict.fromkeys(items):
            per = items.count(length)
            self.place(length, per * sequences, per, self.sequences, offset)
            offset += per * length
        self.sequences += sequences


def _smallest(count: np.ndarray, k: int) -> list[int]:
    out: list[int] = []
    for length in np.flatnonzero(count)[:k]:
        out += [int(length)] * min(int(count[length]), k - len(out))
        if len(out) == k:
            break
    return out


def _dominating(j: int, count: np.ndarray, capacity: int) -> list[int] | None:
    """Items that, beside one of length ``j``, dominate every other way to fill
    its sequence; None if that is not proven. ``count`` is without that item.

    A set dominates another if the items of the other can be dealt into groups,
    each no longer than an item of its own. Four cases are proven:
    nothing fits beside j; the longest fitting item k fills the sequence, so it
    is as long as any other filling together; no two items fit beside j, or any
    two that do are together no longer than k; no three items fit and {k, b}
    covers each fitting pair item by item or by k alone.
    """
    room = capacity - j
    least = _smallest(count, 3)
    if not least or least[0] > room:
        return []
    k = int(np.flatnonzero(count[: room + 1])[-1])
    if k == room or len(least) < 2 or least[0] + least[1] > room:
        return [k]
    if len(least) == 3 and sum(least) <= room:
        return None
    lengths = np.flatnonzero(count[: room + 1])
    # For each length r, the longest s <= r that fits beside it.
    limit = np.minimum(lengths, room - lengths)
    at = np.searchsorted(lengths, limit, side="right") - 1
    s = np.where(at >= 0, lengths[np.maximum(at, 0)], 0)
    alone = (s == lengths) & (count[lengths] < 2)  # one item cannot be both
    s[alone] = np.where(at[alone] > 0, lengths[np.maximum(at[alone] - 1, 0)], 0)
    pair = s > 0
    if not pair.any() or int((lengths + s)[pair].max()) <= k:
        return [k]
    beside = count.copy()
    beside[k] -= 1
    fits = np.flatnonzero(beside[: room - k + 1])
    if not len(fits):
        return None
    b = int(fits[-1])
    return [k, b] if bool(np.all((s[pair] <= b) | ((lengths + s)[pair] <= k))) else None


def reduce_by_dominance(count: np.ndarray, plan: Plan) -> None:
    """Fix dominating sets for good, as often as that frees another."""
    changed = True
    while changed:
        changed = False
        for j in np.flatnonzero(count)[::-1].tolist():
            while count[j]:
                count[j] -= 1
                others = _dominating(j, count, plan.capacity)
                count[j] += 1
                if others is None:
                    break
                items = [j, *others]
                # Fewer items left fit no better, so the proof holds until one of these lengths is used up.
                sequences = min(int(count[x]) // items.count(x) for x in set(items))
                for x in items:
                    count[x] -= sequences
                plan.open(items, sequences)
                plan.fixed += sequences
                changed = True


def best_fit(count: np.ndarray, plan: Plan) -> None:
    """Best-fit decreasing of what is left, all pieces of a length at a time:
    sequences with the same free room stay together as ranges of their ids."""
    room: dict[int, list[tuple[int, int]]] = {}
    mask = 0

    def put(free: int, first: int, sequences: int) -> None:
        nonlocal mask
        if sequences and free:
            room.setdefault(free, []).append((first, sequences))
            mask |= 1 << free

    for a in np.flatnonzero(count)[::-1].tolist():
        n = int(count[a])
        while n:
            fitting = mask >> a
            if fitting:
                free = a + (fitting & -fitting).bit_length() - 1
                first, have = room[free].pop()
                if not room[free]:
                    mask &= ~(1 << free)
            else:
                free, first = plan.capacity, plan.sequences
                have = -(-n // (free // a))
                plan.sequences += have
            per = free // a
            full = min(have, n // per)
            if full:
                plan.place(a, full * per, per, first, plan.capacity - free)
                put(free - per * a, first, full)
                n -= full * per
            if full < have and 0 < n < per:
                plan.place(a, n, n, first + full, plan.capacity - free)
                put(free - n * a, first + full, 1)
                n, full = 0, full + 1
            put(free, first + full, have - full)
        count[a] = 0


def plan_packing(histogram: dict[int, int], capacity: int) -> Plan:
    """Plan for ``{length: pieces}`` with lengths from 1 to ``capacity``."""
    count = np.zeros(capacity + 1, np.int64)
    for length, pieces in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not between 1 and {capacity}")
        count[length] = pieces
    plan = Plan(capacity)
    reduce_by_dominance(count, plan)
    best_fit(count, plan)
    return plan


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces with a ``length``
    from 1 to ``capacity``; the pieces of a sequence follow each other from 0."""
    kept = materialise(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_packing(histogram, capacity)
    slices = max(LEAST_SLICES, sum(histogram.values()) // SLICE_ROWS)
    sliced = kept.withColumn("_slice", F.pmod(F.xxhash64("_row"), F.lit(slices)))
    sizes = sliced.groupBy("length", "_slice").agg(F.count("*").alias("_n"))
    before = sizes.select("length", "_slice", (F.sum("_n").over(Window.partitionBy("length").orderBy("_slice")) - F.col("_n")).alias("_before"))
    ranked = sliced.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_slice").orderBy("_row")))
    ranked = ranked.join(before, ["length", "_slice"]).withColumn("_rank", F.col("_before") + F.col("_in") - 1)

    # The plan has some rows per length, bounded by the capacity alone.
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 5)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        # Rows of the plan are sorted by length, then rank: the last one that starts at or before (length, rank).
        span = int(rows[:, 1].max(initial=0)) + 1 + int(r.max(initial=0))
        at = np.searchsorted(rows[:, 0] * span + rows[:, 1], n * span + r, side="right") - 1
        k = r - rows[at, 1]
        return pd.DataFrame({"sequence_id": rows[at, 3] + k // rows[at, 2], "offset": rows[at, 4] + k % rows[at, 2] * n})

    placed = ranked.withColumn("_place", place("length", "_rank"))
    return placed.select(*pieces.columns, "_place.sequence_id", "_place.offset")

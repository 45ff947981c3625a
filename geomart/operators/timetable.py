"""Travel-time matrix over timetables and walking, one graph per feed.

Places are hex cells. From a cell one can walk to the cells next to it and
board any trip that calls there; the earliest arrival from every cell at every
other is found by searches by time, in numpy, from many origins at once. Times are
whole minutes since midnight.

Boarding means the first departure at or after an arrival. Per (feed, from, to)
edge the runs that no other run beats, leaving later and arriving no later, are
one array of at most ``cap + 1`` entries, mostly one or two; a walk has its
minutes instead. So trips that overtake each other are no special case.

A search has all places and edges of its feed at hand, some ten bytes a place and
thirty a run or walk, so a feed must fit in the memory of a task; its origins are
dealt over all tasks. The labels, by far the most, are kept for some origins at a time
(``LABELS``) and go out as two arrays per origin.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geomart.functions import cells
from geomart.session import ensure_checkpoint_dir

#: Copies of a feed's edges at least, one for each share of its origins, so that
#: a large feed is no single task.
SALTS = 8
#: Labels and origins of a task at a time, at most; a task holds one byte per label,
#: two if the cap is 255 or more, even where nobody arrives.
LABELS, ORIGINS = 1 << 25, 512
#: Columns of a folded matrix that are arrays, and of packed places and edges.
FOLDED = ("destination", "travel_minutes")
_BODIES = ("src", "dst", "leave", "arrive")


def active_trips(trips: DataFrame, service_days: DataFrame, on: Column) -> DataFrame:
    """``feed, trip_id`` of the ``trips`` (with ``service_id``) that run on the
    date ``on``, by ``service_days`` (``feed, service_id, service_date``)."""
    running = service_days.filter(F.col("service_date") == on).select("feed", "service_id")
    return trips.join(running, ["feed", "service_id"], "left_semi").select("feed", "trip_id")


def hops(stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """``feed, src, departure, dst, arrival`` of each leg between two calls of a
    trip. ``stop_times`` is ``(feed, trip_id, seq, stop_id, arrival, departure)``,
    ``stops`` is ``(feed, stop_id, cell)``; a stop id means another stop in
    another feed. Legs within a cell, and legs that arrive before they leave,
    are left out."""
    trip = Window.partitionBy("feed", "trip_id").orderBy("seq")
    calls = stop_times.join(stops.select("feed", "stop_id", "cell"), ["feed", "stop_id"])
    legs = calls.select(
        "feed", F.col("cell").alias("src"), "departure",
        F.lead("cell").over(trip).alias("dst"), F.lead("arrival").over(trip).alias("arrival"),
    )
    return legs.filter((F.col("src") != F.col("dst")) & (F.col("arrival") >= F.col("departure")))


def ride_edges(legs: DataFrame, depart: int, cap: int) -> DataFrame:
    """``feed, src, dst, runs, walk``: ``runs`` has the departure and arrival, in
    minutes after ``depart``, of every ride from ``src`` to ``dst`` that none
    beats; ``walk`` is null."""
    window = legs.select(
        "feed", "src", "dst", (F.col("departure") - depart).cast("int").alias("leave"), (F.col("arrival") - depart).cast("int").alias("reach")
    ).filter((F.col("leave") >= 0) & (F.col("reach") <= cap))
    # One entry per minute of departure at most.
    best = window.groupBy("feed", "src", "dst", "leave").agg(F.min("reach").alias("reach"))
    board = best.groupBy("feed", "src", "dst").agg(F.collect_list(F.struct("leave", "reach")).alias("runs"))
    kept = F.filter("runs", lambda r: ~F.exists("runs", lambda o: (o.leave > r.leave) & (o.reach <= r.reach)))
    return board.select("feed", "src", "dst", kept.alias("runs"), F.lit(None).cast("int").alias("walk"))


def walk_edges(places: DataFrame, minutes: int) -> DataFrame:
    """Walks of ``minutes`` between neighbouring cells of ``places`` (``feed,
    cell``), as rows like those of ``ride_edges``."""
    steps = places.select("feed", F.col("cell").alias("src"), F.explode(cells.kring("cell", 1)).alias("dst")).filter("src != dst")
    steps = steps.join(places.select("feed", F.col("cell").alias("dst")), ["feed", "dst"])
    runs = F.lit(None).cast("array<struct<leave:int,reach:int>>")
    return steps.select("feed", "src", "dst", runs.alias("runs"), F.lit(minutes).cast("int").alias("walk"))


def earliest(at: str, cap: int) -> Column:
    """Arrival over an edge of who is at its start ``at`` minutes after the
    departure; null after ``cap``, or where no run leaves then or later."""
    ride = F.array_min(F.transform(F.filter("runs", lambda r: r.leave >= F.col(at)), lambda r: r.reach))
    walk = F.col(at) + F.col("walk")
    return F.when(F.col("walk").isNull(), ride).when(walk <= cap, walk)


def stop_cells(stops: DataFrame, ring: int = 1) -> DataFrame:
    """``feed, cell`` of all cells within ``ring`` steps of a stop's cell."""
    return stops.select("feed", F.explode(cells.kring("cell", ring)).alias("cell")).distinct()


def _packed(*names: str) -> Callable:
    """Rows sorted by feed and ``src`` as a few rows of packed numbers: ``src`` by
    its steps, ``dst`` by what it is beyond ``src``. They are sent many times."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = np.flatnonzero(np.diff(batch.column("feed").dictionary_encode().indices.to_numpy())) + 1
            for a, b in itertools.pairwise([0, *turns.tolist(), batch.num_rows] if batch.num_rows else []):
                mine = {name: batch.column(name).slice(a, b - a).to_numpy() for name in names}
                bodies = {"src": np.diff(mine["src"], prepend=0)}
                if "dst" in mine:
                    bodies |= {"dst": mine["dst"] - mine["src"], "leave": mine["leave"], "arrive": mine["arrive"]}
                columns = [pa.array([zlib.compress(bodies[name].tobytes(), 1) if name in bodies else None], pa.binary()) for name in _BODIES]
                yield pa.RecordBatch.from_arrays([batch.column("feed").slice(a, 1), *columns], ["feed", *_BODIES])

    return pack


def _numbers(body: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(body), kind)


def _csr(edges: list[tuple[np.ndarray, ...]], n: int) -> tuple[np.ndarray, ...]:
    """Edges in the order of their starts, and where those of each start begin."""
    src, *rest = map(np.concatenate, zip(*edges, strict=True)) if edges else [np.zeros(0, "i4")] * 4
    order = np.argsort(src, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]), *(x[order] for x in rest)


class _Feed:
    """Places and edges of a feed, and searches from some of its places at once."""

    def __init__(self, cap: int):
        self.cap, self.cells, self.rides, self.walks = cap, np.zeros(0, "i8"), [], []

    def add(self, src: bytes, dst: bytes | None, leave: bytes | None, arrive: bytes | None) -> None:
        """All places come before the first edges."""
        src = np.cumsum(_numbers(src, "i8"))
        if dst is None:
            self.cells = np.concatenate([self.cells, src])
            return
        if not self.rides:
            self.cells.sort()
        dst, leave, arrive = src + _numbers(dst, "i8"), _numbers(leave, "i4"), _numbers(arrive, "i4")
        ends = [np.searchsorted(self.cells, x).astype("i4") for x in (src, dst)]
        for kept, mine in ((self.rides, leave >= 0), (self.walks, (leave < 0) & (arrive <= self.cap))):
            kept.append(tuple(x[mine] for x in (*ends, leave, arrive)))

    def search(self, share: int, of: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Cells of origins, how many cells each reaches, these in order, and the
        minutes to them; of the origins of a ``share`` of ``of``, some at a time.

        Minute by minute, those who arrive take every edge; as no edge takes less
        than none, a label that is not beaten by its minute is the best."""
        cap, n = self.cap, len(self.cells)
        self.cells.sort()
        rides, walks = _csr(self.rides, n), _csr(self.walks, n)
        last = np.full(n, -1, "i4")  # the last departure of a place
        np.maximum.at(last, np.repeat(np.arange(n), np.diff(rides[0])), rides[2])
        least = walks[3].min(initial=cap + 1)
        first, end = share * n // of, (share + 1) * n // of
        wide = max(1, min(LABELS // n, ORIGINS))
        best = np.full(wide * n, cap + 1, np.min_scalar_type(cap + 1))
        for at in range(first, end, wide):
            origins = np.arange(at, min(at + wide, end))
            waiting: list[list[np.ndarray]] = [[] for _ in range(cap + 1)]
            waiting[0].append(np.arange(len(origins)) * n + origins)
            best[waiting[0][0]] = 0
            reached, minutes = [], []
            for minute in range(cap + 1):
                while waiting[minute]:
                    keys = np.unique(np.concatenate(waiting[minute]))
                    waiting[minute] = []
                    keys = keys[best[keys] == minute]
                    reached.append(keys)
                    minutes.append(minute)
                    place = keys % n
                    if minute + least <= cap:
                        new, edge = _beyond(keys, place, walks, n)
                        self._arrive(best, waiting, new, walks[3][edge] + minute)
                    boards = last[place] >= minute
                    if boards.any():
                        new, edge = _beyond(keys[boards], place[boards], rides, n)
                        runs = rides[2][edge] >= minute
                        self._arrive(best, waiting, new[runs], rides[3][edge[runs]])
            keys = np.concatenate(reached)
            best[keys] = cap + 1
            order = np.argsort(keys)
            keys, took = keys[order], np.repeat(np.array(minutes), [len(x) for x in reached])[order]
            yield self.cells[origins], np.bincount(keys // n, minlength=len(origins)), self.cells[keys % n], took

    @staticmethod
    def _arrive(best: np.ndarray, waiting: list[list[np.ndarray]], new: np.ndarray, arrival: np.ndarray) -> None:
        """Keep the labels ``new`` that are better than those known, to be taken up at their ``arrival``."""
        better = arrival < best[new]
        new, arrival = new[better], arrival[better]
        order = np.argsort(-arrival, kind="stable")  # where several arrive, the earliest stays
        new, arrival = new[order], arrival[order]
        best[new] = arrival
        turns = np.flatnonzero(np.diff(arrival)) + 1
        for a, b in itertools.pairwise([0, *turns.tolist(), len(new)] if len(new) else []):
            waiting[arrival[a]].append(new[a:b])


def _beyond(keys: np.ndarray, place: np.ndarray, graph: tuple[np.ndarray, ...], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels one edge on from ``keys``, and the edges taken."""
    heads, to = graph[:2]
    degree = heads[place + 1] - heads[place]
    edge = np.arange(degree.sum()) + np.repeat(heads[place] - (np.cumsum(degree) - degree), degree)
    return np.repeat(keys - place, degree) + to[edge], edge


def _searches(cap: int, bucket: int) -> Callable:
    rounded = (np.rint(np.arange(cap + 1) / bucket) * bucket).astype("i4")  # half-even

    def found(feed: pa.Array, graph: _Feed, share: int, of: int) -> Iterator[pa.RecordBatch]:
        for origins, counts, reached, minutes in graph.search(share, of):
            at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype("i4"))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (reached, rounded[minutes])]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([feed] * len(origins)), pa.array(origins), *lists], ["feed", "origin", *FOLDED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                unit, share, of, *bodies = (batch.column(name)[i].as_py() for name in ("unit", "share", "of", *_BODIES))
                if held is None or held[0] != unit:
                    if held is not None:
                        yield from found(*held[1:])
                    held = unit, batch.column("feed").slice(i, 1), _Feed(cap), share, of
                held[2].add(*bodies)
        if held is not None:
            yield from found(*held[1:])

    return run


def folded_matrix(
    stop_times: DataFrame,
    stops: DataFrame,
    depart: int,
    cap: int = 90,
    bucket: int = 5,
    walk_minutes: int = 12,
    ring: int = 1,
    salts: int = SALTS,
) -> DataFrame:
    """The rows of ``timetable_matrix``, an origin's as one: ``feed, origin,
    destination, travel_minutes``, the last two arrays in the order of the cells.

    Each share of a feed's origins, at least ``salts`` and about one for each
    partition of the session in all, gets a copy of the feed's places and edges,
    packed, and searches from its origins there: no label ever leaves its task.
    """
    spark = stop_times.sparkSession
    ensure_checkpoint_dir(spark)
    places = stop_cells(stops, ring).checkpoint()
    known = F.col("feed").isNotNull() & F.col("cell").isNotNull()
    edges = ride_edges(hops(stop_times, stops), depart, cap).unionByName(walk_edges(places, walk_minutes))
    edges = edges.select("feed", "src", "dst", "walk", F.explode_outer("runs").alias("run")).select(
        "feed", "src", "dst", F.coalesce("run.leave", F.lit(-1)).alias("leave"), F.coalesce("run.reach", "walk").alias("arrive")
    )
    feed = places.schema["feed"].dataType.simpleString()
    pack = lambda df, *names: df.sortWithinPartitions("feed", "src").mapInArrow(
        _packed(*names), f"feed {feed}, {', '.join(f'{x} binary' for x in _BODIES)}"
    )
    pieces = pack(places.filter(known).select("feed", F.col("cell").alias("src")), "src").unionByName(pack(edges, *_BODIES)).checkpoint()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = places.filter(known).groupBy("feed").count().collect()
    per = max(1, -(-sum(r["count"] for r in sizes) // tasks))
    shares = [(r["feed"], max(min(salts, r["count"]), -(-r["count"] // per))) for r in sizes]
    ends = itertools.accumulate(of for _, of in shares)
    shares = spark.createDataFrame([(f, of, end - of) for (f, of), end in zip(shares, ends, strict=True)], f"feed {feed}, of int, first int")
    dealt = pieces.join(F.broadcast(shares), "feed").select("*", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("share"))
    dealt = dealt.withColumn("unit", F.col("first") + F.col("share")).repartitionById(tasks, F.col("unit") % tasks)
    searched = dealt.sortWithinPartitions("unit", F.col("dst").isNotNull()).mapInArrow(
        _searches(cap, bucket), f"feed {feed}, origin bigint, destination array<bigint>, travel_minutes array<int>"
    )
    # A place without a feed or a cell meets only itself.
    alone = places.filter(~known).select("feed", F.col("cell").alias("origin"), F.array("cell").alias("destination"), F.array(F.lit(0)).alias("travel_minutes"))
    return searched.unionByName(alone)


def unfolded(matrix: DataFrame) -> DataFrame:
    """A folded matrix as a row per origin and destination, in the same order."""
    at = matrix.select("*", F.posexplode("destination").alias("_at", "_cell"))
    of = {"destination": F.col("_cell"), "travel_minutes": F.col("travel_minutes")[F.col("_at")].cast("bigint")}
    return at.select(*[of[c].alias(c) if c in of else c for c in matrix.columns])


def timetable_matrix(
    stop_times: DataFrame,
    stops: DataFrame,
    depart: int,
    cap: int = 90,
    bucket: int = 5,
    walk_minutes: int = 12,
    ring: int = 1,
    salts: int = SALTS,
) -> DataFrame:
    """``feed, origin, destination, travel_minutes`` for every pair of cells near
    stops of a feed that is at most ``cap`` minutes apart when leaving at
    ``depart``, by any mix of rides and walks, rounded to ``bucket`` minutes
    (half-even) after the cap; every cell has a row for itself."""
    return unfolded(folded_matrix(stop_times, stops, depart, cap, bucket, walk_minutes, ring, salts))

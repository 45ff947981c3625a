"""Travel-time matrix and reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomart.session import ensure_checkpoint_dir, scratch_path


#: Copies of the edges that leave a node, one for each share of the labels there,
#: so that a node where very many paths meet is no single key.
SALTS = 8


def _prepare_edges(edges: DataFrame, src: str, dst: str, weight: str) -> DataFrame:
    # The edge set is joined every round: materialise it once (reliable
    # checkpoint) instead of re-deriving it from its sources per round. Edges
    # over the cap stay, for their nodes reach themselves; no path takes them.
    return edges.select(F.col(src).alias("_src"), F.col(dst).alias("_dst"), F.col(weight).alias("_w")).checkpoint()


def _nodes(e: DataFrame) -> DataFrame:
    return e.select(F.col("_src").alias("node")).union(e.select(F.col("_dst").alias("node"))).distinct()


def _extend(frontier: DataFrame, e: DataFrame, cap_minutes: int) -> DataFrame:
    """New arrivals one edge beyond the frontier, several per pair maybe."""
    salted = e.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    front = frontier.withColumn("_salt", F.pmod(F.xxhash64("origin"), F.lit(SALTS)).cast("int"))
    return (
        front.join(salted, (front.node == salted._src) & (front["_salt"] == salted["_salt"]))
        .select("origin", F.col("_dst").alias("node"), (F.col("minutes") + F.col("_w")).alias("new"))
        .filter(F.col("new") <= cap_minutes)
    )


def _bucketed(minutes: DataFrame, bucket: int) -> DataFrame:
    return minutes.select(
        F.col("origin"),
        F.col("node").alias("destination"),
        (F.bround(F.col("minutes") / bucket, 0) * bucket).cast("bigint").alias("travel_minutes"),
    )


def travel_time_matrix(
    edges: DataFrame,
    cap_minutes: int = 90,
    bucket: int = 5,
    src: str = "src",
    dst: str = "dst",
    weight: str = "minutes",
) -> DataFrame:
    """Shortest travel time between all node pairs reachable within the cap;
    ``(origin, destination, travel_minutes)``.

    Min-plus relaxation as DataFrame joins: each round joins only the labels
    improved in the previous round (the frontier) with the edges on the node
    and keeps those that beat all earlier ones, until nothing improves. Edge
    minutes are not negative, so the cap bounds the rounds. The cap is applied
    before bucketing to the nearest ``bucket`` minutes (half-even); every node
    of an edge has a 0-minute row for itself.

    Labels are an append-only log, a folder per round; a round adds what it
    improved, and the best label per pair is taken once, at the end. A lost
    executor costs a part of one round.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e = _prepare_edges(edges, src, dst, weight)
    log = scratch_path(spark, "labels")
    start = _nodes(e).select(F.col("node").alias("origin"), "node", F.lit(0).cast("bigint").alias("minutes"))
    start.write.parquet(f"{log}/round=0")
    read = lambda *rounds: spark.read.schema(start.schema).parquet(*[f"{log}/round={r}" for r in rounds])
    last = 0
    while True:
        new = _extend(read(last), e, cap_minutes).select("origin", "node", F.lit(None).cast("bigint").alias("old"), "new")
        known = read(*range(last + 1)).select("origin", "node", F.col("minutes").alias("old"), F.lit(None).cast("bigint").alias("new"))
        best = known.unionByName(new).groupBy("origin", "node").agg(F.min("old").alias("old"), F.min("new").alias("new"))
        better = best.filter(F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new") < F.col("old"))))
        last += 1
        better.select("origin", "node", F.col("new").alias("minutes")).write.parquet(f"{log}/round={last}")
        if read(last).isEmpty():
            labels = read(*range(last)).groupBy("origin", "node").agg(F.min("minutes").alias("minutes"))
            return _bucketed(labels, bucket)


def reachable_from(
    matrix: DataFrame,
    origins: DataFrame,
    cell_to_area: DataFrame,
    areas: DataFrame,
    group: str,
    max_minutes: int,
    min_population: int = 500,
) -> DataFrame:
    """Areas reachable within ``max_minutes`` from any cell of each origin
    group's areas (A11): ``0 < minutes <= N``, origin areas excluded,
    population above ``min_population``, distinct.

    ``origins`` is ``(group, area_id)``; ``cell_to_area`` is ``(cell, area_id)``;
    ``areas`` is ``(area_id, area_name, population)``.
    """
    origin_cells = origins.join(cell_to_area, "area_id").select(group, F.col("cell").alias("origin")).distinct()
    hits = (
        origin_cells.join(matrix, "origin")
        .filter((F.col("travel_minutes") > 0) & (F.col("travel_minutes") <= max_minutes))
        .select(group, F.col("destination").alias("cell"))
        .distinct()
    )
    dest = hits.join(cell_to_area, "cell").select(group, "area_id").distinct()
    return (
        dest.join(origins, [group, "area_id"], "left_anti")
        .join(areas, "area_id")
        .filter(F.col("population") > min_population)
        .select(group, "area_id", "area_name")
        .distinct()
    )


def with_matrix_metadata(
    matrix: DataFrame,
    mode: str,
    feed_source: str | Column,
    version: str,
    departure_time: str = "08:30",
    service_date: str | None = None,
) -> DataFrame:
    """Matrix rows with the lookup columns of the stored table: mode, feed,
    departure, service date and computation version."""
    return matrix.select(
        "*",
        F.lit(mode).alias("mode"),
        F.lit(feed_source).alias("feed_source"),
        F.lit(departure_time).alias("departure_time"),
        (F.lit(service_date).cast("date") if service_date else F.lit(None).cast("date")).alias("service_date"),
        F.lit(version).alias("computation_version"),
    )


def write_matrix(matrix: DataFrame, path: str, folded: bool = False) -> None:
    """Store the matrix partitioned by (mode, feed_source) and sorted by
    origin inside the files: lookups by mode prune folders, lookups by
    origin skip row groups through min/max statistics.

    A ``folded`` matrix, with a row per origin as ``timetable.folded_matrix`` has
    them, comes in ranges of origins; the same rows are stored, but only origins
    are sorted, and nothing is exchanged."""
    from geomart.operators.timetable import unfolded
    from geomart.sources.sinks import write_partitioned

    if folded:
        write_partitioned(matrix, path, ["mode", "feed_source"], sort_within=["origin"], unfold=unfolded)
    else:
        write_partitioned(matrix, path, ["mode", "feed_source"], sort_within=["origin", "destination"])


def matrix_lookup(matrix: DataFrame, mode: str, version: str | None = None) -> DataFrame:
    """Filter a stored matrix to one mode and (optionally) one computation
    version; the version is a parameter, never a hard-coded tag."""
    out = matrix.filter(F.col("mode") == mode)
    if version is not None:
        out = out.filter(F.col("computation_version") == version)
    return out

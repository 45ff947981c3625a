"""Joins that must not broadcast rows the planner cannot count, timetables over
shared reach, rings by pairs, marts at size."""

import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from geomart.functions import cells
from geomart.operators import bridge, names, reach, spatial, timetable
from geomart.sources import tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- names ---------------------------------------------------------------------------------


def test_postings_are_not_broadcast(spark, tmp_path):
    rng = random.Random(1)
    words = ["large", "small", "Ring", "bolt", "ä"]
    parts = [(i, " ".join(rng.choices(words, k=2)) if i % 9 else None, i % 5) for i in range(200)]
    spark.createDataFrame(parts, "id long, name string, population int").write.parquet(str(tmp_path / "p"))
    targets = spark.read.parquet(str(tmp_path / "p"))
    queries = spark.createDataFrame([("ring",), ("Ring bolt",), ("Ä",), ("zzz",)], "query string")
    found = names.contains_matches(queries, targets, "query", "name", "id")
    assert "Broadcast" not in _plan(found)
    want = {(q, i) for q in ("ring", "Ring bolt", "Ä", "zzz") for i, n, _ in parts if n and q.lower() in n.lower()}
    rows = [(r.query, r.id) for r in found.collect()]
    assert len(rows) == len(want) and set(rows) == want


# ---- timetables ----------------------------------------------------------------------------


def test_ride_edges_keep_the_runs_that_none_beats(spark):
    rng = random.Random(3)
    legs = [("e", 1, rng.randint(490, 560), 2, 0) for _ in range(60)]
    legs = [(f, a, d, b, d + rng.randint(1, 40)) for f, a, d, b, _ in legs]
    df = spark.createDataFrame(legs, "feed string, src long, departure int, dst long, arrival int")
    edge = timetable.ride_edges(df, 500, 90)
    (row,) = edge.collect()
    runs = [(r.leave, r.reach) for r in row.runs]
    assert len(runs) < 60 and not any(o[0] > r[0] and o[1] <= r[1] for r in runs for o in runs)
    at = edge.crossJoin(spark.range(91).withColumn("m", F.col("id").cast("int"))).select("m", timetable.earliest("m", 90).alias("new")).collect()
    want = {m: min((r - 500 for _, _, d, _, r in legs if d - 500 >= max(m, 0) and r - 500 <= 90), default=None) for m in range(91)}
    assert {r.m: r.new for r in at} == want


def _jobs(spark, run):
    """How many jobs ``run`` takes."""
    group = f"jobs-{id(run)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def _line(spark, n):
    """A trip over ``n`` stops far from each other, a minute each."""
    at = spark.range(n).select(F.lit("e").alias("feed"), F.col("id").alias("stop_id"), cells.hex_cell(F.lit(170.0) + F.col("id") / 10, F.lit(-40.0)).alias("cell"))
    minute = (F.col("id") + 500).cast("int")
    calls = spark.range(n).select(F.lit("e").alias("feed"), F.lit(1).alias("trip_id"), F.col("id").alias("seq"), F.col("id").alias("stop_id"), minute.alias("arrival"), minute.alias("departure"))
    return calls, at


def test_matrix_takes_no_job_per_leg(spark):
    def minutes(n):
        calls, at = _line(spark, n)
        first, last = (r.cell for r in at.filter(F.col("stop_id").isin(0, n - 1)).orderBy("stop_id").collect())
        got = timetable.timetable_matrix(calls, at, 500, bucket=1).filter((F.col("origin") == first) & (F.col("destination") == last))
        return [r.travel_minutes for r in got.collect()]

    took = [_jobs(spark, lambda n=n: seen.append(minutes(n))) for seen in [[]] for n in (4, 24)]
    assert took[1] < took[0] + 20
    assert minutes(4) == [3] and minutes(24) == [23]


def test_places_without_feed_or_cell_meet_only_themselves(spark):
    at = spark.createDataFrame([("e", 1, 5 << 28), ("e", 2, None), (None, 3, 9 << 28), ("w", 4, None)], "feed string, stop_id long, cell long")
    calls = spark.createDataFrame([], "feed string, trip_id long, seq long, stop_id long, arrival int, departure int")
    rows = [tuple(r) for r in timetable.timetable_matrix(calls, at, 500, walk_minutes=50).collect()]
    assert len(rows) == len(set(rows))
    assert {r for r in rows if None in r} == {("e", None, None, 0), ("w", None, None, 0)} | {(None, c, c, 0) for f, c, _, _ in rows if f is None}
    east = [r for r in rows if r[0] == "e" and r[1] is not None]
    assert sorted({m for _, _, _, m in east}) == [0, 50] and len(east) == 7 + 6 + 6 * 3 and len([r for r in rows if r[0] is None]) == 7


def test_searches_of_some_origins_at_a_time(monkeypatch):
    """Rides that take no time, in circles too, walks, shares, few labels at a time."""
    rng = random.Random(5)
    cells_of, cap = np.array(sorted(rng.sample(range(1000), 30))), 20
    rides = [(s, d, a, a + rng.choice([0, 0, 1, 4])) for s, d, a in ((rng.choice(cells_of), rng.choice(cells_of), rng.randint(0, 16)) for _ in range(120)) if s != d]
    walks = [(a, b, -1, rng.choice([3, 7, 25])) for a, b in itertools.pairwise(cells_of)]
    body = lambda x, kind: zlib.compress(np.array(x, kind).tobytes())

    def graph():
        feed = timetable._Feed(cap)
        for part in (cells_of[20:], cells_of[:20]):
            feed.add(body(np.diff(part, prepend=0), "i8"), None, None, None)
        for part in (rides[:50], rides[50:], walks):
            src, dst, leave, arrive = zip(*sorted(part), strict=True)
            feed.add(body(np.diff(src, prepend=0), "i8"), body(np.array(dst) - src, "i8"), body(leave, "i4"), body(arrive, "i4"))
        return feed

    want = {}
    for origin in cells_of:
        best = {origin: 0}
        for _ in range(40):
            for s, d, leave, arrive in rides + walks:
                if s in best and (leave < 0 or leave >= best[s]):
                    best[d] = min(best.get(d, cap + 1), best[s] + arrive if leave < 0 else arrive)
                    if best[d] > cap:
                        del best[d]
        want |= {(origin, d): t for d, t in best.items()}
    for labels, origins, of in ((1 << 25, 512, 1), (100, 512, 3), (1 << 25, 4, 2), (1, 1, 1)):
        monkeypatch.setattr(timetable, "LABELS", labels)
        monkeypatch.setattr(timetable, "ORIGINS", origins)
        got = []
        for share in range(of):
            for starts, counts, reached, minutes in graph().search(share, of):
                got += zip(np.repeat(starts, counts).tolist(), reached.tolist(), minutes.tolist(), strict=True)
        assert [x[:2] for x in got] == sorted(x[:2] for x in got)
        assert {x[:2]: x[2] for x in got} == want and len(got) == len(want)


def test_folded_matrix_is_stored_like_its_rows(spark, tmp_path):
    """Seven feeds and two modes in one task; the files of each folder are in order."""
    rng = random.Random(7)
    origins = [(f"f{i % 7}", i, sorted(rng.sample(range(99), rng.randint(1, 9)))) for i in range(60)] + [("f0", None, [None])]
    rows = [(f, o, d, [rng.randint(0, 18) * 5 for _ in d]) for f, o, d in origins]
    folded = spark.createDataFrame(rows, "feed string, origin long, destination array<long>, travel_minutes array<int>")
    both = {}
    for name, m in (("folded", folded), ("rows", timetable.unfolded(folded))):
        parts = [reach.with_matrix_metadata(m, mode, F.col("feed"), "v2", service_date="2024-01-17").drop("feed") for mode in ("transit", "car")]
        path = str(tmp_path / name)
        reach.write_matrix(parts[0].unionByName(parts[1]).coalesce(1), path, **({"folded": True} if name == "folded" else {}))
        stored = spark.read.parquet(path).withColumn("file", F.input_file_name())
        both[name] = stored.schema.fieldNames(), sorted(map(str, stored.drop("file").collect()))
        by_file = stored.filter(F.col("origin").isNotNull()).groupBy("file").agg(F.collect_list(F.struct("origin", "destination")).alias("at"))
        assert all(r["at"] == sorted(r["at"]) for r in by_file.collect())
    assert both["folded"] == both["rows"] and len(both["rows"][1]) == 2 * sum(len(d) for _, _, d, _ in rows)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0" and spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_shortlist_over_long_trips_takes_no_job_per_leg(spark, tmp_path):
    """Trips of 20 calls of 4 minutes each, by the registered query and its SQL."""
    import duckdb

    from geomart.plans import ORACLE, QUERIES

    rng = random.Random(11)
    tables_of = {
        "region": ("r_regionkey int, r_name string", [(0, "R")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(i, f"N{i}", 0) for i in range(3)]),
        "supplier": ("s_suppkey long", [(i,) for i in range(400, 440)]),
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", [(i, f"C{i}", i % 3, 1.0, "AUTO") for i in range(400, 600)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string", [(9 * i, 400 + rng.randrange(200), "F") for i in range(400)]),
        "lineitem": ("l_orderkey long, l_suppkey long, l_linenumber int", [(9 * i, 400 + (i + 3 * j) % 40, j) for i in range(400) for j in range(1, 21)]),
        "events": ("user_id long, event_type string, value double, props string", [(400 + rng.randrange(80), rng.choice(["error", "view"]), 5.0, "{}") for _ in range(30)]),
    }
    con = duckdb.connect()
    for name, (schema, rows) in tables_of.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = []
    jobs = _jobs(spark, lambda: got.extend(QUERIES["shortlist_by_timetable"](spark, str(tmp_path)).collect()))
    want = con.execute(ORACLE["shortlist_by_timetable"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 3
    assert jobs < 120


# ---- marts and rings -----------------------------------------------------------------------


def test_units_meet_their_areas_once(spark):
    """A (unit, area) pair is one row until the area's rows are together."""
    totals = spark.createDataFrame([(u, y, 10.0 * u + y) for u in (1, 2) for y in range(7)] + [(1, None, 5.0), (2, 3, 1.0), (3, 1, None)], "u int, y int, t double")
    shares = spark.createDataFrame([(1, "a", 0.25), (1, "b", 0.75), (2, "a", 1.0), (3, "b", 0.5), (9, "c", 1.0)], "u int, a string, s double")
    df = bridge.allocate(totals, shares, "u", "a", "y", "t", "s", places=2)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("RepartitionByExpression") < plan.index("Join")
    got = {(r.a, r.y): r.allocated for r in df.collect()}
    want = {}
    for u, y, t in totals.collect():
        for v, a, s in shares.collect():
            if u == v and t is not None:
                want[a, y] = want.get((a, y), 0) + t * s
    assert got == {k: int(v + 0.5) for k, v in want.items() if int(v + 0.5) > 0}


def test_a_ring_is_parsed_once(spark):
    parsed = spark.sparkContext.accumulator(0)

    @F.udf("array<struct<x:double,y:double>>")
    def ring(i):
        parsed.add(1)
        return [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]

    df = spark.range(40).withColumn("ring", ring("id"))
    assert all(r.is_valid for r in spatial.ring_validity(df, "ring", "id").collect())
    assert parsed.value == 40


def test_copies_of_the_bridge_are_not_broadcast(spark):
    facts = spark.createDataFrame([(i % 7, i) for i in range(50)] + [(None, 99)], "cell long, k long")
    cells_of = spark.createDataFrame([(c, 10 * c) for c in range(5)], "cell long, area_id long")
    df = spatial.facts_to_areas(facts, cells_of, salt_on="k")
    assert "Broadcast" not in _plan(df)
    assert sorted((r.k, r.area_id) for r in df.collect() if r.area_id is not None) == [(i, 10 * (i % 7)) for i in range(50) if i % 7 < 5]
    assert df.count() == 51


def test_dealt_rows_stay_dealt_below_a_filter(spark):
    df = tables.dealt(spark.range(1000, numPartitions=1), "id").withColumn("v", F.sqrt("id")).filter("v > 3")
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "Exchange" not in _plan(df) and df.count() == 990

"""Timetables, evolving CSV landings, slices, gram index, rings, features, WKB,
stored tables and stream expectations: edges against plain versions."""

import datetime as dt
import heapq
import itertools
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from geomart.functions import cells, features, rings, wkb
from geomart.operators import bridge, names, score, spatial, timetable
from geomart.sources import landing, sheets, tables
from geomart.streaming import evolve, expect
from geomart.streaming import landing as stream


# ---- timetables ------------------------------------------------------------------------

FEEDS = ("east", "west")


def _cell(spark, points):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, lon double, lat double")
    return {r.i: r.cell for r in df.select("i", cells.hex_cell("lon", "lat").alias("cell")).collect()}


def _network(spark):
    """Two feeds with the same stop ids at other places, trips that overtake."""
    rng = random.Random(4)
    at = _cell(spark, [(170 + 0.05 * i, -40 + 0.03 * (i % 3)) for i in range(8)])
    stops = [(f, s, at[(s + 3 * (f == "west")) % 8]) for f in FEEDS for s in range(6)]
    calls, trip = [], 0
    for f in FEEDS:
        for _ in range(25):
            trip, t = trip + 1, rng.randint(480, 560)
            for seq, s in enumerate(rng.sample(range(6), rng.randint(2, 5))):
                calls.append((f, trip, 10 * seq, s, t, t + rng.randint(0, 2)))
                t = calls[-1][5] + rng.randint(0, 25)
    return stops, calls


def _earliest(stops, calls, ring_of, depart, cap, walk):
    """Plain search by time from every place of a feed."""
    place = {(f, s): c for f, s, c in stops}
    out = {}
    for f in FEEDS:
        places = {c for (g, _), x in place.items() if g == f for c in ring_of[x]}
        trips = {}
        for g, t, seq, s, a, d in calls:
            if g == f:
                trips.setdefault(t, []).append((seq, place[f, s], a, d))
        legs = [(x[1], x[3], y[1], y[2]) for ts in trips.values() for x, y in itertools.pairwise(sorted(ts))]
        for origin in places:
            best, heap = {origin: depart}, [(depart, origin)]
            while heap:
                t, c = heapq.heappop(heap)
                if t > best[c]:
                    continue
                steps = [(a, dst) for src, d, dst, a in legs if src == c and d >= t and a >= d] + [(t + walk, n) for n in ring_of[c] if n in places and n != c]
                for a, dst in steps:
                    if a <= depart + cap and a < best.get(dst, 10**9):
                        best[dst] = a
                        heapq.heappush(heap, (a, dst))
            for c, t in best.items():
                out[f, origin, c] = round((t - depart) / 5) * 5
    return out


def test_timetable_matrix_equals_plain_search(spark):
    stops, calls = _network(spark)
    s = spark.createDataFrame(stops, "feed string, stop_id long, cell long")
    c = spark.createDataFrame(calls, "feed string, trip_id long, seq long, stop_id long, arrival int, departure int")
    wide = s.select(F.explode(cells.kring("cell", 1)).alias("cell")).distinct()
    ring_of = {r.cell: set(r.ring) for r in wide.select("cell", cells.kring("cell", 1).alias("ring")).collect()}
    got = timetable.timetable_matrix(c, s, depart=500, cap=60, walk_minutes=9, salts=3).collect()
    want = _earliest(stops, calls, ring_of, 500, 60, 9)
    assert {(r.feed, r.origin, r.destination): r.travel_minutes for r in got} == want
    assert len(got) == len(want) and {r.feed for r in got} == set(FEEDS)


def test_only_trips_of_the_day_run(spark):
    trips = spark.createDataFrame([("e", 1, "a"), ("e", 2, "b"), ("w", 3, "a")], "feed string, trip_id long, service_id string")
    days = spark.createDataFrame([("e", "a", dt.date(2024, 1, 1)), ("w", "a", dt.date(2024, 1, 2))], "feed string, service_id string, service_date date")
    assert [(r.feed, r.trip_id) for r in timetable.active_trips(trips, days, F.lit(dt.date(2024, 1, 1))).collect()] == [("e", 1)]


# ---- CSV landings by header --------------------------------------------------------------


def _put(spark, root, day, text):
    spark.createDataFrame([(text,)], "t string").coalesce(1).write.mode("append").option("lineSep", "\n").text(f"{root}/raw/{day}")
    # Spark's text writer names files .txt; a landing has .csv files.
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(hadoop.Path(f"{root}/raw/{day}")):
        if f.getPath().getName().startswith("part-"):
            fs.mkdirs(hadoop.Path(f"{root}/landing/{day}"))
            fs.rename(f.getPath(), hadoop.Path(f"{root}/landing/{day}/{f.getPath().getName()}.csv"))


def test_csv_schema_grows_and_reads_back_as_written(spark, tmp_path):
    root = str(tmp_path)
    run = lambda: evolve.evolving_csv_append(spark, f"{root}/landing", f"{root}/sink", f"{root}/ck", "s")
    read = lambda: evolve.read_evolving(spark, f"{root}/sink")
    _put(spark, root, "2024-01-01", "id,name,when,none\n1,a,2024-01-01,\n2,,2024-02-01,")
    assert run() == 1 and run() == 0
    assert dict(read().dtypes) | {} == {"id": "bigint", "name": "string", "when": "date", "none": "string", "_source_file": "string", "_source": "string", "_run_date": "date"}
    # A column in the middle, another order, one file twice the width of the other.
    _put(spark, root, "2024-01-02", "id,code,name\n3,007,c")
    _put(spark, root, "2024-01-02", 'name,id,when\n"d, e",4.5,2024-01-01 10:00:00')
    assert run() == 2
    got = {r.name: r for r in read().collect()}
    assert dict(read().dtypes)["id"] == "double" and dict(read().dtypes)["when"] == "timestamp_ntz"
    assert got["c"].code == "007" and got["c"].id == 3.0 and got["d, e"].id == 4.5 and got["a"].code is None
    assert got["a"].when == dt.datetime(2024, 1, 1) and got["c"]._run_date == dt.date(2024, 1, 2)
    _put(spark, root, "2024-01-03", "id\nx9")
    assert run() == 1
    assert sorted(r.id for r in read().collect()) == ["1", "2", "3", "4.5", "x9"]
    assert evolve.stored_schema(spark, f"{root}/sink", before=1)["id"] == "bigint"


def test_a_failed_batch_is_repeated_whole(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    _put(spark, root, "2024-01-01", "id,name\n1,a")
    store = evolve._store_schema

    def fail(*args):
        store(*args)
        raise OSError("lost")

    monkeypatch.setattr(evolve, "_store_schema", fail)
    with pytest.raises(OSError):
        evolve.evolving_csv_append(spark, f"{root}/landing", f"{root}/sink", f"{root}/ck")
    monkeypatch.setattr(evolve, "_store_schema", store)
    assert evolve.evolving_csv_append(spark, f"{root}/landing", f"{root}/sink", f"{root}/ck") == 1
    assert [(r.id, r.name) for r in evolve.read_evolving(spark, f"{root}/sink").collect()] == [(1, "a")]


def test_a_column_that_stands_twice_is_an_error(spark, tmp_path):
    _put(spark, str(tmp_path), "2024-01-01", "id,ID\n1,2")
    with pytest.raises(ValueError, match="twice"):
        evolve.evolving_csv_append(spark, f"{tmp_path}/landing", f"{tmp_path}/sink", f"{tmp_path}/ck")


@pytest.mark.parametrize("values, kind", [(["1", "-2"], "bigint"), (["1", "2.5"], "double"), (["01"], "string"), (["true", "False"], "boolean"), (["2024-01-01"], "date"), (["2024-01-01", "2024-01-01 10:00:00"], "string"), (["2024-13-01"], "string"), ([None], None), (["1", None], "bigint"), (["99999999999999999999"], "double"), (["1", "x"], "string")])
def test_types_of_text(spark, values, kind):
    assert evolve.infer_types(spark.createDataFrame([(v,) for v in values], "`a.b` string"), ["a.b"]) == {"a.b": kind}


def test_lattice_meets_above_both():
    assert evolve.widest("bigint", "double") == "double" and evolve.widest("date", "timestamp_ntz") == "timestamp_ntz"
    assert evolve.widest("boolean", "bigint") == "string" and evolve.widest(None, "date") == "date" and evolve.widest(None, None) is None


# ---- slices, newest landing, run log, sheets -----------------------------------------------


def test_hash_skip_of_a_hot_source_over_many_slices(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", rng.choice(["h1", "h2", None, None, None]), 1000 + i // 4) for i in range(400)] + [(1000 + i, None, "h", i) for i in range(5)]
    runs = spark.createDataFrame(rows, "run_id long, source string, content_hash string, at long").repartition(7)
    got = {r.run_id: r.status for r in landing.hash_skip_status(runs, order=["at", "run_id"], slices=23).collect()}
    want, last = {}, {}
    for i, s, h, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        want[i] = "failed" if h is None else "skipped" if last.get(s) == h else "succeeded"
        last[s] = h or last.get(s)
    assert got == want


def test_newest_landing_opens_only_its_files(spark, tmp_path):
    for day, text in (("2024-01-01", "code,label\n1,old"), ("2024-03-01", "code,label\n1,new")):
        _put(spark, f"{tmp_path}/set", day, text)
    found = landing.newest_landings(spark, f"{tmp_path}/set", ["landing", "missing"])
    assert list(found) == ["landing"] and found["landing"][0] == dt.date(2024, 3, 1) and len(found["landing"][1]) == 1
    out = landing.latest_file_union(spark, f"{tmp_path}/set", ["missing", "landing"], {"landing": ("code", "label"), "missing": ("a", "b")})
    assert all("2024-03-01" in f for f in out.inputFiles()) and [r.label for r in out.collect()] == ["new"]
    with pytest.raises(FileNotFoundError):
        landing.latest_file_union(spark, f"{tmp_path}/set", ["missing"], {"missing": ("a", "b")})


def test_run_log_needs_its_keys(spark):
    with pytest.raises(ValueError, match="source, status"):
        landing.run_log_rows(spark.createDataFrame([(1,)], "run_id long"))


@pytest.mark.parametrize("body, message", [("Other,Name\n,\n,\n,\n,\n2024-03-31,5", "titles"), ("Date,Price\n,\n,\n,\n,\nnotes,5\n2024-03-31,", "no row")])
def test_faulty_sheets_fail_by_name(spark, tmp_path, body, message):
    (tmp_path / "good.csv").write_text("Date,Price\n,\n,\n,\n,\n2024-03-31,5")
    assert sheets.read_positional(spark, str(tmp_path / "good.csv"), {"Price": "price"}).count() == 1
    (tmp_path / "bad.csv").write_text(body)
    with pytest.raises(sheets.SheetValidationError, match=f"bad.csv: .*{message}"):
        sheets.read_positional(spark, str(tmp_path), {"Price": "price"})


def test_landing_has_few_files_per_date(spark, tmp_path):
    rows = spark.range(0, 4000, numPartitions=40).select("id", F.when(F.col("id") % 10 < 8, "2024-01-01").otherwise(F.concat(F.lit("2024-01-1"), F.col("id") % 10)).alias("day"))
    landing.write_landing(rows, f"{tmp_path}/l", "json", "day")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = landing.list_files(spark, f"{tmp_path}/l", "*.json").groupBy("run_date").count().collect()
    assert len(files) == 3 and sum(r["count"] for r in files) <= parts + 3
    assert spark.read.json(f"{tmp_path}/l").count() == 4000


# ---- names -----------------------------------------------------------------------------------


def test_contains_search_equals_plain_search(spark):
    rng = random.Random(8)
    words = ["Mount", "Éden", "saint", "Heliers", "o", "Bay", "e B", "100%", "a_b"]
    targets = [(i, " ".join(rng.sample(words, rng.randint(1, 4))), rng.choice([None, 5, 9, 100])) for i in range(300)] + [(900, "", 1), (901, None, 1)]
    queries = ["", "o", "E", "mount", "unt é", "Bay", "bay saint", "zzz", "Heliers o", "%", "_", None, "saint"]
    t = spark.createDataFrame(targets, "id long, name string, population long")
    got = sorted(tuple(r) for r in names.resolve_names(spark.createDataFrame([(q,) for q in queries], "query string"), t, limit=4).collect())
    want = []
    for q in {q for q in queries if q is not None}:
        exact = [(q, i, n, "exact") for i, n, _ in targets if n == q]
        near = sorted(((-(p or -1), i, n) for i, n, p in targets if q and n is not None and q.lower() in n.lower()))[:4]
        want += exact or [(q, i, n, "contains") for _, i, n in near]
    assert got == sorted(want)


# ---- rings, features, WKB ----------------------------------------------------------------------


def _rings(spark, shapes):
    rows = [(i, [(float(x), float(y)) for x, y in s]) for i, s in enumerate(shapes)]
    return spark.createDataFrame(rows, "id int, ring array<struct<x:double,y:double>>")


def _wrap(points):
    return [(x - 360 if x > 180 else x, y) for x, y in points]


def test_rings_over_the_antimeridian(spark):
    box = [(179.9, -40.1), (180.1, -40.1), (180.1, -39.9), (179.9, -39.9), (179.9, -40.1)]
    # The grid's own seam is 180 degrees from its centre.
    seam = [(x - 187.0, y) for x, y in box]
    away = [(x - 5.0, y) for x, y in box]
    df = _rings(spark, [_wrap(box), box, seam, away])
    c = {r.id: r for r in rings.with_centroid(df, "ring", "x", "y", "a").collect()}
    assert all(math.isclose(abs(c[i].x), 180.0, abs_tol=1e-9) and -180 < c[i].x <= 180 for i in (0, 1)) and math.isclose(c[2].x, -7.0, abs_tol=1e-9)
    assert all(math.isclose(c[i].a, 0.04, rel_tol=1e-6) for i in c)
    filled = spatial.polyfill(df, "ring", "id").groupBy("id").agg(F.collect_set("cell").alias("s"), F.count("*").alias("n")).collect()
    found = {r.id: set(r.s) for r in filled}
    assert all(r.n == len(r.s) for r in filled) and found[0] == found[1]
    # The same box elsewhere has as many cells, but for those cut by its sides.
    assert abs(len(found[0]) - len(found[3])) <= 0.05 * len(found[3]) + 8 and abs(len(found[2]) - len(found[3])) <= 0.1 * len(found[3]) + 16
    centre = spark.createDataFrame([(c,) for c in found[0]], "cell long").select(*cells.cell_centre("cell")).collect()
    assert all(179.9 <= (x if x > 0 else x + 360) <= 180.1 for x, _ in centre)


def _touch(a, b, c, d):
    cross = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
    on = lambda o, p, q: cross(o, p, q) == 0 and min(o[0], p[0]) <= q[0] <= max(o[0], p[0]) and min(o[1], p[1]) <= q[1] <= max(o[1], p[1])
    sign = lambda x: (x > 0) - (x < 0)
    if sign(cross(a, b, c)) * sign(cross(a, b, d)) < 0 and sign(cross(c, d, a)) * sign(cross(c, d, b)) < 0:
        return True
    return on(a, b, c) or on(a, b, d) or on(c, d, a) or on(c, d, b)


def _contacts(ring):
    points = [p for i, p in enumerate(ring) if i == 0 or p != ring[i - 1]]
    edges = list(itertools.pairwise(points))
    n, bad = len(edges), set()
    for i, j in itertools.combinations(range(n), 2):
        (a, b), (c, d) = edges[i], edges[j]
        follows, closes = j == i + 1, i == 0 and j == n - 1
        if follows or closes:
            dot = lambda o, p, q: (p[0] - o[0]) * (q[0] - o[0]) + (p[1] - o[1]) * (q[1] - o[1])
            cross = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
            back = follows and cross(b, a, d) == 0 and dot(b, a, d) > 0
            shut = closes and cross(a, b, c) == 0 and dot(a, b, c) > 0
            hit = (back and shut) if follows and closes else back or shut
        else:
            hit = _touch(a, b, c, d)
        if hit:
            bad.add((i, j))
    return bad


def test_self_contacts_equal_all_pairs(spark):
    rng = random.Random(12)
    shapes = []
    for k in range(60):
        n = rng.randint(3, 12)
        pts = [(rng.randint(0, 6), rng.randint(0, 6)) for _ in range(n)] if k % 2 else [(round(5 * math.cos(2 * math.pi * i / n), 3), round(3 * math.sin(2 * math.pi * i / n), 3)) for i in range(n)]
        shapes.append([*pts, pts[0]])
    circle = [(round(10 * math.cos(2 * math.pi * i / 400), 6), round(10 * math.sin(2 * math.pi * i / 400), 6)) for i in range(400)]
    shapes += [[*circle, circle[0]], [*circle, (0, 0), (0, 20), circle[0]]]
    df = _rings(spark, shapes)
    got = {}
    for r in spatial.self_contacts(df, "ring", "id").collect():
        got.setdefault(r.id, set()).add((r.i, r.j))
    for i, s in enumerate(shapes):
        if len({p for p in s}) >= 2:
            assert got.get(i, set()) == _contacts(s), s
    v = {r.id: r.is_valid for r in spatial.ring_validity(df, "ring", "id").collect()}
    assert v[60] and not v[61] and all(v[i] for i in range(0, 60, 2))


@pytest.mark.parametrize("text, want", [
    ('{"type":"Polygon","coordinates":[[[0,0],[0,4],[4,4],[4,0],[0,0]],[[0,0],[0,2],[2,2],[2,0],[0,0]]]}', (28 / 12, 28 / 12)),
    ('{"type":"MultiPoint","coordinates":[[0,0],[2,4]]}', (1, 2)),
    ('{"type":"LineString","coordinates":[[3,5],[3,5]]}', (3, 5)),
    ('{"type":"Polygon","coordinates":[[[1,1],[3,1],[1,1]]]}', (5 / 3, 1)),
    ('{"type":"Polygon","coordinates":[]}', None), ('{"type":"Circle","coordinates":[1,2]}', None), ("no json", None), (None, None), ('{"type":"Point"}', None),
])
def test_feature_centroids(spark, text, want):
    (r,) = features.with_feature_centroid(spark.createDataFrame([(text,)], "g string"), "g").collect()
    assert (r.centroid_lon, r.centroid_lat) == (pytest.approx(want) if want else (None, None))


def test_wkb_is_the_format_and_reads_both_byte_orders(spark):
    ring = [(0.1, -0.0), (1e300, 5e-300), (-179.99999999999997, 1 / 3), (2.0**52 + 1, -(2.0**-40)), (0.1, 0.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]
    df = spark.createDataFrame([([ring, hole],)], "r array<array<struct<x:double,y:double>>>")
    (r,) = df.select(wkb.polygon_wkb(F.col("r")).alias("w"), wkb.line_wkb(F.col("r")[0]).alias("l"), wkb.point_wkb(F.lit(1.5), F.lit(-2.5)).alias("p")).collect()
    pack = lambda order, parts: struct.pack(order + "II", 3, len(parts)) + b"".join(struct.pack(order + "I", len(p)) + b"".join(struct.pack(order + "dd", *q) for q in p) for p in parts)
    clean = [[(x + 0.0, y + 0.0) for x, y in p] for p in (ring, hole)]
    assert bytes(r.w) == b"\0" + pack(">", clean)
    assert bytes(r.p) == b"\0" + struct.pack(">Idd", 1, 1.5, -2.5) and bytes(r.l)[:9] == b"\0" + struct.pack(">II", 2, 5)
    rows = [(bytes(r.w),), (b"\1" + pack("<", clean),), (bytes(r.l),), (b"\1" + struct.pack("<Idd", 1, 1.5, -2.5),), (b"\1" + struct.pack("<I", 7),), (b"\0" + struct.pack(">II", 3, 0),)]
    got = spark.createDataFrame(rows, "w binary").select(wkb.read_wkb(F.col("w")).alias("g")).collect()
    parts = [g.g and (g.g.type, [[tuple(p) for p in part] for part in g.g.parts]) for g in got]
    assert parts == [("Polygon", clean), ("Polygon", clean), ("LineString", clean[:1]), ("Point", [[(1.5, -2.5)]]), None, ("Polygon", [])]


def test_wkb_through_the_geometry_type(spark):
    spark.conf.set("spark.sql.geospatial.enabled", "true")
    try:
        df = spark.createDataFrame([([[(0.0, 0.0), (2.0, 0.0), (2.0, 3.0), (0.0, 0.0)]],)], "r array<array<struct<x:double,y:double>>>")
        written = df.select(wkb.polygon_wkb(F.col("r")).alias("w"))
        (r,) = written.select(wkb.read_wkb(F.expr("st_asbinary(st_geomfromwkb(w))")).alias("g")).collect()
    finally:
        spark.conf.unset("spark.sql.geospatial.enabled")
    assert [tuple(p) for p in r.g.parts[0]] == [(0.0, 0.0), (2.0, 0.0), (2.0, 3.0), (0.0, 0.0)]


# ---- stored tables, allocation, affordability, stream expectations -----------------------------


def test_stored_table_is_written_once_and_joins_without_exchange(spark):
    made = []

    def build():
        made.append(1)
        return spark.range(5000).select((F.col("id") % 700).alias("cell"), "id")

    first = tables.stored_by_key(spark, "here", "t", "cell", build)
    again = tables.stored_by_key(spark, "here", "t", "cell", build)
    assert len(made) == 1 and first.count() == again.count() == 5000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        other = tables.stored_by_key(spark, "here", "u", "cell", lambda: spark.range(700).withColumnRenamed("id", "cell"))
        plan = first.join(other, "cell")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    tables.stored_by_key(spark, "here", "t", "cell", build, refresh=True)
    assert len(made) == 2


def test_decimal_allocation_rounds_the_exact_sum(spark):
    totals = spark.createDataFrame([("u", 2020, 0.1), ("v", 2020, 0.2), ("w", 2020, 0.2)], "u string, y int, t double")
    shares = spark.createDataFrame([("u", "a", 1.0), ("v", "a", 1.0), ("w", "a", 1.0)], "u string, a string, s double")
    assert [r.allocated for r in bridge.allocate(totals, shares, "u", "a", "y", "t", "s", places=1).collect()] == [1]


def test_affordability_takes_the_newest_year_of_each_area(spark):
    years = spark.createDataFrame([(1, 2018, 100.0, 10_000.0), (1, 2023, 200.0, 30_000.0), (2, 2018, 400.0, 20_000.0), (3, 2023, None, 50_000.0)], "area_id long, year int, weekly_rent double, income double")
    areas = spark.createDataFrame([(1, "t", 3), (2, "t", 1), (3, "t", None)], "area_id long, ta string, population long")
    (r,) = score.affordability_latest(years, areas, "ta").collect()
    assert (r.data_year, r.median_rent_weekly, r.household_income_annual, r.income_source) == (2023, 250, 35_000, "area_median")
    (g,) = score.affordability_latest(years, areas, "ta", household_income=0).collect()
    assert (g.affordability_band, g.income_decile, g.rent_to_income_pct) == ("unknown", None, None)


def test_stream_counts_equal_the_rows_dropped(spark, tmp_path):
    root = str(tmp_path)
    rules = {"big": "v > 2"}
    for part in ([1, 2, 3, None], [5, 6]):
        spark.createDataFrame([(v,) for v in part], "v int").coalesce(1).write.mode("append").json(f"{root}/in")
        s = stream.read_landing_stream(spark, "json", f"{root}/in", spark.createDataFrame([], "v int").schema)
        assert expect.append_with_expectations(s, f"{root}/out", f"{root}/ck", f"{root}/report", drop=rules) == 1
    report = sorted(tuple(r) for r in expect.read_report(spark, f"{root}/report").collect())
    assert report == [(0, "big", "drop", 3, 4), (1, "big", "drop", 0, 2)]
    assert sorted(r.v for r in spark.read.parquet(f"{root}/out").collect()) == [3, 5, 6]

"""Timetable queries: travel-time matrix per feed, areas in reach over the
stored matrix.

Test form: suppliers are stops of two feeds that share the stop ids but not the
places; every order is a trip (even keys in one feed, odd ones in the other)
whose line items are its calls in line (and supplier) order, and its customer is its service,
so the service calendar decides which trips run on the day.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomart.functions import cells
from geomart.operators import names, reach, score, timetable
from geomart.plans import area_marts as A
from geomart.plans import spatial_marts as S
from geomart.plans import views as V
from geomart.plans.registry import ORACLE, register
from geomart.session import scratch_path
from geomart.sources.tables import read_table

SERVICE_DATE = "2024-01-17"  # a Wednesday
DEPART, CAP, WALK = 510, 90, 12  # 08:30
FEED_SHIFT = {"east": 0, "west": 40}
MODE, VERSION = "transit", "v2"


def stops(spark, sf):
    s = read_table(spark, sf, "supplier", "s_suppkey")
    feed = F.explode(F.array(*[F.struct(F.lit(f).alias("feed"), F.lit(d).alias("shift")) for f, d in FEED_SHIFT.items()])).alias("f")
    s = s.select("s_suppkey", feed).select(F.col("f.feed").alias("feed"), F.col("s_suppkey").alias("stop_id"), (F.col("s_suppkey") + F.col("f.shift")).alias("k"))
    point = [h(F.col("k")).cast("double") / 100 for h in (V.lon_h, V.lat_h)]
    return s.select("feed", "stop_id", cells.hex_cell(*point).alias("cell"))


def _feed(key):
    return F.when(key % 2 == 0, "east").otherwise("west")


def stop_times(spark, sf, trips):
    """Calls of the ``trips`` (``feed, trip_id``)."""
    li = read_table(spark, sf, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber")
    k = F.col("l_orderkey")
    li = li.join(trips, (k == trips.trip_id) & (_feed(k) == trips.feed), "left_semi")
    arrival = 360 + (k * 37) % 360 + (F.col("l_linenumber") - 1) * (4 + k % 9)
    return li.select(
        _feed(k).alias("feed"), k.alias("trip_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey")).alias("seq"), F.col("l_suppkey").alias("stop_id"),
        arrival.cast("int").alias("arrival"), (arrival + 1).cast("int").alias("departure"),
    )


def running(spark, sf):
    o = read_table(spark, sf, "orders", "o_orderkey", "o_custkey")
    trips = o.select(_feed(F.col("o_orderkey")).alias("feed"), F.col("o_orderkey").alias("trip_id"), F.col("o_custkey").alias("service_id"))
    return timetable.active_trips(trips, A.service_day_expand(spark, sf), F.lit(SERVICE_DATE).cast("date"))


def matrix(spark, sf, of=timetable.timetable_matrix):
    return of(stop_times(spark, sf, running(spark, sf)), stops(spark, sf), DEPART, CAP, walk_minutes=WALK)


_STOP_POINT = "CAST(16600 + (k * 37) % 1300 AS DOUBLE) / 100 AS lon, CAST(-4700 + (k * 53 + k // 1300) % 1300 AS DOUBLE) / 100 AS lat"
_RING = ", ".join(f"({dq * cells.SHIFT + dr})" for dq, dr in cells.ring_offsets(1))

MATRIX_SQL = f"""days AS ({ORACLE["service_day_expand"]}),
st AS (SELECT feed, stop_id, {cells.hex_cell_sql('lon', 'lat')} AS cell
       FROM (SELECT feed, s_suppkey AS stop_id, {_STOP_POINT}
             FROM (SELECT s_suppkey, feed, s_suppkey + shift AS k FROM supplier, (VALUES {", ".join(f"('{f}', {d})" for f, d in FEED_SHIFT.items())}) f(feed, shift)) a) b),
places AS (SELECT DISTINCT feed, cell + d AS cell FROM st, (VALUES {_RING}) o(d)),
runs AS (SELECT o_orderkey AS trip_id FROM orders o JOIN days d
         ON d.feed = CASE WHEN o_orderkey % 2 = 0 THEN 'east' ELSE 'west' END AND d.service_id = o.o_custkey AND d.service_date = DATE '{SERVICE_DATE}'),
calls AS (SELECT st.feed, l_orderkey AS trip_id, l_linenumber * 1000000 + l_suppkey AS seq, st.cell,
                 360 + (l_orderkey * 37) % 360 + (l_linenumber - 1) * (4 + l_orderkey % 9) AS arrival
          FROM lineitem JOIN st ON st.stop_id = l_suppkey AND st.feed = CASE WHEN l_orderkey % 2 = 0 THEN 'east' ELSE 'west' END
          WHERE l_orderkey IN (SELECT trip_id FROM runs)),
legs AS (SELECT feed, cell AS src, arrival + 1 - {DEPART} AS leave, lead(cell) OVER w AS dst, lead(arrival) OVER w - {DEPART} AS reach
         FROM calls WINDOW w AS (PARTITION BY feed, trip_id ORDER BY seq)),
edge AS (SELECT DISTINCT feed, src, dst, leave, reach FROM legs WHERE dst <> src AND reach >= leave AND leave >= 0 AND reach <= {CAP}
         UNION ALL SELECT a.feed, a.cell, b.cell, NULL, NULL FROM places a, (VALUES {_RING}) o(d), places b
                   WHERE d <> 0 AND b.feed = a.feed AND b.cell = a.cell + d),
lab AS (SELECT feed, cell AS origin, cell, CAST(0 AS BIGINT) AS t FROM places
        UNION SELECT l.feed, l.origin, e.dst, coalesce(e.reach, l.t + {WALK})
        FROM lab l JOIN edge e ON e.feed = l.feed AND e.src = l.cell AND (e.leave IS NULL OR e.leave >= l.t) WHERE coalesce(e.reach, l.t + {WALK}) <= {CAP}),
tm AS (SELECT feed, origin, cell AS destination, CAST(round_even(min(t) / 5.0, 0) * 5 AS BIGINT) AS travel_minutes FROM lab GROUP BY 1, 2, 3)"""


@register("timetable_matrix", f"WITH RECURSIVE {MATRIX_SQL}\nSELECT feed, origin, destination, travel_minutes FROM tm")
def timetable_matrix(spark, sf):
    """Minutes by trips and walks between all cells near stops, leaving on a
    Wednesday at 08:30, within 90, per feed (A14, J11)."""
    return matrix(spark, sf)


_paths: dict[tuple[str, str], str] = {}


def stored_matrix_path(spark, sf):
    """Where the matrix is stored with its lookup columns, written once in an
    application. Next to it are rows of an older version and of another mode,
    which lookups must pass over."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _paths:
        path = scratch_path(spark, "matrix")
        rows = lambda m, mode, version: reach.with_matrix_metadata(m, mode, F.col("feed"), version, "08:30", SERVICE_DATE).drop("feed")
        minutes = F.col("travel_minutes")
        matrix(spark, sf, timetable.folded_matrix).write.option("compression", "zstd").parquet(path + "-folded")
        base = spark.read.parquet(path + "-folded")
        reach.write_matrix(rows(base, MODE, VERSION), path, folded=True)
        older = rows(base.withColumn("travel_minutes", F.transform(minutes, lambda m: m - 5)), MODE, "v1")
        car = rows(base.withColumn("travel_minutes", F.array_repeat(F.lit(5), F.size(minutes))), "car", VERSION)
        reach.write_matrix(older.unionByName(car), path + "-other", folded=True)
        _paths[at] = path
    return _paths[at]


_AREA_CELL = cells.hex_cell_sql("lon", "lat")


_REACH_SQL = f"""
ac AS (SELECT *, {_AREA_CELL} AS cell FROM area),
oc AS (SELECT DISTINCT ta_name AS origin_ta, cell AS origin FROM ac),
hits AS (SELECT DISTINCT oc.origin_ta, m.destination FROM oc JOIN tm m ON oc.origin = m.origin WHERE m.travel_minutes > 0 AND m.travel_minutes <= 60),
reach AS (SELECT DISTINCT h.origin_ta, a.area_id, a.area_name FROM hits h JOIN ac a ON a.cell = h.destination WHERE a.ta_name <> h.origin_ta AND a.population > 500)"""


@register(
    "reachable_areas_by_timetable",
    f"WITH RECURSIVE {MATRIX_SQL},\n{V.AREA_SQL},{_REACH_SQL}\nSELECT * FROM reach",
)
def reachable_areas_by_timetable(spark, sf):
    """Areas within 60 minutes of any cell of each TA's areas, by the transit
    mode and the newest version of the stored matrix (J7, A11)."""
    a = V.area(spark, sf).withColumn("cell", cells.hex_cell("lon", "lat"))
    origins = a.select(F.col("ta_name").alias("origin_ta"), "area_id")
    path = stored_matrix_path(spark, sf)
    table = functools.reduce(DataFrame.unionByName, [spark.read.parquet(path + part) for part in ("", "-other")])
    lookup = reach.matrix_lookup(table, MODE, VERSION)
    return reach.reachable_from(lookup, origins, a.select("cell", "area_id"), a.select("area_id", "area_name", "population"), "origin_ta", 60)


@register(
    "shortlist_by_timetable",
    f"WITH RECURSIVE {MATRIX_SQL},\n{V.AREA_SQL},{_REACH_SQL},\n{A.HAZARD_LOOKUP_SQL}"
    + """,
s AS (SELECT r.origin_ta, r.area_id, r.area_name, a.weekly_rent, row_number() OVER (PARTITION BY r.origin_ta ORDER BY a.weekly_rent, r.area_id) AS rank
      FROM reach r JOIN area a ON r.area_id = a.area_id LEFT JOIN hlk h ON r.area_id = h.area_id
      WHERE a.weekly_rent <= 700 AND (h.flood_risk IS NULL OR h.flood_risk <> 'high'))
SELECT origin_ta, area_id, area_name, weekly_rent, rank FROM s WHERE rank <= 4""",
)
def shortlist_by_timetable(spark, sf):
    """Areas in reach by timetable, rent within budget, flood 'high' left out,
    the four cheapest per origin TA (A21)."""
    a = V.area(spark, sf).filter(F.col("weekly_rent") <= 700).select("area_id", "weekly_rent")
    r = reachable_areas_by_timetable(spark, sf).join(a, "area_id")
    of = S.stored_bridge(spark, sf).join(r.select("area_id").distinct(), "area_id", "left_semi")
    h = score.hazard_levels(of.join(A.stored_hazards(spark, sf), "cell"), "area_id").select("area_id", "flood_risk")
    c = r.join(h, "area_id", "left").filter(~F.col("flood_risk").eqNullSafe("high"))
    top = names.top_k_per_group(c, ["origin_ta"], [F.col("weekly_rent"), F.col("area_id")], 4, salt_on="area_id")
    return top.select("origin_ta", "area_id", "area_name", "weekly_rent", F.col("rank").cast("bigint").alias("rank"))

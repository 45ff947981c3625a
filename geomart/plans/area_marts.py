"""Area analytics: bridges, hazards, affordability, names, calendars, reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from geomart.functions import cells
from geomart.operators import bridge as B
from geomart.operators import calendar, names, reach, score, snapshots, spatial
from geomart.plans import spatial_marts as S
from geomart.plans import views as V
from geomart.plans.registry import register
from geomart.plans.table_marts import sround
from geomart.sources import files
from geomart.sources.tables import read_table, stored_by_key


def bround_sql(expr: str, n: int) -> str:
    return f"CAST(round_even(CAST({expr} AS DECIMAL(38,12)), {n}) AS DOUBLE)"


# ---- bridges and allocation ---------------------------------------------------------

_PAIRS_SQL = """pairs AS (
  SELECT l.l_suppkey, p.p_brand, count(*) AS n_overlap
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2)"""


def _pairs(spark, sf):
    li = read_table(spark, sf, "lineitem", "l_suppkey", "l_partkey")
    p = read_table(spark, sf, "part", "p_partkey", "p_brand")
    return li.join(p, li.l_partkey == p.p_partkey).select("l_suppkey", "p_brand")


@register(
    "share_of_total",
    V.with_ctes(_PAIRS_SQL)
    + f"""SELECT l_suppkey, p_brand, n_overlap,
       {sround('n_overlap / sum(n_overlap) OVER (PARTITION BY l_suppkey)', 6)} AS unit_share,
       {sround('n_overlap / sum(n_overlap) OVER (PARTITION BY p_brand)', 6)} AS area_share
FROM pairs""",
)
def share_of_total(spark, sf):
    """Concordance: overlap counts and shares both ways, 6 dp."""
    return B.overlap_shares(_pairs(spark, sf), "l_suppkey", "p_brand").drop("unit_share_raw")


@register(
    "weighted_allocation",
    V.with_ctes(_PAIRS_SQL)
    + f""",
sh AS (SELECT l_suppkey, p_brand, {sround("n_overlap / sum(n_overlap) OVER (PARTITION BY l_suppkey)", 6)} AS share FROM pairs),
tot AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) AS total FROM lineitem GROUP BY 1, 2),
al AS (SELECT p_brand, year, CAST({sround('sum(total * share)', 0)} AS BIGINT) AS allocated
       FROM tot JOIN sh ON tot.l_suppkey = sh.l_suppkey GROUP BY 1, 2)
SELECT p_brand, year, allocated FROM al WHERE allocated > 0""",
)
def weighted_allocation(spark, sf):
    """Annual unit totals x stored unit share (6 places), summed per area and year, rounded
    after the sum, > 0 kept (A2, J4, G2)."""
    shares = B.overlap_shares(_pairs(spark, sf), "l_suppkey", "p_brand")
    li = read_table(spark, sf, "lineitem", "l_suppkey", "l_shipdate", "l_quantity")
    totals = li.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("total"))
    return B.allocate(totals, shares, "l_suppkey", "p_brand", "year", "total", "unit_share")


@register(
    "rollup_monthly",
    """SELECT CAST(year(l.l_shipdate) AS INTEGER) AS ship_year, CAST(month(l.l_shipdate) AS INTEGER) AS ship_month,
       s.s_nationkey, l.l_returnflag, l.l_linestatus, l.l_linenumber,
       round(sum(l.l_quantity), 2) AS total_l_quantity, max(l.l_extendedprice) AS max_l_extendedprice
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
GROUP BY 1, 2, 3, 4, 5, 6""",
)
def rollup_monthly(spark, sf):
    """Grouped SUM + MAX at a 6-key monthly grain (G1)."""
    li = read_table(spark, sf, "lineitem", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_extendedprice")
    s = read_table(spark, sf, "supplier", "s_suppkey", "s_nationkey")
    j = li.join(s, li.l_suppkey == s.s_suppkey).select(
        F.year("l_shipdate").alias("ship_year"), F.month("l_shipdate").alias("ship_month"),
        "s_nationkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_extendedprice",
    )
    keys = ["ship_year", "ship_month", "s_nationkey", "l_returnflag", "l_linestatus", "l_linenumber"]
    out = B.rollup(j, keys, "l_quantity", "l_extendedprice")
    return out.withColumn("total_l_quantity", F.round("total_l_quantity", 2))


# ---- hazard mart --------------------------------------------------------------------

# Test form: each event is a hazard feature at its user's location; the event
# type plays the hazard layer (fixed mapping of the test data).
_LAYER_OF_FLAG = {
    "in_flood_plain": "error",
    "in_flood_prone_area": "purchase",
    "in_flood_sensitive_area": "signup",
    "in_coastal_inundation_1_aep": "click",
    "in_coastal_inundation_100yr": "view",
}
_REGIONAL_MIN_VALUE = 90.0


def hazard_mart(spark, sf):
    """Cell-grain hazard flags, de-duplicated sorted sources, max event value
    and a deterministic sample (A6, G5-G7)."""
    e = read_table(spark, sf, "events", "user_id", "event_type", "value", "props")
    u = F.col("user_id")
    pts = e.select(
        "event_type", "value", "props",
        cells.hex_cell((V.lon_h(u) + 1).cast("double") / 100, (V.lat_h(u) + 1).cast("double") / 100).alias("cell"),
    )
    flags = [F.bool_or(F.col("event_type") == t).alias(f) for f, t in _LAYER_OF_FLAG.items()]
    return pts.groupBy("cell").agg(
        *flags,
        F.bool_or(F.col("value") >= _REGIONAL_MIN_VALUE).alias("in_regional_flood_zone"),
        F.sort_array(F.collect_set("event_type")).alias("hazard_sources"),
        F.max("value").alias("max_value"),
        F.min("props").alias("sample_props"),
    )


def stored_hazards(spark, sf):
    """The hazard mart as a table stored by cell."""
    return stored_by_key(spark, sf, "hazard", "cell", lambda: hazard_mart(spark, sf))


_HZ_SQL = f""",
ev AS (SELECT event_type, value, props,
              CAST(16600 + (user_id * 37) % 1300 + 1 AS DOUBLE) / 100 AS lon,
              CAST(-4700 + (user_id * 53 + user_id // 1300) % 1300 + 1 AS DOUBLE) / 100 AS lat FROM events),
evc AS (SELECT event_type, value, props, {cells.hex_cell_sql('lon', 'lat')} AS cell FROM ev),
hz AS (SELECT cell, {", ".join(f"bool_or(event_type = '{t}') AS {f}" for f, t in _LAYER_OF_FLAG.items())},
              bool_or(value >= {_REGIONAL_MIN_VALUE}) AS in_regional_flood_zone,
              list_sort(list(DISTINCT event_type)) AS hazard_sources,
              max(value) AS max_value, min(props) AS sample_props
       FROM evc GROUP BY cell)"""


@register("flag_aggregate", V.with_ctes(S.POLY_SQL + _HZ_SQL) + "SELECT * FROM hz")
def flag_aggregate(spark, sf):
    """Hazard mart per cell."""
    return hazard_mart(spark, sf)


def hazard_lookup_df(spark, sf):
    per_area = score.hazard_levels(S.stored_bridge(spark, sf).join(stored_hazards(spark, sf), "cell"), "area_id")
    c = read_table(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("area_id"))
    return c.join(per_area, "area_id", "left").select(
        "area_id", "flood_risk", "coastal_risk", "overall_risk", "hazard_sources",
        F.coalesce("cells_examined", F.lit(0)).alias("cells_examined"),
    )


_LEVEL_SQL = """CASE greatest(CASE flood_risk WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 END,
                     CASE coastal_risk WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 END)
     WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' END"""

HAZARD_LOOKUP_SQL = S.FILL_SQL + _HZ_SQL + f""",
hl AS (
  SELECT b.area_id,
         CASE WHEN bool_or(h.in_flood_plain) THEN 'high'
              WHEN bool_or(h.in_flood_prone_area OR h.in_flood_sensitive_area OR h.in_regional_flood_zone) THEN 'medium'
              ELSE 'low' END AS flood_risk,
         CASE WHEN bool_or(h.in_coastal_inundation_1_aep) THEN 'high'
              WHEN bool_or(h.in_coastal_inundation_100yr) THEN 'medium' ELSE 'low' END AS coastal_risk,
         list_sort(list_distinct(flatten(list(h.hazard_sources)))) AS hazard_sources,
         count(*) AS cells_examined
  FROM bridge b JOIN hz h ON b.cell = h.cell GROUP BY b.area_id),
hlk AS (
  SELECT c.c_custkey AS area_id, hl.flood_risk, hl.coastal_risk, {_LEVEL_SQL} AS overall_risk,
         hl.hazard_sources, coalesce(hl.cells_examined, 0) AS cells_examined
  FROM customer c LEFT JOIN hl ON c.c_custkey = hl.area_id)"""


@register("hazard_lookup", V.with_ctes(HAZARD_LOOKUP_SQL) + "SELECT * FROM hlk")
def hazard_lookup(spark, sf):
    """Flood / coastal / overall level per area over its cells; areas without
    hazard rows keep NULL levels ("no data", not "low") (A12)."""
    return hazard_lookup_df(spark, sf)


@register(
    "hazard_exposure",
    V.with_ctes(S.FILL_SQL + _HZ_SQL)
    + """SELECT b.area_id, count(*) AS cells, count(h.cell) AS hazard_cells,
       CAST(sum(CAST(h.in_flood_plain AS INTEGER)) AS BIGINT) AS flood_plain_cells,
       CAST(sum(CAST(h.in_coastal_inundation_1_aep AS INTEGER)) AS BIGINT) AS coastal_1aep_cells
FROM bridge b LEFT JOIN hz h ON b.cell = h.cell GROUP BY b.area_id""",
)
def hazard_exposure(spark, sf):
    """Per area: cells, hazard-covered cells and flag counts; uncovered cells
    stay through the left join (A20, G12)."""
    j = S.stored_bridge(spark, sf).join(stored_hazards(spark, sf), "cell", "left")
    return j.groupBy("area_id").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count("max_value").alias("hazard_cells"),
        F.sum(F.col("in_flood_plain").cast("int")).alias("flood_plain_cells"),
        F.sum(F.col("in_coastal_inundation_1_aep").cast("int")).alias("coastal_1aep_cells"),
    )


# ---- deciles and affordability --------------------------------------------------------

_DEC_SQL = """dec AS (
  SELECT area_id, income, CAST(ntile(10) OVER (ORDER BY income, area_id) AS INTEGER) AS income_decile
  FROM area WHERE income IS NOT NULL)"""


def deciles(spark, sf):
    a = V.area(spark, sf).filter(F.col("income").isNotNull()).select("area_id", "income")
    return score.exact_ntile(a, 10, ["income", "area_id"], out="income_decile")


@register("income_decile", V.with_ctes(V.AREA_SQL, _DEC_SQL) + "SELECT area_id, income, income_decile FROM dec")
def income_decile(spark, sf):
    """NTILE(10) of all areas by income, NULL incomes excluded, id tie-break;
    computed without a single-partition window (W4)."""
    return deciles(spark, sf)


def _w(v):
    return f"CASE WHEN {v} IS NOT NULL THEN coalesce(population, 1) END"


_AFF_SQL = f""",
a AS (SELECT area.*, dec.income_decile FROM area LEFT JOIN dec ON area.area_id = dec.area_id),
g AS (SELECT ta_name,
             sum(weekly_rent * {_w('weekly_rent')}) / sum({_w('weekly_rent')}) AS r,
             sum(area.income * {_w('area.income')}) / sum({_w('area.income')}) AS inc,
             sum(income_decile * {_w('income_decile')}) / sum({_w('income_decile')}) AS d
      FROM a AS area GROUP BY ta_name),
cur AS (
  SELECT ta_name, quarter AS ta_latest_quarter, rent_value AS ta_latest_rent FROM taq t
  WHERE rent_value IS NOT NULL
    AND quarter = (SELECT max(t2.quarter) FROM taq t2 WHERE t2.ta_name = t.ta_name AND t2.rent_value IS NOT NULL))
SELECT g.ta_name,
       CAST({bround_sql('r', 0)} AS BIGINT) AS median_rent_weekly,
       CAST({bround_sql('r * 52', 0)} AS BIGINT) AS annual_rent,
       CAST({bround_sql('inc', 0)} AS BIGINT) AS household_income_annual,
       CASE WHEN inc > 0 THEN {bround_sql('r * 52 / inc * 100', 1)} END AS rent_to_income_pct,
       CASE WHEN NOT inc > 0 OR inc IS NULL THEN 'unknown' WHEN r * 52 / inc < 0.25 THEN 'affordable'
            WHEN r * 52 / inc <= 0.35 THEN 'moderate stress' ELSE 'housing stressed' END AS affordability_band,
       CAST({bround_sql('d', 0)} AS INTEGER) AS income_decile,
       cur.ta_latest_rent, cur.ta_latest_quarter
FROM g LEFT JOIN cur ON g.ta_name = cur.ta_name"""


@register("affordability_score", V.with_ctes(V.AREA_SQL, _DEC_SQL, V.TAQ_SQL) + _AFF_SQL)
def affordability_score(spark, sf):
    """Affordability for every TA at once: population-weighted rent and
    income, annual = weekly x 52, band, weighted decile, and the TA's latest
    quarterly value alongside (A13)."""
    a = V.area(spark, sf).join(deciles(spark, sf).select("area_id", "income_decile"), "area_id", "left")
    aff = score.affordability(a, "ta_name")
    cur = snapshots.current_state(V.taq(spark, sf), "ta_name", "quarter", ["rent_value"], nonnull="rent_value")
    cur = cur.select("ta_name", F.col("quarter").alias("ta_latest_quarter"), F.col("rent_value").alias("ta_latest_rent"))
    return aff.join(cur, "ta_name", "left")


@register(
    "rate_per_1k",
    V.with_ctes(V.AREA_SQL)
    + f"""SELECT a.area_id, a.area_name, a.population, coalesce(o.n, 0) AS incidents,
       CASE WHEN a.population > 0 THEN {sround('CAST(coalesce(o.n, 0) AS DOUBLE) * 1000.0 / a.population', 2)} END AS incidents_per_1k
FROM area a LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON a.area_id = o.o_custkey""",
)
def rate_per_1k(spark, sf):
    """Area snapshot with a per-1,000-population rate."""
    o = read_table(spark, sf, "orders", "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    a = V.area(spark, sf).select("area_id", "area_name", "population")
    j = a.join(o, a.area_id == o.o_custkey, "left")
    n = F.coalesce("n", F.lit(0))
    return j.select(
        "area_id", "area_name", "population", n.alias("incidents"),
        F.when(F.col("population") > 0, F.round(n.cast("double") * 1000.0 / F.col("population"), 2)).alias("incidents_per_1k"),
    )


@register(
    "density_per_10k",
    V.with_ctes(V.AREA_SQL)
    + f""",
am AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2),
j AS (SELECT a.ta_name, a.area_id, a.population, coalesce(am.n, 0) AS n
      FROM area a LEFT JOIN am ON am.o_custkey = a.area_id AND am.o_orderpriority = '1-URGENT')
SELECT ta_name, CAST(sum(population) AS BIGINT) AS pop, CAST(sum(n) AS BIGINT) AS facilities,
       {sround('CAST(sum(n) AS DOUBLE) * 10000.0 / NULLIF(sum(population), 0)', 2)} AS facilities_per_10k
FROM j GROUP BY ta_name""",
)
def density_per_10k(spark, sf):
    """Facilities per 10k population by TA: facilities pre-aggregated per
    area, then a left join whose ON clause carries the type filter, so areas
    with none stay and population is not inflated by fan-out (A17, J9)."""
    o = read_table(spark, sf, "orders", "o_custkey", "o_orderpriority")
    am = o.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    a = V.area(spark, sf).select("ta_name", "area_id", "population")
    j = a.join(am, (am.o_custkey == a.area_id) & (am.o_orderpriority == "1-URGENT"), "left")
    g = j.groupBy("ta_name").agg(
        F.sum("population").alias("pop"), F.sum(F.coalesce("n", F.lit(0))).alias("facilities")
    )
    return g.select(
        "ta_name", "pop", "facilities",
        F.round(F.col("facilities").cast("double") * 10000.0 / F.nullif(F.col("pop"), F.lit(0)), 2).alias("facilities_per_10k"),
    )


@register(
    "topk_areas",
    V.with_ctes(V.AREA_SQL)
    + "SELECT area_id, area_name, population FROM area ORDER BY population DESC NULLS LAST, area_id LIMIT 10",
)
def topk_areas(spark, sf):
    """Top 10 areas by population, NULLs last, id tie-break."""
    a = V.area(spark, sf).select("area_id", "area_name", "population")
    return a.orderBy(F.col("population").desc_nulls_last(), "area_id").limit(10)


@register(
    "resolve_name",
    """WITH q AS (
  SELECT p_name AS query FROM part UNION SELECT split_part(p_name, ' ', 1) FROM part
  UNION SELECT split_part(p_name, ' ', 2) FROM part),
qq AS (SELECT DISTINCT query FROM q WHERE query IS NOT NULL AND query <> ''),
exact AS (SELECT qq.query, p.p_partkey AS id, p.p_name AS name, 'exact' AS match FROM qq JOIN part p ON p.p_name = qq.query),
fuzzy AS (
  SELECT query, id, name, 'contains' AS match FROM (
    SELECT qq.query, p.p_partkey AS id, p.p_name AS name,
           row_number() OVER (PARTITION BY qq.query ORDER BY p.p_size DESC NULLS LAST, p.p_partkey) AS rn
    FROM qq JOIN part p ON p.p_name ILIKE '%' || qq.query || '%'
    WHERE qq.query NOT IN (SELECT query FROM exact)) f
  WHERE rn <= 10)
SELECT * FROM exact UNION ALL SELECT * FROM fuzzy""",
)
def resolve_name(spark, sf):
    """Batch name resolution: exact match short-circuits, else up to 10
    case-insensitive contains matches by population desc nulls last (A10, U2)."""
    p = read_table(spark, sf, "part", "p_partkey", "p_name", "p_size")
    words = [F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2)]
    queries = p.select(F.explode(F.array(F.col("p_name"), *words)).alias("query")).filter(F.col("query") != "")
    targets = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("population"))
    return names.resolve_names(queries, targets)


@register(
    "rollup_reconcile",
    V.with_ctes(V.AREA_SQL, V.TAQ_SQL)
    + f""",
ro AS (SELECT ta_name, {sround('sum(weekly_rent * 52) / sum(income) * 100', 2)} AS rollup_pct
       FROM area WHERE weekly_rent IS NOT NULL AND income IS NOT NULL GROUP BY ta_name),
pub AS (SELECT ta_name, {sround('rent_value / income_value * 100', 2)} AS published_pct FROM taq t
        WHERE income_value > 0 AND quarter = (SELECT max(t2.quarter) FROM taq t2 WHERE t2.ta_name = t.ta_name AND t2.income_value > 0))
SELECT ro.ta_name, ro.rollup_pct, pub.published_pct, ro.rollup_pct - pub.published_pct AS diff_pct_points
FROM ro LEFT JOIN pub ON ro.ta_name = pub.ta_name""",
)
def rollup_reconcile(spark, sf):
    """Area ratio rolled up to TA (sum numerators / sum denominators) against
    the TA's own latest published ratio (A26)."""
    a = V.area(spark, sf).filter(F.col("weekly_rent").isNotNull() & F.col("income").isNotNull())
    ro = a.groupBy("ta_name").agg(
        F.round(F.sum(F.col("weekly_rent") * 52) / F.sum("income") * 100, 2).alias("rollup_pct")
    )
    t = V.taq(spark, sf).filter(F.col("income_value") > 0)
    pub = snapshots.current_state(t, "ta_name", "quarter", ["rent_value", "income_value"]).select(
        "ta_name", F.round(F.col("rent_value") / F.col("income_value") * 100, 2).alias("published_pct")
    )
    return ro.join(pub, "ta_name", "left").withColumn(
        "diff_pct_points", F.col("rollup_pct") - F.col("published_pct")
    )


@register(
    "suburb_dimension",
    V.with_ctes(V.AREA_SQL, S.POLY_SQL)
    + f"""SELECT a.area_id, a.area_name, a.ta_name, a.region_name, a.population,
       {cells.hex_cell_sql('(p.x0 + 0.01)', f'(p.y0 + 19.0 * {S.SIDE} / 30.0)')} AS centroid_cell,
       {sround('0.0005', 8)} AS land_area_deg2,
       CAST(NULL AS DOUBLE) AS median_age
FROM area a JOIN poly p ON a.area_id = p.area_id""",
)
def suburb_dimension(spark, sf):
    """Area dimension with polygon centroid cell, area and optional survey
    columns (typed NULL when that upstream is absent) (A7)."""
    p = spatial.polygon_centroids(S.poly_rings(spark, sf), "ring", "area").select(
        "area_id",
        cells.hex_cell("centroid_lon", "centroid_lat").alias("centroid_cell"),
        F.round("area", 8).alias("land_area_deg2"),
    )
    a = V.area(spark, sf).select("area_id", "area_name", "ta_name", "region_name", "population")
    out = a.join(p, "area_id")
    survey = files.optional_parquet(spark, f"{sf.rstrip('/')}/survey_area_features.parquet")
    if survey is None:
        return out.withColumn("median_age", F.lit(None).cast("double"))
    return out.join(survey.select("area_id", F.col("median_age").cast("double")), "area_id", "left")


# ---- service calendar -----------------------------------------------------------------

_ISO = {1: "monday", 2: "tuesday", 3: "wednesday", 4: "thursday", 5: "friday", 6: "saturday", 7: "sunday"}


@register(
    "service_day_expand",
    V.with_ctes(V.CAL_SQL, V.CALX_SQL)
    + f""",
feed AS (SELECT unnest(['east', 'west']) AS feed),
fcal AS (SELECT feed, cal.* FROM cal, feed),
fcalx AS (SELECT feed, calx.* FROM calx, feed WHERE feed = 'east' OR exception_type = 1),
days AS (SELECT c.*, CAST(d AS DATE) AS service_date
         FROM fcal c, unnest(generate_series(CAST(c.start_date AS TIMESTAMP), CAST(c.end_date AS TIMESTAMP), INTERVAL 1 DAY)) t(d)),
regular AS (SELECT feed, service_id, service_date FROM days
            WHERE CASE isodow(service_date) {" ".join(f"WHEN {k} THEN {v}" for k, v in _ISO.items())} END = 1),
u AS (SELECT feed, service_id, service_date FROM regular
      UNION ALL SELECT feed, service_id, date FROM fcalx WHERE exception_type = 1)
SELECT DISTINCT feed, service_id, service_date FROM u
WHERE NOT EXISTS (SELECT 1 FROM fcalx x WHERE x.exception_type = 2 AND x.feed = u.feed AND x.service_id = u.service_id AND x.date = u.service_date)""",
)
def service_day_expand(spark, sf):
    """Calendar x days, weekday match, additions unioned, removals win.
    Two feeds share their service ids; only one of them removes days."""
    feeds = F.explode(F.array(F.lit("east"), F.lit("west"))).alias("feed")
    cal = V.cal(spark, sf).select("*", feeds)
    calx = V.calx(spark, sf).select("*", feeds).filter((F.col("feed") == "east") | (F.col("exception_type") == 1))
    return calendar.expand_service_days(cal, calx, key=["feed", "service_id"])


# ---- travel-time matrix and reach ------------------------------------------------------

CAP = 90


def _matrix_sql(cap: int = CAP) -> str:
    return ",\n".join([
        V.EDGE_SQL,
        "nodes AS (SELECT src AS node FROM edge UNION SELECT dst FROM edge)",
        f"walk AS (SELECT node AS origin, node, CAST(0 AS BIGINT) AS minutes FROM nodes UNION "
        f"SELECT r.origin, e.dst, r.minutes + e.minutes FROM walk r JOIN edge e ON r.node = e.src WHERE r.minutes + e.minutes <= {cap})",
        "best AS (SELECT origin, node, min(minutes) AS minutes FROM walk GROUP BY 1, 2)",
        "m AS (SELECT origin, node AS destination, CAST(round_even(minutes / 5.0, 0) * 5 AS BIGINT) AS travel_minutes FROM best)",
    ])


def matrix(spark, sf):
    return reach.travel_time_matrix(V.edge(spark, sf), cap_minutes=CAP)


def stored_matrix(spark, sf):
    """The matrix as a table stored by origin."""
    return stored_by_key(spark, sf, "matrix", "origin", lambda: matrix(spark, sf))


@register("travel_time_matrix", "WITH RECURSIVE " + _matrix_sql() + "\nSELECT origin, destination, travel_minutes FROM m")
def travel_time_matrix(spark, sf):
    """All-pairs travel minutes within 90, bucketed to 5."""
    return matrix(spark, sf)


_REACH_SQL = f""",
oc AS (SELECT DISTINCT region_name AS origin_region, ta_key AS origin FROM area),
hits AS (SELECT DISTINCT oc.origin_region, m.destination FROM oc JOIN m ON oc.origin = m.origin
         WHERE m.travel_minutes > 0 AND m.travel_minutes <= 45),
reach AS (
  SELECT DISTINCT h.origin_region, a.area_id, a.area_name FROM hits h JOIN area a ON a.ta_key = h.destination
  WHERE a.area_id NOT IN (SELECT area_id FROM area o WHERE o.region_name = h.origin_region)
    AND a.population > 500)"""


def reachable(spark, sf, max_minutes: int = 45):
    a = V.area(spark, sf)
    origins = a.select(F.col("region_name").alias("origin_region"), "area_id")
    cell_to_area = a.select(F.col("ta_key").alias("cell"), "area_id")
    return reach.reachable_from(
        stored_matrix(spark, sf), origins, cell_to_area, a.select("area_id", "area_name", "population"),
        "origin_region", max_minutes,
    )


@register(
    "reachable_areas",
    "WITH RECURSIVE " + _matrix_sql() + ",\n" + V.AREA_SQL + _REACH_SQL + "\nSELECT * FROM reach",
)
def reachable_areas(spark, sf):
    """Areas reachable within 45 minutes from any cell of each region's areas,
    origins excluded, population > 500, distinct (A11, J7, U3)."""
    return reachable(spark, sf)


@register(
    "constraint_shortlist",
    "WITH RECURSIVE " + _matrix_sql() + ",\n" + V.AREA_SQL + _REACH_SQL + ",\n" + HAZARD_LOOKUP_SQL
    + """,
shortlist AS (
  SELECT r.origin_region, r.area_id, r.area_name, a.weekly_rent,
         row_number() OVER (PARTITION BY r.origin_region ORDER BY a.weekly_rent, r.area_id) AS rank
  FROM reach r JOIN area a ON r.area_id = a.area_id
  LEFT JOIN hlk h ON r.area_id = h.area_id
  WHERE a.weekly_rent <= 600 AND (h.flood_risk IS NULL OR h.flood_risk <> 'high'))
SELECT origin_region, area_id, area_name, weekly_rent, rank FROM shortlist WHERE rank <= 4""",
)
def constraint_shortlist(spark, sf):
    """Reach -> rent within budget -> drop flood 'high' (no data kept) ->
    top 4 per origin by rent (A21)."""
    a = V.area(spark, sf).filter(F.col("weekly_rent") <= 600).select("area_id", "weekly_rent")
    r = reachable(spark, sf).join(a, "area_id")
    # Hazards only of the areas that are left, by their cells in the bridge.
    of = S.stored_bridge(spark, sf).join(r.select("area_id").distinct(), "area_id", "left_semi")
    h = score.hazard_levels(of.join(stored_hazards(spark, sf), "cell"), "area_id").select("area_id", "flood_risk")
    c = r.join(h, "area_id", "left").filter(~F.col("flood_risk").eqNullSafe("high"))
    return names.top_k_per_group(
        c, ["origin_region"], [F.col("weekly_rent"), F.col("area_id")], 4, salt_on="area_id"
    ).select("origin_region", "area_id", "area_name", "weekly_rent", F.col("rank").cast("bigint").alias("rank"))


@register(
    "double_burden",
    V.with_ctes(V.AREA_SQL, _DEC_SQL) + ",\n" + HAZARD_LOOKUP_SQL
    + f"""
SELECT a.area_id, {bround_sql('a.weekly_rent * 52 / a.income * 100', 1)} AS rent_to_income_pct,
       d.income_decile, h.overall_risk
FROM area a JOIN dec d ON a.area_id = d.area_id JOIN hlk h ON a.area_id = h.area_id
WHERE a.income > 0 AND (a.weekly_rent * 52 / a.income > 0.35 OR d.income_decile <= 4) AND h.overall_risk = 'high'
ORDER BY rent_to_income_pct DESC""",
)
def double_burden(spark, sf):
    """Stressed (> 35 %) or decile <= 4, and overall hazard high; by
    rent-to-income desc (A22)."""
    a = V.area(spark, sf).filter(F.col("income") > 0).select("area_id", "weekly_rent", "income")
    d = deciles(spark, sf).select("area_id", "income_decile")
    h = hazard_lookup_df(spark, sf).select("area_id", "overall_risk")
    ratio = F.col("weekly_rent") * 52 / F.col("income")
    return (
        a.join(d, "area_id")
        .join(h, "area_id")
        .filter(((ratio > 0.35) | (F.col("income_decile") <= 4)) & (F.col("overall_risk") == "high"))
        .select("area_id", F.bround(ratio * 100, 1).alias("rent_to_income_pct"), "income_decile", "overall_risk")
        .orderBy(F.col("rent_to_income_pct").desc())
    )

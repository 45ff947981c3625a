"""The (area, year) mart, affordability at the newest year, expectations on a
stream, date texts, and tables found by name or path.

Test form: a customer is an area; its orders of a year are what a survey found
there (an order is a household, urgent and high ones own their dwelling).
Suppliers are the units whose yearly quantities are allocated to areas by how
often they deliver there.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from geomart.functions import text
from geomart.operators import bridge as B
from geomart.operators import reshape, score
from geomart.operators.series import quarter_start
from geomart.plans import landing_marts as L
from geomart.plans import spatial_marts as S
from geomart.plans import views as V
from geomart.plans.area_marts import bround_sql
from geomart.plans.registry import register
from geomart.plans.table_marts import sround
from geomart.session import scratch_path
from geomart.sources import files, landing, tables
from geomart.sources.tables import read_table, stored_by_key
from geomart.streaming import expect
from geomart.streaming import landing as stream

_OWN = ("1-URGENT", "2-HIGH")


def area_years(spark, sf):
    """One row per (area, year): survey counts and ratios, the area's
    attributes, and the allocated count, null where nothing was allocated."""
    o = read_table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    o = o.withColumn("year", F.year("o_orderdate"))
    own = F.col("o_orderpriority").isin(*_OWN)
    stated = F.col("o_orderpriority") != "4-NOT SPECIFIED"
    survey = o.groupBy(F.col("o_custkey").alias("area_id"), "year").agg(
        F.count(F.lit(1)).alias("households_total"),
        F.count_if(own).alias("tenure_owned"),
        F.count_if(stated).alias("tenure_total_stated"),
    )
    li = read_table(spark, sf, "lineitem", "l_orderkey", "l_suppkey", "l_quantity", "l_shipdate")
    pairs = li.join(o.select("o_orderkey", "o_custkey"), li.l_orderkey == o.o_orderkey).select("l_suppkey", F.col("o_custkey").alias("area_id"))
    shares = B.overlap_shares(pairs, "l_suppkey", "area_id")
    totals = li.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("total"))
    counts = B.allocate(totals, shares, "l_suppkey", "area_id", "year", "total", "unit_share", out="allocated_count", places=2)
    a = V.area(spark, sf).select("area_id", "area_name", "ta_name", "region_name", "population", "weekly_rent", "income")
    rows = survey.join(a, "area_id").join(counts, ["area_id", "year"], "left")
    grown = F.col("year") - 1995
    return rows.select(
        "area_id", "year", "area_name", "ta_name", "region_name", "population", "households_total", "tenure_owned", "tenure_total_stated",
        F.round(reshape.guarded_ratio("tenure_owned", "tenure_total_stated", 100.0), 2).alias("owner_occupier_pct"),
        (F.col("weekly_rent") + 5 * grown).alias("weekly_rent"), (F.col("income") + 1000 * grown).alias("income"), "allocated_count",
    )


def stored_area_years(spark, sf):
    """The mart as a table stored by area."""
    return stored_by_key(spark, sf, "area_year", "area_id", lambda: area_years(spark, sf))


AREA_YEAR_SQL = V.AREA_SQL + f""",
survey AS (SELECT o_custkey AS area_id, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS households_total,
                  count(*) FILTER (o_orderpriority IN {_OWN}) AS tenure_owned, count(*) FILTER (o_orderpriority <> '4-NOT SPECIFIED') AS tenure_total_stated
           FROM orders GROUP BY 1, 2),
ov AS (SELECT l_suppkey, o_custkey AS area_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
sh AS (SELECT l_suppkey, area_id, CAST(round(CAST(n / sum(n) OVER (PARTITION BY l_suppkey) AS DECIMAL(38,12)), 6) AS DECIMAL(8,6)) AS share FROM ov),
tot AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year, sum(CAST(l_quantity AS DECIMAL(17,2))) AS total FROM lineitem GROUP BY 1, 2),
al AS (SELECT area_id, year, CAST(round(sum(CAST(total AS DECIMAL(20,2)) * share), 0) AS BIGINT) AS allocated_count
       FROM tot JOIN sh ON tot.l_suppkey = sh.l_suppkey GROUP BY 1, 2),
ay AS (SELECT s.area_id, s.year, a.area_name, a.ta_name, a.region_name, a.population, s.households_total, s.tenure_owned, s.tenure_total_stated,
              CASE WHEN s.tenure_total_stated > 0 THEN {sround('s.tenure_owned / s.tenure_total_stated * 100.0', 2)} END AS owner_occupier_pct,
              a.weekly_rent + 5 * (s.year - 1995) AS weekly_rent, a.income + 1000 * (s.year - 1995) AS income,
              CASE WHEN al.allocated_count > 0 THEN al.allocated_count END AS allocated_count
       FROM survey s JOIN area a ON s.area_id = a.area_id LEFT JOIN al ON al.area_id = s.area_id AND al.year = s.year)"""


@register("area_year_mart", f"WITH {AREA_YEAR_SQL}\nSELECT * FROM ay")
def area_year_mart(spark, sf):
    """Yearly facts per area with its attributes and allocated counts."""
    return stored_area_years(spark, sf)


GIVEN_INCOME = 85_000.0


def _affordable_sql(income: str, decile: str, source: str) -> str:
    return f"""SELECT r.ta_name, r.data_year, '{source}' AS income_source, CAST({bround_sql('r.rent', 0)} AS BIGINT) AS median_rent_weekly,
       CAST({bround_sql('r.rent * 52', 0)} AS BIGINT) AS annual_rent, CAST({bround_sql(income, 0)} AS BIGINT) AS household_income_annual,
       CASE WHEN {income} > 0 THEN {bround_sql(f'r.rent * 52 / {income} * 100', 1)} END AS rent_to_income_pct,
       CASE WHEN {income} IS NULL OR NOT {income} > 0 THEN 'unknown' WHEN r.rent * 52 / {income} < 0.25 THEN 'affordable'
            WHEN r.rent * 52 / {income} <= 0.35 THEN 'moderate stress' ELSE 'housing stressed' END AS affordability_band,
       CAST({decile} AS INTEGER) AS income_decile FROM r"""


@register(
    "affordability_latest_year",
    f"""WITH {AREA_YEAR_SQL},
newest AS (SELECT area_id, max(year) AS year FROM ay WHERE weekly_rent IS NOT NULL GROUP BY 1),
r AS (SELECT ay.ta_name, max(ay.year) AS data_year, sum(weekly_rent * coalesce(population, 1)) / sum(coalesce(population, 1)) AS rent
      FROM ay JOIN newest n ON n.area_id = ay.area_id AND n.year = ay.year GROUP BY 1),
d AS (SELECT ta_name, income, coalesce(population, 1) AS w, ntile(10) OVER (ORDER BY income, area_id) AS decile
      FROM ay WHERE income IS NOT NULL AND year = (SELECT max(year) FROM ay)),
i AS (SELECT ta_name, sum(income * w) / sum(w) AS income, sum(decile * w) / sum(w) AS decile FROM d GROUP BY 1)
{_affordable_sql('i.income', bround_sql('i.decile', 0), 'area_median')} LEFT JOIN i ON i.ta_name = r.ta_name
UNION ALL {_affordable_sql(f'CAST({GIVEN_INCOME} AS DOUBLE)', 'NULL', 'user_provided')}""",
)
def affordability_latest_year(spark, sf):
    """Affordability of every TA by the newest year of its areas, with the
    areas' income and with a given one (A13)."""
    years = stored_area_years(spark, sf).select("area_id", "year", "weekly_rent", "income")
    areas = V.area(spark, sf).select("area_id", "ta_name", "population")
    median = score.affordability_latest(years, areas, "ta_name")
    return median.unionByName(score.affordability_latest(years, areas, "ta_name", household_income=GIVEN_INCOME))


_RULES_KEEP = {"value_known": "value IS NOT NULL", "small": "value < 200"}
_RULES_DROP = {"positive": "value >= 1.0", "user_known": "user_id % 10 <> 3"}
_HALF = "2024-01-16"


def _rule_rows() -> str:
    rules = [*[(n, "warn", p) for n, p in _RULES_KEEP.items()], *[(n, "drop", p) for n, p in _RULES_DROP.items()]]
    return " UNION ALL ".join(f"SELECT batch, '{n}' AS rule, '{a}' AS action, count(*) FILTER (NOT coalesce({p}, false)) AS failed_rows, count(*) AS total_rows FROM b GROUP BY 1" for n, a, p in rules)


@register(
    "stream_expectations",
    f"""WITH b AS (SELECT *, CAST(CASE WHEN CAST(ts AS DATE) < DATE '{_HALF}' THEN 0 ELSE 1 END AS BIGINT) AS batch FROM events)
{_rule_rows()}""",
)
def stream_expectations(spark, sf):
    """Failed rows per rule and micro-batch of a landing that comes in two
    halves, observed while the rows pass (R2, Q1)."""
    base = scratch_path(spark, "stream_expect")
    root, report = f"{base}/landing/events", f"{base}/report"
    e = read_table(spark, sf, "events", *L._EVENT_COLS, "ts").withColumn("landing_date", F.to_date("ts").cast("string"))
    for half in (F.col("landing_date") < _HALF, F.col("landing_date") >= _HALF):
        landing.write_landing(e.filter(half).select(*L._EVENT_COLS, "landing_date"), root, "json", "landing_date")
        s = stream.read_landing_stream(spark, "json", root, L.EVENT_SCHEMA)
        expect.append_with_expectations(s, f"{base}/silver", f"{base}/_checkpoint", report, _RULES_KEEP, _RULES_DROP)
    return expect.read_report(spark, report)


@register(
    "date_texts",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) END AS service_date,
       CASE WHEN o_orderkey % 70 <> 0 THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS report_month FROM orders""",
)
def date_texts(spark, sf):
    """Feed dates (20240131) and report months (January 2024); texts that are
    neither are null."""
    o = read_table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    k = F.col("o_orderkey")
    day = F.when(k % 50 == 0, "20241301").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    month = F.when(k % 70 == 0, "Sometime 2024").otherwise(F.concat(F.lit(" "), F.date_format("o_orderdate", "MMMM yyyy")))
    t = o.select("o_orderkey", day.alias("day"), month.alias("month"))
    return t.select("o_orderkey", text.feed_date("day").alias("service_date"), text.report_month("month").alias("report_month"))


@register("path_scan_sql", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def path_scan_sql(spark, sf):
    """A file read by its path in SQL, filter and columns pushed down."""
    return tables.read_parquet_sql(spark, f"{sf.rstrip('/')}/customer.parquet").filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")


@register("first_existing_source", f"WITH {S.FILL_SQL}\nSELECT cell, CAST(area_id AS VARCHAR) AS owner, CAST(NULL AS VARCHAR) AS note FROM bridge")
def first_existing_source(spark, sf):
    """The first table of a list that exists, and the first of several column
    names that it has (S9, P12)."""
    bridge = stored_by_key(spark, sf, "bridge", "cell", lambda: S.bridge(spark, sf))
    name = tables.stored_name(spark, sf, "bridge")
    rows = spark.table(files.first_existing_table(spark, ["geomart_no_such_table", name, "geomart_nor_this"]))
    owner = reshape.first_present(bridge, ["suburb_id", "area_id", "cell"])
    return rows.select("cell", owner.alias("owner"), reshape.first_present(bridge, ["remark", "comment"]).alias("note"))


@register(
    "run_log_rows",
    """SELECT CAST(page_id AS VARCHAR) AS run_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS source, url AS source_url,
       make_timestamp(2024, 1, 1, 0, 0, 0) + page_id * INTERVAL 1 MINUTE AS fetched_at,
       CASE WHEN length(html) < 200 THEN 'failed' ELSE 'succeeded' END AS status, sha256(html) AS content_hash, CAST(NULL AS VARCHAR) AS feed_version,
       CAST(page_id % 7 AS DOUBLE) AS duration_seconds, CAST(1 AS INTEGER) AS file_count, CAST(length(html) AS BIGINT) AS bytes_written,
       CAST(NULL AS VARCHAR) AS target_path, CASE WHEN length(html) < 200 THEN 'too short' END AS error_message, CAST(NULL AS VARCHAR) AS notes FROM pages""",
)
def run_log_rows(spark, sf):
    """Fetch attempts written to the run log in its thirteen columns."""
    log = scratch_path(spark, "runlog13") + "/ingest_runs"
    runs = L._runs(spark, sf)
    failed = F.length("html") < 200
    runs = runs.withColumns({
        "status": F.when(failed, "failed").otherwise("succeeded"), "error_message": F.when(failed, "too short"),
        "duration_seconds": (F.col("run_id") % 7).cast("double"), "file_count": F.lit(1),
    })
    even = F.col("run_id") % 2 == 0
    for part in (even, ~even):
        landing.append_run_log(spark, log, landing.run_log_rows(runs.filter(part)))
    return landing.read_run_log(spark, log).select(*landing.RUN_LOG_SCHEMA.fieldNames())


_NZ = "New Zealand"


def indicator_rows(spark, sf):
    """Long indicators at several grains: per TA, per region and for the whole
    country, each as a total (no ethnicity) and by order status in its place."""
    o = V.orders_by_ta(spark, sf)
    r = read_table(spark, sf, "nation", "n_nationkey", "n_regionkey").withColumnRenamed("n_nationkey", "_n")
    o = o.join(r, F.col("c_nationkey") == F.col("_n")).withColumn("quarter", quarter_start("o_orderdate"))
    grain = F.explode(F.array(
        F.struct(F.lit("TA").alias("area_type"), F.col("n_name").alias("area_name")),
        F.struct(F.lit("REGC").alias("area_type"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("area_name")),
        F.struct(F.lit("NZ").alias("area_type"), F.lit(_NZ).alias("area_name")),
    ))
    rows = o.select("quarter", F.col("o_orderpriority").alias("series"), "o_orderstatus", "o_totalprice", grain.alias("g"))
    ethnicity = F.explode(F.array(F.lit(None).cast("string"), F.col("o_orderstatus"))).alias("ethnicity")
    rows = rows.select("quarter", "series", "o_totalprice", "g.*", ethnicity)
    return rows.groupBy("area_type", "area_name", "quarter", "series", "ethnicity").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value")
    )


_SERIES = [("1-URGENT", "urgent", "double"), ("2-HIGH", "high", "double"), ("5-LOW", "low", "double")]


@register(
    "indicator_pivot",
    """WITH l AS (SELECT n_name, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, o_orderpriority AS series, CAST(o_totalprice AS DECIMAL(18,2)) AS v
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
t AS (SELECT n_name AS area_name, quarter, series, v FROM l UNION ALL SELECT 'New Zealand', quarter, series, v FROM l)
SELECT area_name, quarter, """
    + ", ".join(f"CAST(sum(v) FILTER (series = '{s}') AS DOUBLE) AS {o}" for s, o, _ in _SERIES)
    + " FROM t WHERE series IN ("
    + ", ".join(f"'{s}'" for s, _, _ in _SERIES)
    + ") GROUP BY 1, 2",
)
def indicator_pivot(spark, sf):
    """Indicators kept before the pivot: TA and national rows, totals over
    ethnicity, listed series only (G4, A8)."""
    rows = indicator_rows(spark, sf).filter(F.col("area_type").isin("TA", "NZ") & F.col("ethnicity").isNull() & F.col("series").isin([s for s, _, _ in _SERIES]))
    return reshape.series_pivot(rows, ["area_name", "quarter"], _SERIES)

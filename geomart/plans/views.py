"""Shared derived views over the test tables.

Each view exists twice with the same arithmetic: as a Spark DataFrame
builder and as a SQL common-table-expression for the DuckDB oracle. All
coordinates are integer hundredths divided by 100 so both engines produce
the same doubles.

- ``pt``    one point per customer on a 0.01 deg grid inside 166..179 E, 47..34 S
- ``area``  one area per customer with population, weekly rent, income, TA, region
- ``ser``   per (TA = nation, quarter, priority) order totals
- ``taq``   per (TA, quarter) two series: ``rent_value`` (urgent/high) and
            ``income_value`` (the other priorities)
- ``edge``  directed travel edges between nations from lineitem routes
- ``cal``   one service calendar per customer; ``calx`` exceptions from orders
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geomart.operators.series import quarter_label, quarter_start
from geomart.sources.tables import read_table


def _hundredths(col: Column) -> Column:
    return col.cast("double") / 100


def lon_h(key: Column) -> Column:
    return F.lit(16600) + (key * 37) % 1300


def lat_h(key: Column) -> Column:
    # The slowly varying k // 1300 term keeps positions distinct beyond 1300 keys.
    return F.lit(-4700) + (key * 53 + F.floor(key / 1300).cast("bigint")) % 1300


def pt(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer", "c_custkey", "c_nationkey")
    return c.select(
        "c_custkey",
        "c_nationkey",
        _hundredths(lon_h(F.col("c_custkey"))).alias("lon"),
        _hundredths(lat_h(F.col("c_custkey"))).alias("lat"),
    )


PT_SQL = """pt AS (
  SELECT c_custkey, c_nationkey,
         CAST(16600 + (c_custkey * 37) % 1300 AS DOUBLE) / 100 AS lon,
         CAST(-4700 + (c_custkey * 53 + c_custkey // 1300) % 1300 AS DOUBLE) / 100 AS lat
  FROM customer)"""


def area(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = read_table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf, "region", "r_regionkey", "r_name")
    k = F.col("c_custkey")
    return (
        c.join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            k.alias("area_id"),
            F.col("c_name").alias("area_name"),
            F.col("n_name").alias("ta_name"),
            F.col("r_name").alias("region_name"),
            F.col("c_nationkey").alias("ta_key"),
            F.when(F.col("c_mktsegment") != "BUILDING", F.lit(100) + k % 5000)
            .cast("bigint")
            .alias("population"),
            (F.lit(300) + (k * 7) % 600).cast("double").alias("weekly_rent"),
            F.when(F.col("c_acctbal") >= 0, F.lit(40000) + (k * 131) % 90000)
            .cast("double")
            .alias("income"),
            _hundredths(lon_h(k)).alias("lon"),
            _hundredths(lat_h(k)).alias("lat"),
        )
    )


AREA_SQL = """area AS (
  SELECT c.c_custkey AS area_id, c.c_name AS area_name, n.n_name AS ta_name,
         r.r_name AS region_name, c.c_nationkey AS ta_key,
         CAST(CASE WHEN c.c_mktsegment <> 'BUILDING' THEN 100 + c.c_custkey % 5000 END AS BIGINT) AS population,
         CAST(300 + (c.c_custkey * 7) % 600 AS DOUBLE) AS weekly_rent,
         CAST(CASE WHEN c.c_acctbal >= 0 THEN 40000 + (c.c_custkey * 131) % 90000 END AS DOUBLE) AS income,
         CAST(16600 + (c.c_custkey * 37) % 1300 AS DOUBLE) / 100 AS lon,
         CAST(-4700 + (c.c_custkey * 53 + c.c_custkey // 1300) % 1300 AS DOUBLE) / 100 AS lat
  FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""


def orders_by_ta(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus")
    c = read_table(spark, sf, "customer", "c_custkey", "c_nationkey")
    n = read_table(spark, sf, "nation", "n_nationkey", "n_name")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)


def ser(spark: SparkSession, sf: str) -> DataFrame:
    return (
        orders_by_ta(spark, sf)
        .groupBy(
            F.col("n_name").alias("ta_name"),
            quarter_start("o_orderdate").alias("quarter"),
            F.col("o_orderpriority").alias("priority"),
        )
        .agg(
            F.round(F.sum("o_totalprice"), 2).alias("total_price"),
            F.count(F.lit(1)).alias("n_orders"),
        )
    )


SER_SQL = """ser AS (
  SELECT n.n_name AS ta_name,
         CAST(date_trunc('quarter', o.o_orderdate) AS DATE) AS quarter,
         o.o_orderpriority AS priority,
         round(sum(o.o_totalprice), 2) AS total_price,
         count(*) AS n_orders
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY 1, 2, 3)"""

RENT_PRIORITIES = ("1-URGENT", "2-HIGH")


def taq(spark: SparkSession, sf: str) -> DataFrame:
    s = ser(spark, sf)
    is_rent = F.col("priority").isin(*RENT_PRIORITIES)
    return (
        s.groupBy("ta_name", "quarter")
        .agg(
            F.round(F.sum(F.when(is_rent, F.col("total_price"))), 2).alias("rent_value"),
            F.round(F.sum(F.when(~is_rent, F.col("total_price"))), 2).alias("income_value"),
        )
        .withColumn("quarter_label", quarter_label("quarter"))
    )


TAQ_SQL = SER_SQL + """,
taq AS (
  SELECT ta_name, quarter,
         round(sum(CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN total_price END), 2) AS rent_value,
         round(sum(CASE WHEN priority NOT IN ('1-URGENT', '2-HIGH') THEN total_price END), 2) AS income_value,
         concat(CAST(year(quarter) AS VARCHAR), '-Q', CAST(quarter(quarter) AS VARCHAR)) AS quarter_label
  FROM ser GROUP BY 1, 2)"""


def edge(spark: SparkSession, sf: str) -> DataFrame:
    """Directed edges nation -> nation weighted 1..60 minutes from lineitem volume."""
    li = read_table(spark, sf, "lineitem", "l_orderkey", "l_suppkey", "l_quantity")
    o = read_table(spark, sf, "orders", "o_orderkey", "o_custkey")
    c = read_table(spark, sf, "customer", "c_custkey", "c_nationkey")
    s = read_table(spark, sf, "supplier", "s_suppkey", "s_nationkey")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(c, o.o_custkey == c.c_custkey)
        .join(s, li.l_suppkey == s.s_suppkey)
        .filter(F.col("s_nationkey") != F.col("c_nationkey"))
        .groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"))
        .agg((F.lit(1) + F.sum("l_quantity").cast("bigint") % 60).alias("minutes"))
    )


EDGE_SQL = """edge AS (
  SELECT s.s_nationkey AS src, c.c_nationkey AS dst,
         1 + CAST(sum(l.l_quantity) AS BIGINT) % 60 AS minutes
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  WHERE s.s_nationkey <> c.c_nationkey
  GROUP BY 1, 2)"""


def cal(spark: SparkSession, sf: str) -> DataFrame:
    """One weekly service pattern per customer: 7 weekday bits of the key."""
    c = read_table(spark, sf, "customer", "c_custkey")
    k = F.col("c_custkey")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int"))
    days = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    return c.select(
        k.alias("service_id"),
        *[(F.shiftright(k, i) % 2).cast("int").alias(d) for i, d in enumerate(days)],
        start.alias("start_date"),
        F.date_add(start, (k % 30).cast("int")).alias("end_date"),
    )


CAL_SQL = """cal AS (
  SELECT c_custkey AS service_id,
         CAST((c_custkey >> 0) % 2 AS INTEGER) AS monday,
         CAST((c_custkey >> 1) % 2 AS INTEGER) AS tuesday,
         CAST((c_custkey >> 2) % 2 AS INTEGER) AS wednesday,
         CAST((c_custkey >> 3) % 2 AS INTEGER) AS thursday,
         CAST((c_custkey >> 4) % 2 AS INTEGER) AS friday,
         CAST((c_custkey >> 5) % 2 AS INTEGER) AS saturday,
         CAST((c_custkey >> 6) % 2 AS INTEGER) AS sunday,
         CAST(DATE '2024-01-01' + CAST(c_custkey % 60 AS INTEGER) AS DATE) AS start_date,
         CAST(DATE '2024-01-01' + CAST(c_custkey % 60 + c_custkey % 30 AS INTEGER) AS DATE) AS end_date
  FROM customer)"""


def calx(spark: SparkSession, sf: str) -> DataFrame:
    """Calendar exceptions: open orders add a day, the rest remove one."""
    o = read_table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    return o.select(
        F.col("o_custkey").alias("service_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 90).cast("int")).alias("date"),
        F.when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("exception_type"),
    )


CALX_SQL = """calx AS (
  SELECT o_custkey AS service_id,
         CAST(DATE '2024-01-01' + CAST(o_orderkey % 90 AS INTEGER) AS DATE) AS date,
         CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS exception_type
  FROM orders)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"

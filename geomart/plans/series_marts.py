"""Queries over quarterly series: YoY, quarter marts, growth screens, trends."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from geomart.operators import series
from geomart.plans import views as V
from geomart.plans.registry import register
from geomart.sources.tables import read_table

_QLABEL = "concat(CAST(year({c}) AS VARCHAR), '-Q', CAST(quarter({c}) AS VARCHAR))"


def _ta_quarter_value(spark, sf):
    return (
        V.orders_by_ta(spark, sf)
        .groupBy(F.col("n_name").alias("ta_name"), series.quarter_start("o_orderdate").alias("quarter"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    )


_TQV_SQL = """tqv AS (
  SELECT n.n_name AS ta_name, CAST(date_trunc('quarter', o.o_orderdate) AS DATE) AS quarter,
         round(sum(o.o_totalprice), 2) AS value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY 1, 2)"""

YOY_SQL = V.with_ctes(_TQV_SQL) + f"""
SELECT ta_name, quarter, {_QLABEL.format(c='quarter')} AS quarter_label, value,
       CASE WHEN lag(value, 4) OVER w IS NOT NULL AND lag(value, 4) OVER w <> 0
            THEN round((value - lag(value, 4) OVER w) / lag(value, 4) OVER w * 100, 2) END AS yoy_pct
FROM tqv
WINDOW w AS (PARTITION BY ta_name ORDER BY quarter)"""


@register("yoy_lag4", YOY_SQL)
def yoy_lag4(spark, sf):
    """Region-quarter mart with YoY against the row four quarters back."""
    q = _ta_quarter_value(spark, sf).withColumn("quarter_label", series.quarter_label("quarter"))
    return series.with_yoy(q, "value", ["ta_name"], "quarter").select(
        "ta_name", "quarter", "quarter_label", "value", "yoy_pct"
    )


@register(
    "quarter_labels",
    f"""WITH m AS (
  SELECT n.n_name AS ta_name, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS month,
         round(sum(o.o_totalprice), 2) AS monthly_value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY 1, 2)
SELECT ta_name, CAST(date_trunc('quarter', month) AS DATE) AS quarter,
       {_QLABEL.format(c='month')} AS quarter_label,
       count(*) AS months_present, round(sum(monthly_value), 2) AS value
FROM m GROUP BY 1, 2, 3""",
)
def quarter_labels(spark, sf):
    """Month mart rolled to a quarter mart grouped by quarter, not by date (A8, trap 7)."""
    monthly = (
        V.orders_by_ta(spark, sf)
        .groupBy(F.col("n_name").alias("ta_name"), F.trunc(F.to_date("o_orderdate"), "month").alias("month"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("monthly_value"))
    )
    return monthly.groupBy(
        "ta_name",
        series.quarter_start("month").alias("quarter"),
        series.quarter_label("month").alias("quarter_label"),
    ).agg(
        F.count(F.lit(1)).alias("months_present"),
        F.round(F.sum("monthly_value"), 2).alias("value"),
    )


_GROWTH_COLS = """CASE WHEN lag(rent_value, 4) OVER w IS NOT NULL AND lag(rent_value, 4) OVER w <> 0
            THEN round((rent_value - lag(rent_value, 4) OVER w) / lag(rent_value, 4) OVER w * 100, 2) END AS rent_value_yoy_pct,
       CASE WHEN lag(income_value, 4) OVER w IS NOT NULL AND lag(income_value, 4) OVER w <> 0
            THEN round((income_value - lag(income_value, 4) OVER w) / lag(income_value, 4) OVER w * 100, 2) END AS income_value_yoy_pct"""


@register(
    "growth_screen",
    V.with_ctes(V.TAQ_SQL) + f"""
SELECT ta_name, quarter, rent_value_yoy_pct, income_value_yoy_pct FROM (
  SELECT ta_name, quarter, {_GROWTH_COLS}
  FROM taq WINDOW w AS (PARTITION BY ta_name ORDER BY quarter)) g
WHERE rent_value_yoy_pct > 8.0 AND income_value_yoy_pct < 3.0""",
)
def growth_screen(spark, sf):
    """TA-quarters where rent YoY > 8 % while income YoY < 3 %."""
    return series.growth_screen(V.taq(spark, sf), ["ta_name"], "quarter", "rent_value", "income_value").select(
        "ta_name", "quarter", "rent_value_yoy_pct", "income_value_yoy_pct"
    )


@register(
    "cliff_watch",
    V.with_ctes(V.TAQ_SQL) + f""",
g AS (
  SELECT ta_name, quarter, {_GROWTH_COLS}
  FROM taq WINDOW w AS (PARTITION BY ta_name ORDER BY quarter)),
s AS (
  SELECT ta_name, quarter, rent_value_yoy_pct, income_value_yoy_pct,
         rent_value_yoy_pct - income_value_yoy_pct AS growth_gap,
         count(rent_value_yoy_pct - income_value_yoy_pct) OVER t AS gap_n,
         stddev_samp(rent_value_yoy_pct - income_value_yoy_pct) OVER t AS gap_sd
  FROM g WINDOW t AS (PARTITION BY ta_name ORDER BY quarter ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))
SELECT ta_name, quarter, rent_value_yoy_pct, income_value_yoy_pct, growth_gap, round(gap_sd, 6) AS gap_sd
FROM s WHERE gap_n = 4 AND growth_gap > 2.0 * gap_sd""",
)
def cliff_watch(spark, sf):
    """TA-quarters where rent growth outpaced income growth by > 2 trailing sigmas."""
    out = series.cliff_watch(V.taq(spark, sf), ["ta_name"], "quarter", "rent_value", "income_value")
    return out.select(
        "ta_name", "quarter", "rent_value_yoy_pct", "income_value_yoy_pct", "growth_gap",
        F.round("gap_sd", 6).alias("gap_sd"),
    )


@register(
    "trend_series",
    V.with_ctes(V.TAQ_SQL) + """
SELECT t.ta_name, t.quarter, t.quarter_label, t.rent_value, t.income_value
FROM taq t JOIN nation n ON t.ta_name = n.n_name
JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE r.r_name IN ('ASIA', 'EUROPE')
ORDER BY t.ta_name, t.quarter""",
)
def trend_series(spark, sf):
    """Quarterly series for the TAs of chosen regions, ordered by TA, quarter."""
    n = read_table(spark, sf, "nation", "n_name", "n_regionkey")
    r = read_table(spark, sf, "region", "r_regionkey", "r_name").filter(F.col("r_name").isin("ASIA", "EUROPE"))
    tas = n.join(r, n.n_regionkey == r.r_regionkey, "left_semi").select(F.col("n_name").alias("ta_name"))
    return (
        V.taq(spark, sf)
        .join(tas, "ta_name", "left_semi")
        .select("ta_name", "quarter", "quarter_label", "rent_value", "income_value")
        .orderBy("ta_name", "quarter")
    )


@register(
    "rent_to_income_ta",
    V.with_ctes(V.TAQ_SQL) + """,
r AS (
  SELECT ta_name, quarter,
         CASE WHEN income_value > 0 THEN round(rent_value / income_value * 100, 2) END AS rent_to_income_pct
  FROM taq)
SELECT ta_name, quarter, rent_to_income_pct,
       rent_to_income_pct - lag(rent_to_income_pct, 1) OVER (PARTITION BY ta_name ORDER BY quarter) AS change_pct_points
FROM r""",
)
def rent_to_income_ta(spark, sf):
    """Rent-to-income percent per TA and quarter with its change on the previous quarter."""
    w = Window.partitionBy("ta_name").orderBy("quarter")
    r = V.taq(spark, sf).select(
        "ta_name",
        "quarter",
        F.when(F.col("income_value") > 0, F.round(F.col("rent_value") / F.col("income_value") * 100, 2)).alias(
            "rent_to_income_pct"
        ),
    )
    return r.withColumn("change_pct_points", F.col("rent_to_income_pct") - F.lag("rent_to_income_pct", 1).over(w))


@register(
    "topk_abs_change",
    YOY_SQL.replace("SELECT ta_name, quarter, concat", "SELECT * FROM (SELECT ta_name, quarter, concat", 1)
    + """) y WHERE yoy_pct IS NOT NULL
ORDER BY abs(yoy_pct) DESC, ta_name, quarter LIMIT 10""",
)
def topk_abs_change(spark, sf):
    """The ten largest absolute YoY moves (T2); ties broken by key so the set is fixed."""
    return (
        yoy_lag4(spark, sf)
        .filter(F.col("yoy_pct").isNotNull())
        .orderBy(F.abs("yoy_pct").desc(), "ta_name", "quarter")
        .limit(10)
    )

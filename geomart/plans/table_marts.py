"""Snapshot, projection, reshape, join and expectation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from geomart.functions import cells, text
from geomart.operators import joins, quality, reshape, snapshots
from geomart.plans import views as V
from geomart.plans.registry import register
from geomart.sources import files
from geomart.sources.tables import read_table


def sround(expr: str, n: int) -> str:
    """Half-up rounding of the shortest decimal form, as Spark's ``round``."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,12)), {n}) AS DOUBLE)"


def _events(spark, sf, *cols):
    return read_table(spark, sf, "events", *cols)


# ---- snapshots ----------------------------------------------------------------


@register(
    "latest_per_key",
    """SELECT event_type, user_id, event_id, ts, value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def latest_per_key(spark, sf):
    """Latest row per (source, object id) by date, id as tie-break."""
    e = _events(spark, sf, "event_type", "user_id", "event_id", "ts", "value")
    return snapshots.latest_per_key(e, ["event_type", "user_id"], ["ts", "event_id"])


@register(
    "latest_snapshot",
    """SELECT event_id, event_type, user_id, landing_date FROM (
  SELECT event_id, event_type, user_id, CAST(ts AS DATE) AS landing_date,
         max(CAST(ts AS DATE)) OVER (PARTITION BY event_type) AS latest
  FROM events) s WHERE landing_date = latest""",
)
def latest_snapshot(spark, sf):
    """Rows of each source's latest landing date, per source."""
    e = _events(spark, sf, "event_id", "event_type", "user_id", "ts").select(
        "event_id", "event_type", "user_id", F.to_date("ts").alias("landing_date")
    )
    return snapshots.latest_snapshot(e, "event_type", "landing_date")


@register(
    "dedup_by_key",
    """SELECT user_id, CAST(ts AS DATE) AS day, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) = 1""",
)
def dedup_by_key(spark, sf):
    """Deterministic dropDuplicates on (user, day): the least event id (U4)."""
    e = _events(spark, sf, "user_id", "ts", "event_id", "event_type").select(
        "user_id", F.to_date("ts").alias("day"), "event_id", "event_type"
    )
    return snapshots.dedup_by_key(e, ["user_id", "day"], ["event_id"])


@register(
    "latest_asof_join",
    V.with_ctes(V.TAQ_SQL)
    + """,
cur AS (
  SELECT ta_name, quarter, rent_value FROM taq t
  WHERE rent_value IS NOT NULL
    AND quarter = (SELECT max(t2.quarter) FROM taq t2 WHERE t2.ta_name = t.ta_name AND t2.rent_value IS NOT NULL))
SELECT n.n_nationkey, n.n_name, c.quarter, c.rent_value,
       c.quarter = (SELECT max(quarter) FROM taq) AS is_global_latest
FROM nation n LEFT JOIN cur c ON n.n_name = c.ta_name""",
)
def latest_asof_join(spark, sf):
    """Each TA with its latest non-null quarterly value, left join."""
    t = V.taq(spark, sf)
    n = read_table(spark, sf, "nation", "n_nationkey", "n_name")
    out = snapshots.latest_asof_join(n, t, "n_name", "ta_name", "quarter", ["rent_value"], nonnull="rent_value")
    global_latest = t.select(F.max("quarter")).scalar()
    return out.select(
        "n_nationkey", "n_name", "quarter", "rent_value", (F.col("quarter") == global_latest).alias("is_global_latest")
    )


# ---- projections and expressions ---------------------------------------------


@register(
    "typed_projection",
    """SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
       CAST(o_totalprice AS DOUBLE) AS total_price, CAST(o_orderdate AS DATE) AS order_date,
       o_orderpriority AS priority FROM orders""",
)
def typed_projection(spark, sf):
    """Ids cast to string (leading zeros are legal), numbers to double, renamed."""
    o = read_table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    return o.select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_totalprice").cast("double").alias("total_price"),
        F.to_date("o_orderdate").alias("order_date"),
        F.col("o_orderpriority").alias("priority"),
    )


@register(
    "predicate_filters",
    """SELECT p_partkey, p_brand, p_type, p_size FROM part
WHERE p_brand <> 'Brand#1' AND p_type IN ('ECONOMY', 'SMALL', 'PROMO')
  AND p_size BETWEEN 5 AND 30 AND p_name IS NOT NULL""",
)
def predicate_filters(spark, sf):
    """Equality, inequality (drops NULL too), IN, BETWEEN, IS NOT NULL."""
    p = read_table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return p.filter(
        (F.col("p_brand") != "Brand#1")
        & F.col("p_type").isin("ECONOMY", "SMALL", "PROMO")
        & F.col("p_size").between(5, 30)
        & F.col("p_name").isNotNull()
    ).select("p_partkey", "p_brand", "p_type", "p_size")


@register("header_trim", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def header_trim(spark, sf):
    """Every column name trimmed (P6); input has padded headers."""
    p = read_table(spark, sf, "part")
    padded = p.toDF(*[f"  {c} " for c in p.columns])
    return files.trim_headers(padded)


@register(
    "text_cleanup",
    r"""SELECT p_partkey,
       regexp_replace(concat(p_name, '.'), '\.$', '') AS clean_name,
       trim(concat('  ', p_brand, ' ')) AS clean_brand,
       p_name ILIKE '%RED%' AS has_red,
       p_type LIKE 'S%' AS starts_s,
       concat(p_brand, ' / ', p_type) AS label
FROM part""",
)
def text_cleanup(spark, sf):
    """Trailing-dot removal, trim, concat, ILIKE, LIKE (string family)."""
    p = read_table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type")
    return p.select(
        "p_partkey",
        F.regexp_replace(F.concat("p_name", F.lit(".")), r"\.$", "").alias("clean_name"),
        F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("clean_brand"),
        F.col("p_name").ilike("%RED%").alias("has_red"),
        F.col("p_type").like("S%").alias("starts_s"),
        F.concat("p_brand", F.lit(" / "), "p_type").alias("label"),
    )


@register(
    "sentinel_nulls",
    """SELECT p_partkey, CASE WHEN p_size = 50 THEN NULL ELSE p_size END AS size_clean,
       CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_type END AS type_clean,
       CASE WHEN p_retailprice - 1000 < 0 THEN NULL ELSE p_retailprice - 1000 END AS excess_price
FROM part""",
)
def sentinel_nulls(spark, sf):
    """Sentinel values to NULL (size 50, type 'PROMO' as an 'All' marker) and
    negative -> NULL on a derived amount (P8)."""
    p = read_table(spark, sf, "part", "p_partkey", "p_size", "p_type", "p_retailprice")
    return p.select(
        "p_partkey",
        reshape.sentinel_to_null("p_size", [50]).alias("size_clean"),
        reshape.sentinel_to_null("p_type", ["PROMO"]).alias("type_clean"),
        reshape.sentinel_to_null(F.col("p_retailprice") - 1000, negative_is_null=True).alias("excess_price"),
    )


_ROUTE_CODE_SQL = "CASE WHEN p_size % 10 = 0 THEN NULL ELSE CAST((p_partkey * 13) % 1800 AS VARCHAR) END"


@register(
    "code_label_case",
    f"SELECT p_partkey, {_ROUTE_CODE_SQL} AS route_type, {text.route_type_label_sql(_ROUTE_CODE_SQL)} AS route_type_label FROM part",
)
def code_label_case(spark, sf):
    """Route-type code -> label with ranges; NULL/unmatched -> 'unknown' (P9)."""
    p = read_table(spark, sf, "part", "p_partkey", "p_size")
    code = F.when(F.col("p_size") % 10 != 0, ((F.col("p_partkey") * 13) % 1800).cast("string"))
    return p.select("p_partkey", code.alias("route_type")).withColumn(
        "route_type_label", text.route_type_label("route_type")
    )


_RAW_NAMES = [s for s, _ in text.TA_NAME_FIXES] + ["Wellington City"]
_RAW_NAMES_SQL = "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in _RAW_NAMES) + "]"


@register(
    "name_canonicalise",
    f"""SELECT c_custkey, raw_name, {text.canonical_ta_name_sql('raw_name')} AS ta_name FROM (
  SELECT c_custkey, list_element({_RAW_NAMES_SQL}, CAST(c_custkey % {len(_RAW_NAMES)} + 1 AS INTEGER)) AS raw_name
  FROM customer) c""",
)
def name_canonicalise(spark, sf):
    """Source TA spellings -> official names, else passthrough (P10)."""
    c = read_table(spark, sf, "customer", "c_custkey")
    raw = F.element_at(F.array(*[F.lit(n) for n in _RAW_NAMES]), (F.col("c_custkey") % len(_RAW_NAMES) + 1).cast("int"))
    return c.select("c_custkey", raw.alias("raw_name")).withColumn("ta_name", text.canonical_ta_name("raw_name"))


@register(
    "guarded_ratio",
    f"""SELECT c.c_custkey, coalesce(o.n, 0) AS n_orders, coalesce(o.nf, 0) AS n_fulfilled,
       CASE WHEN coalesce(o.n, 0) > 0 THEN {sround('o.nf / o.n * 100', 2)} END AS fulfilled_pct
FROM customer c LEFT JOIN (
  SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS nf FROM orders GROUP BY 1) o
ON c.c_custkey = o.o_custkey""",
)
def guarded_ratio(spark, sf):
    """Share of fulfilled orders per customer, NULL without orders."""
    c = read_table(spark, sf, "customer", "c_custkey")
    o = (
        read_table(spark, sf, "orders", "o_custkey", "o_orderstatus")
        .groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("nf"))
    )
    j = c.join(o, c.c_custkey == o.o_custkey, "left")
    n, nf = F.coalesce("n", F.lit(0)), F.coalesce("nf", F.lit(0))
    return j.select(
        "c_custkey",
        n.alias("n_orders"),
        nf.alias("n_fulfilled"),
        F.round(reshape.guarded_ratio(nf, n, 100.0), 2).alias("fulfilled_pct"),
    )


# ---- reshape --------------------------------------------------------------------

_LI_METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register(
    "unpivot_metrics",
    """SELECT l_orderkey, l_linenumber, field, value
FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) w
UNPIVOT INCLUDE NULLS (value FOR field IN (l_quantity, l_extendedprice, l_discount, l_tax))""",
)
def unpivot_metrics(spark, sf):
    """Wide numeric columns -> (field, value) rows."""
    li = read_table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", *_LI_METRICS)
    return reshape.unpivot_columns(li, ["l_orderkey", "l_linenumber"], _LI_METRICS)


# Fixed manifest of the test form: output name, dataset (return flag), field.
_MANIFEST = [
    ("qty_returned", "R", "l_quantity"),
    ("qty_accepted", "A", "l_quantity"),
    ("qty_open", "N", "l_quantity"),
    ("price_returned", "R", "l_extendedprice"),
    ("discount_open", "N", "l_discount"),
]


@register(
    "manifest_pivot",
    "SELECT l_orderkey, "
    + ", ".join(f"max(CASE WHEN l_returnflag = '{d}' THEN {f} END) AS {o}" for o, d, f in _MANIFEST)
    + " FROM lineitem GROUP BY l_orderkey",
)
def manifest_pivot(spark, sf):
    """Long (dataset, field, value) -> manifest columns with max(when ...)."""
    li = read_table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", *_LI_METRICS)
    long = reshape.unpivot_columns(
        li.withColumnRenamed("l_returnflag", "dataset"), ["l_orderkey", "l_linenumber", "dataset"], _LI_METRICS
    )
    return reshape.manifest_pivot(long, ["l_orderkey"], _MANIFEST)


_PRIORITIES = [
    ("1-URGENT", "urgent", "double"),
    ("2-HIGH", "high", "double"),
    ("3-MEDIUM", "medium", "double"),
    ("4-NOT SPECIFIED", "not_specified", "double"),
    ("5-LOW", "low", "double"),
]


@register(
    "series_pivot",
    V.with_ctes(V.SER_SQL)
    + "SELECT ta_name, quarter, "
    + ", ".join(f"min(CASE WHEN priority = '{s}' THEN total_price END) AS {o}" for s, o, _ in _PRIORITIES)
    + " FROM ser GROUP BY ta_name, quarter",
)
def series_pivot(spark, sf):
    """Long series -> one column per listed series, first non-null made
    deterministic (G4, A8)."""
    return reshape.series_pivot(
        V.ser(spark, sf), ["ta_name", "quarter"], _PRIORITIES, series_col="priority", value_col="total_price"
    )


# Fixed dictionary of the test survey: field -> measure.
_DICTIONARY = [("VAR_1", "quantity"), ("VAR_2", "price"), ("VAR_3", "discount_excess"), ("VAR_4", "tax_excess")]


@register(
    "survey_reshape",
    """WITH latest AS (
  SELECT * FROM lineitem QUALIFY row_number() OVER (
    PARTITION BY l_orderkey
    ORDER BY l_linenumber DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC) = 1)
SELECT l_orderkey,
       CASE WHEN l_quantity < 0 THEN NULL ELSE l_quantity END AS quantity,
       CASE WHEN l_extendedprice < 0 THEN NULL ELSE l_extendedprice END AS price,
       CASE WHEN l_discount - 0.05 < 0 THEN NULL ELSE l_discount - 0.05 END AS discount_excess,
       CASE WHEN l_tax - 0.04 < 0 THEN NULL ELSE l_tax - 0.04 END AS tax_excess,
       CASE WHEN l_quantity > 0 THEN l_extendedprice / l_quantity END AS price_per_unit
FROM latest""",
)
def survey_reshape(spark, sf):
    """Latest landing -> unpivot VAR_* -> negative to NULL -> dictionary join
    -> manifest pivot -> guarded ratio (A4)."""
    li = read_table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", *_LI_METRICS)
    # Landing number first; the remaining columns make the pick total.
    order = ["l_linenumber", *_LI_METRICS]
    wide = snapshots.latest_per_key(li, ["l_orderkey"], order).select(
        "l_orderkey",
        F.col("l_quantity").alias("VAR_1"),
        F.col("l_extendedprice").alias("VAR_2"),
        (F.col("l_discount") - 0.05).alias("VAR_3"),
        (F.col("l_tax") - 0.04).alias("VAR_4"),
    )
    long = reshape.unpivot_prefixed(wide, ["l_orderkey"], "VAR_").withColumn(
        "value", reshape.sentinel_to_null("value", negative_is_null=True)
    )
    dictionary = spark.createDataFrame(_DICTIONARY, "field string, measure string")
    long = long.join(F.broadcast(dictionary), "field", "left").withColumn("dataset", F.lit("survey"))
    manifest = [(m, "survey", m) for _, m in _DICTIONARY]
    wide_out = reshape.manifest_pivot(long, ["l_orderkey"], manifest, field_col="measure")
    return wide_out.withColumn("price_per_unit", reshape.guarded_ratio("price", "quantity"))


_ALIAS_SQL = """concat(CASE WHEN p_size % 7 = 0 THEN '' ELSE concat('Year: ', CAST(2000 + p_partkey % 24 AS VARCHAR), ', ') END,
         'Measure: ', p_type, ', Var1: ', p_name,
         CASE WHEN p_size % 2 = 0 THEN concat(', Var2: ', p_brand) ELSE '' END,
         ' (', p_brand, ')')"""


@register(
    "alias_regex_parse",
    f"""SELECT p_partkey,
       TRY_CAST(NULLIF(regexp_extract(alias, '{text.ALIAS_PATTERNS['census_year']}', 1), '') AS INTEGER) AS census_year,
       regexp_extract(alias, '{text.ALIAS_PATTERNS['measure']}', 1) AS measure,
       regexp_extract(alias, '{text.ALIAS_PATTERNS['variable_l1']}', 1) AS variable_l1,
       regexp_extract(alias, '{text.ALIAS_PATTERNS['variable_l2']}', 1) AS variable_l2,
       regexp_extract(alias, '{text.ALIAS_PATTERNS['category']}', 1) AS category
FROM (SELECT p_partkey, {_ALIAS_SQL} AS alias FROM part) a""",
)
def alias_regex_parse(spark, sf):
    """Year, measure, var1, var2 and trailing category out of field aliases (A5)."""
    p = read_table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    alias = F.concat(
        F.when(F.col("p_size") % 7 == 0, F.lit("")).otherwise(
            F.concat(F.lit("Year: "), (F.lit(2000) + F.col("p_partkey") % 24).cast("string"), F.lit(", "))
        ),
        F.lit("Measure: "), "p_type", F.lit(", Var1: "), "p_name",
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(", Var2: "), "p_brand")).otherwise(F.lit("")),
        F.lit(" ("), "p_brand", F.lit(")"),
    )
    parsed = text.parse_alias(F.col("alias"))
    return p.select("p_partkey", alias.alias("alias")).select(
        "p_partkey", *[parsed[k].alias(k) for k in ["census_year", "measure", "variable_l1", "variable_l2", "category"]]
    )


_AMENITY_VALUES = [
    "supermarket", "hospital", "school", "college", "university", "kindergarten", "childcare",
    "pharmacy", "clinic", "doctors", "library", "cafe", "bank",
]
_AMENITY_VALUES_SQL = "[" + ", ".join(f"'{v}'" for v in _AMENITY_VALUES) + "]"
_FEAT_SQL = f"""feat AS (
  SELECT p_partkey, p_name,
         CASE WHEN p_size % 4 = 0 THEN 'supermarket' END AS shop,
         list_element({_AMENITY_VALUES_SQL}, CAST(p_partkey % {len(_AMENITY_VALUES)} + 1 AS INTEGER)) AS amenity,
         CASE WHEN p_size % 5 = 0 THEN 'park' END AS leisure,
         CASE WHEN p_partkey % 3 = 0 THEN concat('way/', CAST(p_partkey AS VARCHAR)) ELSE CAST(p_partkey AS VARCHAR) END AS fid,
         CAST(16600 + (p_partkey * 37) % 1300 AS DOUBLE) / 100 AS lon,
         CAST(-4700 + (p_partkey * 53 + p_partkey // 1300) % 1300 AS DOUBLE) / 100 AS lat
  FROM part)"""


def amenity_features(spark, sf):
    p = read_table(spark, sf, "part", "p_partkey", "p_name", "p_size")
    k = F.col("p_partkey")
    return p.select(
        "p_partkey",
        "p_name",
        F.when(F.col("p_size") % 4 == 0, "supermarket").alias("shop"),
        F.element_at(F.array(*[F.lit(v) for v in _AMENITY_VALUES]), (k % len(_AMENITY_VALUES) + 1).cast("int")).alias("amenity"),
        F.when(F.col("p_size") % 5 == 0, "park").alias("leisure"),
        F.when(k % 3 == 0, F.concat(F.lit("way/"), k.cast("string"))).otherwise(k.cast("string")).alias("fid"),
        (V.lon_h(k).cast("double") / 100).alias("lon"),
        (V.lat_h(k).cast("double") / 100).alias("lat"),
    )


def amenities(spark, sf):
    """Amenity mart rows: categorised, id-normalised, cell-keyed."""
    f = amenity_features(spark, sf)
    cat = text.amenity_category({"shop": F.col("shop"), "amenity": F.col("amenity"), "leisure": F.col("leisure")})
    return (
        f.select(
            text.normalise_feature_id(F.col("fid")).alias("osm_id"),
            cat.alias("amenity_type"),
            F.col("p_name").alias("name"),
            cells.hex_cell("lon", "lat").alias("cell"),
        )
        .filter(F.col("amenity_type").isNotNull())
    )


_CAT_SQL = text.amenity_category_sql({"shop": "shop", "amenity": "amenity", "leisure": "leisure"})
AMENITY_SQL = _FEAT_SQL + f""",
amen AS (
  SELECT CASE WHEN fid LIKE '%/%' THEN fid ELSE concat('node/', fid) END AS osm_id,
         {_CAT_SQL} AS amenity_type, p_name AS name, {cells.hex_cell_sql('lon', 'lat')} AS cell
  FROM feat WHERE {_CAT_SQL} IS NOT NULL)"""


@register("categorise_first_match", V.with_ctes(AMENITY_SQL) + "SELECT osm_id, amenity_type, name, cell FROM amen")
def categorise_first_match(spark, sf):
    """Ordered tag map, first match wins, unmatched dropped; ids normalised;
    point features keep their position as centroid (P14, P15, X12)."""
    return amenities(spark, sf)


# ---- expectations ------------------------------------------------------------------

_RULES_KEEP = {"nonneg_balance": "c_acctbal >= 0"}
_RULES_DROP = {
    "has_name": "c_name IS NOT NULL",
    "known_segment": "c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')",
}


@register(
    "expect_report",
    """SELECT 'nonneg_balance' AS rule, 'warn' AS action, count(*) FILTER (WHERE NOT coalesce(c_acctbal >= 0, false)) AS failed_rows, count(*) AS total_rows FROM customer
UNION ALL SELECT 'has_name', 'drop', count(*) FILTER (WHERE NOT coalesce(c_name IS NOT NULL, false)), count(*) FROM customer
UNION ALL SELECT 'known_segment', 'drop', count(*) FILTER (WHERE NOT coalesce(c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'), false)), count(*) FROM customer""",
)
def expect_report(spark, sf):
    """Violation counts per rule in one pass; rows are kept (Q1)."""
    c = read_table(spark, sf, "customer", "c_name", "c_acctbal", "c_mktsegment")
    return quality.expectation_report(c, keep=_RULES_KEEP, drop=_RULES_DROP)


@register(
    "expect_or_drop",
    """SELECT c_custkey, c_acctbal FROM customer
WHERE coalesce(c_acctbal >= 0, false) AND coalesce(c_name IS NOT NULL, false)""",
)
def expect_or_drop(spark, sf):
    """Rows failing a drop rule (NULL fails) are removed (Q2)."""
    c = read_table(spark, sf, "customer", "c_custkey", "c_name", "c_acctbal")
    out = quality.apply_expectations(c, drop={"nonneg_balance": "c_acctbal >= 0", "has_name": "c_name IS NOT NULL"})
    return out.select("c_custkey", "c_acctbal")


# ---- joins ----------------------------------------------------------------------------


@register(
    "optional_enrichment",
    """SELECT n.n_nationkey, n.n_name, c.n_customers, CAST(NULL AS BIGINT) AS crime_total
FROM nation n LEFT JOIN (SELECT c_nationkey, count(*) AS n_customers FROM customer GROUP BY 1) c
ON n.n_nationkey = c.c_nationkey""",
)
def optional_enrichment(spark, sf):
    """Present upstream joined on a differently named key (J3); absent
    upstream replaced by a typed NULL column instead of failing (S8)."""
    n = read_table(spark, sf, "nation", "n_nationkey", "n_name")
    counts = (
        read_table(spark, sf, "customer", "c_nationkey").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_customers"))
    )
    out = joins.left_join_drop_key(n, counts, "n_nationkey", "c_nationkey")
    missing = files.optional_parquet(spark, f"{sf.rstrip('/')}/crime_at_area_year.parquet")
    if missing is None:
        return out.withColumn("crime_total", F.lit(None).cast("bigint"))
    crime = missing.groupBy("nation_key").agg(F.sum("total").cast("bigint").alias("crime_total"))
    return joins.left_join_drop_key(out, crime, "n_nationkey", "nation_key")


@register(
    "left_join_multikey",
    """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, p.l_partkey AS prev_partkey
FROM lineitem l LEFT JOIN lineitem p ON l.l_orderkey = p.l_orderkey AND l.l_linenumber = p.l_linenumber + 1""",
)
def left_join_multikey(spark, sf):
    """Left equi-join on two keys (J1): each line with its previous line's part."""
    li = read_table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    prev = li.select(
        F.col("l_orderkey"), (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("prev_partkey")
    )
    return li.join(prev, ["l_orderkey", "l_linenumber"], "left")


@register(
    "broadcast_registry_join",
    """SELECT s.s_suppkey, s.s_name, g.n_name, g.r_name FROM supplier s LEFT JOIN (
  SELECT n.n_nationkey, n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey) g
ON s.s_nationkey = g.n_nationkey""",
)
def broadcast_registry_join(spark, sf):
    """Left join to a small registry; adaptive execution broadcasts it by its size."""
    s = read_table(spark, sf, "supplier", "s_suppkey", "s_name", "s_nationkey")
    n = read_table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf, "region", "r_regionkey", "r_name")
    registry = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    out = s.join(registry, s.s_nationkey == registry.n_nationkey, "left")
    return out.select("s_suppkey", "s_name", "n_name", "r_name")


@register(
    "semi_exists",
    V.with_ctes(V.EDGE_SQL)
    + """SELECT c.c_custkey, c.c_name FROM customer c
WHERE c.c_nationkey IN (SELECT dst FROM edge WHERE minutes <= 30)
  AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')
  AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')""",
)
def semi_exists(spark, sf):
    """Areas reachable within 30 minutes that have both facility kinds."""
    c = read_table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey")
    o = read_table(spark, sf, "orders", "o_custkey", "o_orderpriority", "o_orderstatus")
    reach = V.edge(spark, sf).filter(F.col("minutes") <= 30).select(F.col("dst").alias("c_nationkey"))
    urgent = o.filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    done = o.filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    return (
        c.join(reach, "c_nationkey", "left_semi")
        .join(urgent, "c_custkey", "left_semi")
        .join(done, "c_custkey", "left_semi")
        .select("c_custkey", "c_name")
    )


@register(
    "distinct_facility_count",
    "SELECT p_brand, p_type, count(DISTINCT p_name) AS facilities FROM part GROUP BY 1, 2",
)
def distinct_facility_count(spark, sf):
    """Distinct names per (area, category): over-tagged sources count once."""
    p = read_table(spark, sf, "part", "p_brand", "p_type", "p_name")
    return p.groupBy("p_brand", "p_type").agg(F.countDistinct("p_name").alias("facilities"))


@register(
    "profile_counts",
    """SELECT event_type AS source, count(*) AS n_rows, count(props) AS n_with_props,
       count(DISTINCT user_id) AS n_users, min(ts) AS first_ts, max(ts) AS last_ts,
       min(value) AS min_value, max(value) AS max_value
FROM events GROUP BY event_type""",
)
def profile_counts(spark, sf):
    """Rows per source, coverage counts, first/last landing."""
    e = _events(spark, sf, "event_type", "props", "user_id", "ts", "value")
    return e.groupBy(F.col("event_type").alias("source")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("props").alias("n_with_props"),
        F.countDistinct("user_id").alias("n_users"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from geomart.operators import bridge, calendar, names, quality, reshape, score, series, snapshots


def test_yoy_literal(spark):
    rows = [("NZ", dt.date(2000 + i // 4, 1 + 3 * (i % 4), 1), 1250.0 + 12 * i) for i in range(8)]
    df = spark.createDataFrame(rows, "region string, quarter date, hpi double")
    out = series.with_yoy(df, "hpi", ["region"], "quarter").orderBy("quarter").collect()
    assert [r.yoy_pct for r in out[:4]] == [None] * 4
    assert out[4].yoy_pct == 3.84  # 48 / 1250


def test_allocation_split(spark):
    totals = spark.createDataFrame([("AU1", 2023, 1000.0)], "unit string, year int, total double")
    br = spark.createDataFrame([("AU1", "S1", 0.3), ("AU1", "S2", 0.7), ("AU9", "S3", 1.0)], "unit string, area string, share double")
    out = {r.area: r.allocated for r in bridge.allocate(totals, br, "unit", "area", "year", "total", "share").collect()}
    assert out == {"S1": 300, "S2": 700}


def test_shares_sum_to_one(spark):
    pairs = spark.createDataFrame([(u, a) for u in range(5) for a in range(u + 1)], "u int, a int")
    s = bridge.overlap_shares(pairs, "u", "a")
    for r in s.groupBy("u").agg(F.sum("unit_share_raw").alias("t")).collect():
        assert abs(r.t - 1) < 1e-12


def test_latest_per_key_null_keys_and_ties(spark):
    rows = [("a", 1, 10), ("a", 2, 11), ("a", 2, 12), (None, 1, 13), (None, 5, 14)]
    df = spark.createDataFrame(rows, "k string, d int, id int")
    out = sorted(r.id for r in snapshots.latest_per_key(df, ["k"], ["d", "id"]).collect())
    assert out == [12, 13, 14]


def test_latest_snapshot_is_per_source(spark):
    rows = [("x", 1, "old"), ("x", 2, "new"), ("y", 1, "only")]
    df = spark.createDataFrame(rows, "src string, d int, v string")
    assert sorted(r.v for r in snapshots.latest_snapshot(df, "src", "d").collect()) == ["new", "only"]


def test_exact_ntile_matches_builtin(spark):
    rows = [(i, float((i * 7919) % 103)) for i in range(1, 238)]
    df = spark.createDataFrame(rows, "id int, income double")
    mine = {r.id: r.d for r in score.exact_ntile(df, 10, ["income", "id"], out="d", partitions=7).collect()}
    ref = {r.id: r.d for r in df.select("id", F.ntile(10).over(Window.orderBy("income", "id")).alias("d")).collect()}
    assert mine == ref


def test_affordability_bands(spark):
    df = spark.createDataFrame([(0.2,), (0.25,), (0.35,), (0.36,), (None,)], "r double")
    got = [r.b for r in df.select(score.affordability_band(F.col("r")).alias("b")).collect()]
    assert got == ["affordable", "moderate stress", "moderate stress", "housing stressed", "unknown"]


def test_hazard_levels_worst_wins(spark):
    cols = "k int, in_flood_plain boolean, in_flood_prone_area boolean, in_flood_sensitive_area boolean, " \
           "in_regional_flood_zone boolean, in_coastal_inundation_1_aep boolean, in_coastal_inundation_100yr boolean, hazard_sources array<string>"
    rows = [(1, False, True, False, False, False, False, ["b", "a"]), (1, False, False, False, False, True, False, ["a"]),
            (2, False, False, False, False, False, False, None)]
    out = {r.k: r for r in score.hazard_levels(spark.createDataFrame(rows, cols), "k").collect()}
    assert (out[1].flood_risk, out[1].coastal_risk, out[1].overall_risk) == ("medium", "high", "high")
    assert out[1].hazard_sources == ["a", "b"] and out[1].cells_examined == 2
    assert out[2].overall_risk == "low"


def test_service_days_removal_wins(spark):
    cal = spark.createDataFrame(
        [(1, 1, 1, 1, 1, 1, 0, 0, dt.date(2024, 1, 1), dt.date(2024, 1, 7))],
        "service_id int, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date date, end_date date",
    )
    exc = spark.createDataFrame(
        [(1, dt.date(2024, 1, 6), 1), (1, dt.date(2024, 1, 2), 2), (1, dt.date(2024, 1, 6), 2), (1, dt.date(2024, 1, 7), 1)],
        "service_id int, date date, exception_type int",
    )
    days = sorted(r.service_date.day for r in calendar.expand_service_days(cal, exc).collect())
    assert days == [1, 3, 4, 5, 7]


def test_expectations(spark):
    df = spark.createDataFrame([(1, 5.0), (2, -1.0), (3, None)], "id int, v double")
    rep = {r.rule: r.failed_rows for r in quality.expectation_report(df, keep={"pos": "v >= 0"}).collect()}
    assert rep == {"pos": 2}
    kept = quality.apply_expectations(df, drop={"pos": "v >= 0"})
    assert [r.id for r in kept.collect()] == [1]


def test_sentinels_and_guarded_ratio(spark):
    df = spark.createDataFrame([(-999, 0), (5, 2), (-3, 4)], "x int, d int")
    out = df.select(
        reshape.sentinel_to_null("x", [-999]).alias("a"),
        reshape.sentinel_to_null("x", negative_is_null=True).alias("b"),
        reshape.guarded_ratio("x", "d").alias("r"),
    ).collect()
    assert [r.a for r in out] == [None, 5, -3]
    assert [r.b for r in out] == [None, 5, None]
    assert [r.r for r in out] == [None, 2.5, -0.75]


def test_resolve_exact_short_circuits(spark):
    t = spark.createDataFrame([(1, "Petone", 10), (2, "Petone North", 30), (3, "Petone Central", None), (4, "Hutt", 5)],
                              "id int, name string, population int")
    q = spark.createDataFrame([("Petone",), ("petone",)], "query string")
    out = sorted((r.query, r.id, r.match) for r in names.resolve_names(q, t).collect())
    assert out == [("Petone", 1, "exact"), ("petone", 1, "contains"), ("petone", 2, "contains"), ("petone", 3, "contains")]


def test_top_k_per_group_salted(spark):
    df = spark.createDataFrame([("g", i, float(i % 13)) for i in range(500)], "g string, id int, v double")
    out = names.top_k_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 5, salt_on="id")
    assert [(r.id, r.rank) for r in out.orderBy("rank").collect()] == [(12, 1), (25, 2), (38, 3), (51, 4), (64, 5)]


def test_one_to_one_violations(spark):
    df = spark.createDataFrame([("Te Aro", "A1"), ("Te Aro", "A2"), ("Kelburn", "A3")], "name string, code string")
    v = {(r.side, r.value) for r in bridge.one_to_one_violations(df, "name", "code").collect()}
    assert v == {("name", "Te Aro")}


def test_hazard_cells_modes(spark):
    from geomart.functions import rings
    from geomart.operators import spatial

    text = '{"type":"Polygon","coordinates":[[[174.70,-41.30],[174.76,-41.30],[174.76,-41.26],[174.70,-41.26],[174.70,-41.30]]]}'
    df = rings.with_polygon_from_geojson(spark.createDataFrame([(1, "plain", text)], "id int, layer string, t string"), "t")
    cen = spatial.hazard_polygon_cells(df, "ring", "id", ["layer"], "centroid")
    fill = spatial.hazard_polygon_cells(df, "ring", "id", ["layer"], "polyfill")
    assert cen.count() == 1
    assert fill.count() > 20  # ~5 km x 4.4 km at ~0.7 km2 per cell
    assert cen.join(fill, ["layer", "cell"]).count() == 1


def test_exact_ntile_with_a_hot_value(spark):
    # A third of the rows share one income: the unique tie-break key spreads
    # them over partitions and the buckets still equal NTILE's.
    rows = [(i, 50_000.0 if i % 3 == 0 else float(i)) for i in range(1, 301)]
    df = spark.createDataFrame(rows, "id int, income double")
    mine = {r.id: r.d for r in score.exact_ntile(df, 10, ["income", "id"], out="d", partitions=6).collect()}
    ref = {r.id: r.d for r in df.select("id", F.ntile(10).over(Window.orderBy("income", "id")).alias("d")).collect()}
    assert mine == ref


def test_exact_ntile_with_payload_over_many_rows(spark, tmp_path):
    df = spark.range(150_000).select((F.col("id") * 7919 % 150_000).alias("id"), (F.hash("id") % 1000).alias("income"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    path = str(tmp_path / "ntile")
    score.exact_ntile(df, 10, ["income", "id"], out="d", partitions=7).write.parquet(path)
    ref = df.select("id", F.ntile(10).over(Window.orderBy("income", "id")).alias("want"))
    got = spark.read.parquet(path)
    assert got.columns == ["id", "income", "payload", "d"] and got.count() == 150_000
    assert got.join(ref, "id").filter("d <> want").count() == 0


def test_expectations_observed_in_same_pass(spark):
    from pyspark.sql import Observation

    df = spark.createDataFrame([(1, 5.0), (2, -1.0), (3, None)], "id int, v double")
    obs = Observation("dq")
    kept = quality.apply_expectations(df, keep={"has_v": "v IS NOT NULL"}, drop={"pos": "v >= 0"}, observation=obs)
    assert [r.id for r in kept.collect()] == [1]
    assert obs.get == {"failed_has_v": 1, "failed_pos": 2, "rows_in": 3}


def test_service_days_per_feed(spark):
    cal = spark.createDataFrame(
        [(f, 1, 1, 1, 1, 1, 1, 1, 1, dt.date(2024, 1, 1), dt.date(2024, 1, 3)) for f in ("a", "b")],
        "feed string, service_id int, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date date, end_date date",
    )
    exc = spark.createDataFrame([("a", 1, dt.date(2024, 1, 2), 2)], "feed string, service_id int, date date, exception_type int")
    rows = calendar.expand_service_days(cal, exc, key=["feed", "service_id"]).collect()
    assert sorted((r.feed, r.service_date.day) for r in rows) == [("a", 1), ("a", 3), ("b", 1), ("b", 2), ("b", 3)]

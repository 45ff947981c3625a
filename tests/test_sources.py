import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomart.operators import reach
from geomart.session import scratch_path
from geomart.sources import geojson

_F = geojson.feature_schema(T.StructType([T.StructField("x", T.LongType())]))


def test_feature_collection_shapes(spark):
    docs = [
        (1, '[{"x":1}]'),
        (2, '{"type":"Feature","properties":{"x":1}}'),
        (3, "{}"),
        (4, '{"type":"FeatureCollection","features":[{"type":"Feature"},{"type":"Feature"}]}'),
    ]
    df = spark.createDataFrame(docs, "d int, body string")
    counts = {r.d: r["count"] for r in geojson.explode_features(df, "body", _F, keep=["d"]).groupBy("d").count().collect()}
    assert counts == {1: 1, 2: 1, 4: 2}


def test_matrix_against_brute_force(spark):
    edges = [(0, 1, 30), (1, 2, 30), (2, 3, 40), (0, 3, 95), (3, 0, 7), (1, 0, 2)]
    df = spark.createDataFrame(edges, "src int, dst int, minutes bigint")
    got = {(r.origin, r.destination): r.travel_minutes for r in reach.travel_time_matrix(df, 90).collect()}
    nodes = {0, 1, 2, 3}
    inf = float("inf")
    d = {(a, b): (0 if a == b else inf) for a in nodes for b in nodes}
    for s, t, w in edges:
        if w <= 90:
            d[(s, t)] = min(d[(s, t)], w)
    for k in nodes:
        for a in nodes:
            for b in nodes:
                d[(a, b)] = min(d[(a, b)], d[(a, k)] + d[(k, b)])
    want = {k: int(round(v / 5) * 5) for k, v in d.items() if v <= 90}
    assert got == want
    assert all(v % 5 == 0 and v <= 90 for v in got.values())
    assert all(got[(n, n)] == 0 for n in nodes)


def test_stream_rerun_adds_nothing(spark, sf_small):
    from geomart.plans import landing_marts

    df, base = landing_marts._stream_landing(spark, sf_small, "csv")
    n = df.count()
    assert n == spark.read.parquet(f"{sf_small}/events.parquet").count()
    assert df.select("event_id").distinct().count() == n


def test_scratch_is_under_checkpoint_dir(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(base.rstrip("/"))
    assert os.path.basename(scratch_path(spark, "x")) != os.path.basename(scratch_path(spark, "x"))


def test_optional_enrichment_absent_is_typed_null(spark, sf_small):
    from geomart.plans import table_marts

    df = table_marts.optional_enrichment(spark, sf_small)
    assert dict(df.dtypes)["crime_total"] == "bigint"
    assert df.filter(F.col("crime_total").isNotNull()).count() == 0


def test_seed_sink_and_floor(spark):
    import pytest

    from geomart.sources import landing, tables

    path = scratch_path(spark, "seed")
    schema = "suburb_id string, tags array<string>"
    df = tables.write_seed(spark, [{"suburb_id": "1", "tags": ["a"]}, {"suburb_id": "2", "tags": []}], schema, path)
    assert df.count() == 2
    tables.write_seed(spark, [{"suburb_id": "3", "tags": None}], schema, path)
    assert [r.suburb_id for r in spark.read.parquet(path).collect()] == ["3"]
    land = scratch_path(spark, "floor")
    spark.range(10).write.option("header", "true").csv(land)
    with pytest.raises(landing.LandingTooSmall):
        landing.check_landing_floor(spark, land, min_bytes=10_000_000)
    _, rows = landing.check_landing_floor(spark, land, min_bytes=1, min_rows=10)
    assert rows == 10


def test_stream_schema_evolution(spark):
    from geomart.streaming import landing as stream

    base = scratch_path(spark, "evolve_stream")
    landing, sink, ckpt = f"{base}/landing/ev", f"{base}/bronze/ev", f"{base}/_ck/ev"
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, kind string").write.json(f"{landing}/2024-01-01")
    stream.evolving_bronze_append(spark, "json", landing, sink, ckpt, source_tag="ev")
    spark.createDataFrame([(3, "c", 1.5)], "id long, kind string, score double").write.json(f"{landing}/2024-01-02")
    stream.evolving_bronze_append(spark, "json", landing, sink, ckpt, source_tag="ev")
    rows = {r.id: r for r in stream.read_sink(spark, sink).collect()}
    assert sorted(rows) == [1, 2, 3]  # each file appended once
    assert rows[1].score is None and rows[3].score == 1.5
    assert str(rows[3]._run_date) == "2024-01-02"


def test_matrix_sink_prunes(spark):
    edges = spark.createDataFrame([(0, 1, 10), (1, 2, 20), (2, 0, 30)], "src int, dst int, minutes bigint")
    m = reach.with_matrix_metadata(reach.travel_time_matrix(edges), "transit", "feed_a", "v2", service_date="2024-01-10")
    path = scratch_path(spark, "matrix")
    reach.write_matrix(m, path)
    stored = spark.read.parquet(path)
    look = reach.matrix_lookup(stored, "transit", "v2").filter(F.col("origin") == 0)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = look._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(mode" in plan
    assert "EqualTo(origin,0)" in plan
    assert {(r.destination, r.travel_minutes) for r in look.collect()} == {(0, 0), (1, 10), (2, 30)}
    assert reach.matrix_lookup(stored, "transit", "v2-test").count() == 0


def test_positional_sheet_maps_titles_by_position(spark):
    from geomart.sources import sheets

    base = scratch_path(spark, "sheet_unit")
    rows = [
        ("Date", "Sales", "HPI"),  # titles: columns swapped on purpose
        ("junk", "", ""), ("junk", "", ""), ("junk", "", ""), ("junk", "", ""),
        ("2024-03-31", "10", "1250.5"),
        ("not a date", "1", "2"),
        ("2024-06-30", "", ""),  # all-empty values: dropped
        ("2024-09-30", "12", "1262.5"),
    ]
    spark.createDataFrame(rows, "a string, b string, c string").coalesce(1).write.csv(base)
    out = sheets.read_positional(spark, base, {"HPI": "hpi", "Sales": "sales_count"})
    got = sorted((str(r.quarter), r.hpi, r.sales_count) for r in out.collect())
    assert got == [("2024-01-01", 1250.5, 10.0), ("2024-07-01", 1262.5, 12.0)]


def test_tidy_sheet_checks(spark):
    import pytest

    from geomart.sources import sheets

    base = scratch_path(spark, "tidy_unit")
    spark.createDataFrame([("2024-01-31", "x", "1"), ("n/a", "y", "2")], "` date ` string, ` series` string, `value ` string") \
        .write.option("header", "true").csv(base)
    out = sheets.read_tidy(spark, base, ["date", "series", "value"], min_rows=1)
    assert [r.series for r in out.collect()] == ["x"]
    with pytest.raises(sheets.SheetValidationError):
        sheets.read_tidy(spark, base, ["date", "area_name"])
    with pytest.raises(sheets.SheetValidationError):
        sheets.read_tidy(spark, base, ["date"], min_rows=5)


def test_retention_ignores_unparsable_names(spark):
    import datetime as dt

    from geomart.sources import landing

    names = spark.createDataFrame([("2023-01-01",), ("2024-06-01",), ("latest",), ("2024-13-40",)], "n string")
    out = landing.retention_candidates(names, "n", 180, F.lit(dt.date(2024, 7, 1)))
    assert [r.n for r in out.collect()] == ["2023-01-01"]


def test_hash_skip_transitions(spark):
    import datetime as dt

    from geomart.sources import landing

    t = [dt.datetime(2024, 1, d) for d in range(1, 7)]
    runs = spark.createDataFrame(
        [(1, "s", "h1", t[0]), (2, "s", "h1", t[1]), (3, "s", None, t[2]), (4, "s", "h1", t[3]), (5, "s", "h2", t[4]), (6, "o", "h2", t[5])],
        "run_id long, source string, content_hash string, fetched_at timestamp",
    )
    got = {r.run_id: r.status for r in landing.hash_skip_status(runs).collect()}
    assert got == {1: "succeeded", 2: "skipped", 3: "failed", 4: "skipped", 5: "succeeded", 6: "succeeded"}


def test_matrix_follows_long_chains_and_keeps_far_nodes(spark):
    df = spark.createDataFrame([(i, i + 1, 1) for i in range(20)] + [(50, 51, 200)], "src int, dst int, minutes bigint")
    got = {(r.origin, r.destination) for r in reach.travel_time_matrix(df, 90, bucket=1).collect()}
    assert got == {(a, b) for a in range(21) for b in range(a, 21)} | {(50, 50), (51, 51)}


def test_entity_columns_by_header_name(spark):
    from geomart.sources import archives

    lines = spark.createDataFrame(
        [
            ("x", "stops", "v1", 0, "stop_id, stop_lat,stop_lon,stop_name"),
            ("x", "stops", "v1", 1, '7,-41.1,174.2,"Main, ""upper"" end"'),
            ("x", "stops", "v1", 2, "8,,bad,"),
            ("y", "stops", "v2", 0, "zone,stop_name,stop_id"),
            ("y", "stops", "v2", 1, "1,Quay,9"),
            ("y", "agency", "v2", 0, "stop_id"),
            ("y", "agency", "v2", 1, "no stop"),
        ],
        archives.LINES_SCHEMA,
    )
    schema = T.StructType().add("stop_id", "string").add("stop_name", "string").add("stop_lat", "double").add("stop_lon", "double")
    got = sorted(tuple(r)[1:] for r in archives.entity_rows(lines, "stops", schema).collect())
    assert got == [("v1", "7", 'Main, "upper" end', -41.1, 174.2), ("v1", "8", None, None, None), ("v2", "9", "Quay", None, None)]


def test_csv_stream_refuses_other_column_order(spark):
    from geomart.streaming import landing as stream

    base = scratch_path(spark, "csv_order")
    spark.createDataFrame([("Main", "7")], "stop_name string, stop_id string").write.option("header", "true").csv(f"{base}/in/d1")
    schema = T.StructType().add("stop_id", "string").add("stop_name", "string")
    with pytest.raises(Exception) as failed:
        stream.bronze_append(spark, "csv", f"{base}/in", schema, f"{base}/out", f"{base}/ck", options={"header": "true"})
    assert "CSV header does not conform to the schema" in str(failed.value) or "FAILED_READ_FILE" in str(failed.value), str(failed.value)[:300]
    assert not os.path.exists(f"{base}/out") or spark.read.schema(schema).parquet(f"{base}/out").count() == 0

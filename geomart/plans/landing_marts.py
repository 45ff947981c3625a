"""Ingestion queries: streaming landings, provenance, schema evolution, dated
files, sinks, run log, hash-skip, retention, GeoJSON documents.

Landings are written under a fresh folder of the shared checkpoint folder
(``spark.checkpoint.dir``) on every call, then read back the way a scheduled
job would.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomart.plans import views as V
from geomart.plans.registry import register
from geomart.session import scratch_path
from geomart.sources import geojson, landing
from geomart.sources.files import with_provenance
from geomart.sources.tables import read_table
from geomart.streaming import evolve
from geomart.streaming import landing as stream

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
_EVENT_COLS = [f.name for f in EVENT_SCHEMA.fields]


def _land_events(spark, sf, fmt, root):
    e = read_table(spark, sf, "events", *_EVENT_COLS, "ts").withColumn(
        "landing_date", F.to_date("ts").cast("string")
    )
    landing.write_landing(e.select(*_EVENT_COLS, "landing_date"), root, fmt, "landing_date", {"header": "true"} if fmt == "csv" else None)


_STREAM_SQL = """SELECT event_id, user_id, event_type, value, props, 'events' AS _source,
       CAST(ts AS DATE) AS _run_date FROM events"""


def _stream_landing(spark, sf, fmt):
    base = scratch_path(spark, f"stream_{fmt}")
    root, sink, ckpt = f"{base}/landing/events", f"{base}/bronze/events", f"{base}/_checkpoints/events"
    _land_events(spark, sf, fmt, root)
    opts = {"header": "true"} if fmt == "csv" else {}
    landing.check_landing_floor(spark, root, min_bytes=1_000)
    jobs = stream.bronze_tables(
        spark, f"{base}/landing", f"{base}/bronze", f"{base}/_checkpoints", {"events": EVENT_SCHEMA}, fmt, opts
    )
    jobs["events"]()
    # A second run over the same landing must add nothing (exactly once per file).
    jobs["events"]()
    return spark.read.parquet(sink).select(*_EVENT_COLS, "_source", "_run_date"), base


@register("stream_csv_landing", _STREAM_SQL)
def stream_csv_landing(spark, sf):
    """CSV landing -> streaming append with provenance, exactly once."""
    return _stream_landing(spark, sf, "csv")[0]


@register("stream_json_landing", _STREAM_SQL)
def stream_json_landing(spark, sf):
    """JSON-lines landing -> streaming append with provenance."""
    return _stream_landing(spark, sf, "json")[0]


@register(
    "stream_csv_by_name",
    """SELECT event_id, user_id, event_type, value, props, 'events' AS _source, CAST(ts AS DATE) AS _run_date FROM events""",
)
def stream_csv_by_name(spark, sf):
    """One CSV landing whose files have their columns in two orders, and one
    more column in some: read by header name, exactly once (S2, S7, R1)."""
    base = scratch_path(spark, "stream_by_name")
    root, sink = f"{base}/landing/events", f"{base}/bronze/events"
    e = read_table(spark, sf, "events", *_EVENT_COLS, "ts").withColumn("landing_date", F.to_date("ts").cast("string"))
    odd = F.col("event_id") % 2 == 1
    for part, columns in ((~odd, _EVENT_COLS), (odd, ["extra", *reversed(_EVENT_COLS)])):
        landing.write_landing(e.filter(part).withColumn("extra", F.lit("x")).select(*columns, "landing_date"), root, "csv", "landing_date", {"header": "true"})
    for _ in range(2):  # the second run finds nothing new
        evolve.csv_append_by_name(spark, root, EVENT_SCHEMA, sink, f"{base}/_checkpoints/events", source_tag="events")
    return spark.read.option("recursiveFileLookup", "true").parquet(sink).select(*_EVENT_COLS, "_source", "_run_date")


@register(
    "stream_csv_evolving",
    """SELECT event_id, user_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS event_type,
       CASE WHEN event_id % 3 = 2 THEN value ELSE floor(value) END AS value,
       CASE WHEN event_id % 3 = 2 THEN lpad(CAST(user_id AS VARCHAR), 9, '0') END AS code,
       DATE '2024-01-01' + CAST(event_id % 3 AS INTEGER) AS _run_date FROM events""",
)
def stream_csv_evolving(spark, sf):
    """Three CSV landings, one after the other: the second has a new column in
    the middle, the third another order, a wider type and one more column; the
    sink's schema grows with them (S3)."""
    base = scratch_path(spark, "stream_evolving")
    root, sink = f"{base}/landing/events", f"{base}/bronze/events"
    e = read_table(spark, sf, "events", "event_id", "user_id", "event_type", "value")
    whole = F.floor("value").cast("bigint").alias("value")
    landings = [
        ["event_id", "user_id", whole],
        ["event_id", "event_type", "user_id", whole],
        ["value", F.lpad(F.col("user_id").cast("string"), 9, "0").alias("code"), "event_type", "user_id", "event_id"],
    ]
    for i, columns in enumerate(landings):
        some = e.filter(F.col("event_id") % 3 == i).select(*columns, F.lit(f"2024-01-0{i + 1}").alias("landing_date"))
        landing.write_landing(some, root, "csv", "landing_date", {"header": "true"})
        evolve.evolving_csv_append(spark, root, sink, f"{base}/_checkpoints/events", source_tag="events")
    evolve.evolving_csv_append(spark, root, sink, f"{base}/_checkpoints/events", source_tag="events")
    return evolve.read_evolving(spark, sink).select("event_id", "user_id", "event_type", "value", "code", "_run_date")


@register(
    "stream_chained_typed",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type,
       value, event_type = 'error' AS is_error, CAST(ts AS DATE) AS _run_date
FROM events WHERE coalesce(value >= 1.0, false)""",
)
def stream_chained_typed(spark, sf):
    """Bronze stream -> typed projection and drop-expectation on the stream -> silver."""
    _, base = _stream_landing(spark, sf, "csv")

    def refine(s):
        return s.filter(F.coalesce(F.col("value") >= 1.0, F.lit(False))).select(
            F.col("event_id").cast("string").alias("event_id"),
            F.col("user_id").cast("string").alias("user_id"),
            "event_type",
            "value",
            (F.col("event_type") == "error").alias("is_error"),
            "_run_date",
        )

    silver = f"{base}/silver/events"
    stream.refine_stream(spark, f"{base}/bronze/events", silver, f"{base}/_checkpoints/silver_events", refine)
    return spark.read.parquet(silver)


@register(
    "provenance_columns",
    """SELECT event_id, 'events' AS _source, CAST(ts AS DATE) AS _run_date,
       'landing_date=' || strftime(ts, '%Y-%m-%d') AS _landing_dir FROM events""",
)
def provenance_columns(spark, sf):
    """Source and run date regex-extracted from the file path; landing folder
    kept (file names are writer-chosen, so the folder is compared) (S4)."""
    root = scratch_path(spark, "provenance") + "/landing/events"
    _land_events(spark, sf, "csv", root)
    df = spark.read.schema(EVENT_SCHEMA).option("header", "true").option("recursiveFileLookup", "true").csv(root)
    out = with_provenance(df, source_pattern=r"/landing/([a-z_]+)/")
    return out.select(
        "event_id", "_source", "_run_date",
        F.regexp_extract("_source_file", r"/(landing_date=[^/]+)/", 1).alias("_landing_dir"),
    )


@register(
    "schema_evolution_union",
    """SELECT event_id, event_type, value, CASE WHEN event_id % 2 = 1 THEN props END AS props FROM events""",
)
def schema_evolution_union(spark, sf):
    """Two landings, the newer with an extra column; each read with its own
    inferred schema and unioned by name, older rows NULL (S3)."""
    base = scratch_path(spark, "evolve")
    e = read_table(spark, sf, "events", "event_id", "event_type", "value", "props")
    e.filter(F.col("event_id") % 2 == 0).drop("props").write.json(f"{base}/run=2024-01-01")
    e.filter(F.col("event_id") % 2 == 1).write.json(f"{base}/run=2024-02-01")
    old = spark.read.json(f"{base}/run=2024-01-01")
    new = spark.read.json(f"{base}/run=2024-02-01")
    return landing.union_evolving([old, new]).select("event_id", "event_type", "value", "props")


@register(
    "latest_file_union",
    """SELECT 'region' AS dataset, CAST(r_regionkey AS VARCHAR) AS code, lower(r_name) AS label, DATE '2024-02-01' AS _run_date FROM region
UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), lower(n_name), DATE '2024-02-01' FROM nation
UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), lower(c_name), DATE '2024-02-01' FROM customer""",
)
def latest_file_union(spark, sf):
    """Latest dated CSV per dataset folder, tagged and unioned; a missing
    dataset folder is skipped (S10)."""
    base = scratch_path(spark, "dict")
    sets = {
        "region": ("r_regionkey", "r_name"),
        "nation": ("n_nationkey", "n_name"),
        "customer": ("c_custkey", "c_name"),
    }
    for ds, (code, label) in sets.items():
        # Two dated landings per dataset, written in one job as run=<date>/ folders.
        t = read_table(spark, sf, ds, code, label)
        both = t.withColumn("run", F.lit("2024-01-01")).unionByName(
            t.withColumn(label, F.lower(label)).withColumn("run", F.lit("2024-02-01"))
        )
        both.write.partitionBy("run").option("header", "true").csv(f"{base}/{ds}")
    cols = {**sets, "missing_set": ("code", "label")}
    return landing.latest_file_union(spark, base, ["region", "nation", "customer", "missing_set"], cols)


@register(
    "partitioned_sink_roundtrip",
    "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer",
)
def partitioned_sink_roundtrip(spark, sf):
    """Declared schema with column comments, partitioned full-replace sink,
    written twice (overwrite), read back (S12)."""
    path = scratch_path(spark, "sink") + "/customer"
    schema = T.StructType(
        [
            T.StructField("c_custkey", T.LongType(), False, {"comment": "Customer key."}),
            T.StructField("c_name", T.StringType(), True, {"comment": "Display name."}),
            T.StructField("c_acctbal", T.DoubleType(), True, {"comment": "Account balance."}),
            T.StructField("c_mktsegment", T.StringType(), True, {"comment": "Partition column."}),
        ]
    )
    from geomart.sources import sinks

    typed = sinks.conform(read_table(spark, sf, "customer", *schema.fieldNames()), schema)
    for _ in range(2):  # a re-run fully replaces, it does not append
        sinks.write_partitioned(typed, path, ["c_mktsegment"], sort_within=["c_custkey"])
    return spark.read.parquet(path).select(*schema.fieldNames())


def _runs(spark, sf):
    p = read_table(spark, sf, "pages", "page_id", "url", "html")
    return p.select(
        F.col("page_id").alias("run_id"),
        F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("source"),
        F.col("url").alias("source_url"),
        F.sha2(F.col("html"), 256).alias("content_hash"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60).cast("timestamp_ntz").alias("fetched_at"),
        F.length("html").cast("bigint").alias("bytes_written"),
        F.col("html"),
    )


_RUNS_SQL = """runs AS (
  SELECT page_id AS run_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS source, url AS source_url,
         sha256(html) AS content_hash, CAST(length(html) AS BIGINT) AS bytes_written, html
  FROM pages)"""


@register(
    "run_log_append",
    V.with_ctes(_RUNS_SQL)
    + """SELECT run_id, source, content_hash, 'succeeded' AS status, bytes_written,
       CASE WHEN run_id % 2 = 1 THEN 'second batch' END AS notes FROM runs""",
)
def run_log_append(spark, sf):
    """Two appends to the run log; the second adds a column that older rows
    read as NULL (S14)."""
    log = scratch_path(spark, "runlog") + "/ingest_runs"
    runs = _runs(spark, sf).drop("html").withColumn("status", F.lit("succeeded"))
    landing.append_run_log(spark, log, runs.filter(F.col("run_id") % 2 == 0))
    landing.append_run_log(spark, log, runs.filter(F.col("run_id") % 2 == 1).withColumn("notes", F.lit("second batch")))
    return landing.read_run_log(spark, log).select("run_id", "source", "content_hash", "status", "bytes_written", "notes")


@register(
    "ingest_hash_skip",
    V.with_ctes(_RUNS_SQL)
    + """, s AS (
  SELECT run_id, source, content_hash, length(html) < 200 AS failed,
         last_value(CASE WHEN length(html) >= 200 THEN content_hash END IGNORE NULLS) OVER (
           PARTITION BY source ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM runs)
SELECT run_id, source, content_hash,
       CASE WHEN failed THEN 'failed' WHEN prev IS NOT NULL AND prev = content_hash THEN 'skipped' ELSE 'succeeded' END AS status
FROM s""",
)
def ingest_hash_skip(spark, sf):
    """SHA-256 of each landing vs the source's latest successful landing:
    succeeded / skipped / failed (short bodies fail) (S15)."""
    r = _runs(spark, sf)
    # The page text stays behind; only its verdict goes through the window.
    r = r.select("run_id", "source", "fetched_at", "content_hash", (F.length("html") < 200).alias("_failed"))
    out = landing.hash_skip_status(r, order=["fetched_at", "run_id"], failed=F.col("_failed"))
    return out.select("run_id", "source", "content_hash", "status")


_LANDING_NAME_SQL = """CASE WHEN o_orderkey % 50 = 0 THEN concat('notes-', CAST(o_orderkey AS VARCHAR))
            ELSE strftime(o_orderdate, '%Y-%m-%d') END"""


@register(
    "retention_candidates",
    f"""WITH l AS (SELECT DISTINCT {_LANDING_NAME_SQL} AS landing_name FROM orders),
d AS (SELECT landing_name, TRY_CAST(landing_name AS DATE) AS landing_date FROM l)
SELECT landing_name, landing_date FROM d
WHERE landing_date IS NOT NULL
  AND landing_date < (SELECT max(landing_date) FROM d) - INTERVAL 365 DAY""",
)
def retention_candidates(spark, sf):
    """Landing folders older than 365 days before the newest one; names that
    are not dates are ignored (S16)."""
    o = read_table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    name = F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.lit("notes-"), F.col("o_orderkey").cast("string"))).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    names = o.select(name.alias("landing_name")).distinct()
    newest = names.select(F.max(F.try_to_date("landing_name", "yyyy-MM-dd"))).scalar()
    return landing.retention_candidates(names, "landing_name", 365, newest).select("landing_name", "landing_date")


# ---- GeoJSON documents ----------------------------------------------------------------

_FEATURE = geojson.feature_schema(
    T.StructType([T.StructField("area_id", T.LongType()), T.StructField("part", T.StringType())])
)


def _coord(h):
    return F.format_string("%.2f", h.cast("double") / 100)


def _json_str(c):
    """A string column as a quoted, escaped JSON string literal."""
    j = F.to_json(F.array(c))
    return j.substr(F.lit(2), F.length(j) - 2)


def _docs(spark, sf):
    c = read_table(spark, sf, "customer", "c_custkey")
    k = F.col("c_custkey")
    ks = k.cast("string")
    x, y = V.lon_h(k), V.lat_h(k)
    ring = F.concat_ws(
        ",", *[F.concat(F.lit("["), _coord(x + dx), F.lit(","), _coord(y + dy), F.lit("]")) for dx, dy in
               [(0, 0), (2, 0), (2, 2), (1, 3), (0, 2), (0, 0)]]
    )
    f1 = F.concat(
        F.lit('{"type":"Feature","id":"area/'), ks, F.lit('","geometry":{"type":"Polygon","coordinates":[['), ring,
        F.lit(']]},"properties":{"area_id":'), ks, F.lit(',"part":"outline"}}'),
    )
    f2 = F.concat(
        F.lit('{"type":"Feature","id":"'), ks, F.lit('","geometry":{"type":"Point","coordinates":['), _coord(x + 1),
        F.lit(","), _coord(y + 1), F.lit(']},"properties":{"area_id":'), ks, F.lit(',"part":"centroid"}}'),
    )
    v = k % 4
    body = (
        F.when(v == 0, F.concat(F.lit('{"type":"FeatureCollection","features":['), f1, F.lit(","), f2, F.lit("]}")))
        .when(v == 1, F.concat(F.lit("["), f1, F.lit(","), f2, F.lit("]")))
        .when(v == 2, f1)
        .otherwise(F.lit("{}"))
    )
    return c.select(k.alias("doc_id"), body.alias("body"))


@register(
    "explode_features",
    """SELECT c_custkey AS doc_id, 0 AS pos, concat('area/', CAST(c_custkey AS VARCHAR)) AS feature_id,
       'Polygon' AS geom_type, c_custkey AS area_id, 'outline' AS part FROM customer WHERE c_custkey % 4 IN (0, 1, 2)
UNION ALL
SELECT c_custkey, 1, CAST(c_custkey AS VARCHAR), 'Point', c_custkey, 'centroid' FROM customer WHERE c_custkey % 4 IN (0, 1)""",
)
def explode_features(spark, sf):
    """FeatureCollection / list / single Feature -> one row per feature; other
    bodies give none (S17)."""
    f = geojson.explode_features(_docs(spark, sf), "body", _FEATURE, keep=["doc_id"])
    return f.select(
        "doc_id", "pos", F.col("feature.id").alias("feature_id"), F.col("feature.geometry.type").alias("geom_type"),
        F.col("feature.properties.area_id").alias("area_id"), F.col("feature.properties.part").alias("part"),
    )


_ADDRESS = geojson.feature_schema(
    T.StructType(
        [
            T.StructField("address_id", T.LongType()),
            T.StructField("full_address", T.StringType()),
            T.StructField("address_lifecycle", T.StringType()),
            T.StructField("gd2000_xcoord", T.DoubleType()),
            T.StructField("gd2000_ycoord", T.DoubleType()),
        ]
    ),
    T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.DoubleType()))]),
)


@register(
    "struct_flatten",
    """SELECT concat('addr.', CAST(c_custkey AS VARCHAR)) AS feature_id, 'Point' AS geom_type,
       CAST(16600 + (c_custkey * 37) % 1300 AS DOUBLE) / 100 AS lon,
       CAST(-4700 + (c_custkey * 53 + c_custkey // 1300) % 1300 AS DOUBLE) / 100 AS lat,
       c_custkey AS address_id, c_name AS full_address,
       CASE WHEN c_custkey % 5 = 0 THEN 'Retired' ELSE 'Current' END AS address_lifecycle
FROM customer""",
)
def struct_flatten(spark, sf):
    """Address features: ``properties.*`` expanded, lon/lat by 1-based array
    access, duplicate coordinate properties dropped (P3, P4)."""
    c = read_table(spark, sf, "customer", "c_custkey", "c_name")
    k = F.col("c_custkey")
    lon, lat = _coord(V.lon_h(k)), _coord(V.lat_h(k))
    text = F.concat(
        F.lit('{"type":"Feature","id":"addr.'), k.cast("string"),
        F.lit('","geometry":{"type":"Point","coordinates":['), lon, F.lit(","), lat,
        F.lit(']},"properties":{"address_id":'), k.cast("string"),
        F.lit(',"full_address":'), _json_str(F.col("c_name")),
        F.lit(',"address_lifecycle":"'), F.when(k % 5 == 0, "Retired").otherwise("Current"),
        F.lit('","gd2000_xcoord":'), lon, F.lit(',"gd2000_ycoord":'), lat, F.lit("}}"),
    )
    docs = c.select(F.from_json(text, _ADDRESS).alias("feature"))
    return geojson.flatten_feature(docs, "feature", drop=["gd2000_xcoord", "gd2000_ycoord"])


@register(
    "json_coalesce",
    """SELECT event_id, props->>'$.k' AS object_id, event_type AS hazard_label FROM events""",
)
def json_coalesce(spark, sf):
    """JSON text with key-casing variants read through ordered fallbacks (P5)."""
    e = read_table(spark, sf, "events", "event_id", "event_type", "props")
    n = F.get_json_object("props", "$.k")
    v = F.col("event_id") % 3
    q = _json_str(F.col("event_type"))
    text = (
        F.when(v == 0, F.concat(F.lit('{"OBJECTID":'), n, F.lit(',"Hazard":'), q, F.lit("}")))
        .when(v == 1, F.concat(F.lit('{"objectid":'), n, F.lit(',"Label":'), q, F.lit("}")))
        .otherwise(F.concat(F.lit('{"id":'), n, F.lit(',"Title":'), q, F.lit("}")))
    )
    p = e.select("event_id", text.alias("properties"))
    return p.select(
        "event_id",
        geojson.json_field("properties", "$.OBJECTID", "$.objectid", "$.id").alias("object_id"),
        geojson.json_field("properties", "$.Hazard", "$.Label", "$.Title").alias("hazard_label"),
    )


# ---- archives and sheets ------------------------------------------------------------------


def _write_feed_zips(base: str):
    """Task-side writer: one zip per (nation, input partition) with agency,
    stops (UTF-8 BOM), feed_info and a header-only transfers file."""

    def write(batches):
        import io
        import zipfile

        import pandas as pd
        import pyarrow.fs as pafs
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(base)
        fs.create_dir(root, recursive=True)
        frames = list(batches)
        if not frames:
            return
        df = pd.concat(frames)
        out = []
        for nk, g in df.groupby("c_nationkey"):
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
                zf.writestr("agency.txt", "﻿agency_id,agency_name\n" + f"{nk},{g['n_name'].iloc[0]}\n")
                stops = g.rename(columns={"c_custkey": "stop_id", "c_name": "stop_name", "lat": "stop_lat", "lon": "stop_lon"})
                # Column order differs between feeds.
                order = ["stop_id", "stop_name", "stop_lat", "stop_lon"] if nk % 2 else ["stop_lat", "stop_name", "stop_lon", "stop_id"]
                zf.writestr("stops.txt", "﻿" + stops[order].to_csv(index=False))
                zf.writestr("feed_info.txt", f"feed_publisher_name,feed_version\ngeomart,v{nk}\n")
                zf.writestr("transfers.txt", "from_stop_id,to_stop_id,transfer_type\n")
            name = f"{root}/feed-{nk}-p{part}.zip"
            with fs.open_output_stream(name) as f:
                f.write(buf.getvalue())
            out.append(name)
        yield pd.DataFrame({"path": out})

    return write


@register(
    "unpack_archive",
    """SELECT 'v' || CAST(c_nationkey AS VARCHAR) AS feed_version, CAST(c_custkey AS VARCHAR) AS stop_id, c_name AS stop_name,
       CAST(-4700 + (c_custkey * 53 + c_custkey // 1300) % 1300 AS DOUBLE) / 100 AS stop_lat,
       CAST(16600 + (c_custkey * 37) % 1300 AS DOUBLE) / 100 AS stop_lon
FROM customer""",
)
def unpack_archive(spark, sf):
    """Zip feeds -> per-entity rows with BOM stripped, feed version read and
    header-only files dropped; stops parsed (S19)."""
    base = scratch_path(spark, "feeds")
    c = read_table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey")
    n = read_table(spark, sf, "nation", "n_nationkey", "n_name")
    k = F.col("c_custkey")
    src = c.join(n, c.c_nationkey == n.n_nationkey).select(
        "c_custkey", "c_name", "c_nationkey", "n_name",
        (V.lat_h(k).cast("double") / 100).alias("lat"), (V.lon_h(k).cast("double") / 100).alias("lon"),
    )
    src.mapInPandas(_write_feed_zips(base), "path string").count()
    from geomart.sources import archives

    lines = archives.read_archive_lines(spark, base)
    schema = T.StructType(
        [
            T.StructField("stop_id", T.StringType()),
            T.StructField("stop_name", T.StringType()),
            T.StructField("stop_lat", T.DoubleType()),
            T.StructField("stop_lon", T.DoubleType()),
        ]
    )
    return archives.entity_rows(lines, "stops", schema).select("feed_version", "stop_id", "stop_name", "stop_lat", "stop_lon")


_SHEET_TITLES = {
    "Date": None,
    "1-URGENT": "urgent",
    "2-HIGH": "high",
    "3-MEDIUM": "medium",
    "4-NOT SPECIFIED": "not_specified",
    "5-LOW": "low",
}


def _write_sheets(spark, sf, base):
    """One headerless sheet per TA: titles, four junk rows, then end-of-quarter
    rows (plus an unparsable-date row and an all-empty row)."""
    from geomart.plans.table_marts import series_pivot

    sp = series_pivot(spark, sf)
    names = [v for v in _SHEET_TITLES.values() if v]
    eoq = F.date_format(F.last_day(F.add_months("quarter", 2)), "yyyy-MM-dd")
    data = sp.select(
        "ta_name", (F.lit(10) + F.datediff("quarter", F.lit("1990-01-01").cast("date"))).alias("row_no"),
        eoq.alias("c0"), *[F.col(v).cast("string").alias(f"c{i + 1}") for i, v in enumerate(names)],
    )
    tas = sp.select("ta_name").distinct()
    lit_rows = [
        (0, list(_SHEET_TITLES.keys())),
        (1, ["Quarterly totals by priority"] + [""] * 5),
        (2, ["Source: orders"] + [""] * 5),
        (3, ["units"] + ["NZD"] * 5),
        (4, ["series id"] + [f"S{i}" for i in range(5)]),
        (6, ["n/a", "1", "2", "3", "4", "5"]),
        (7, ["2001-12-31", "", "", "", "", ""]),
    ]
    extra = None
    for row_no, vals in lit_rows:
        r = tas.select("ta_name", F.lit(row_no).alias("row_no"), *[F.lit(v).alias(f"c{i}") for i, v in enumerate(vals)])
        extra = r if extra is None else extra.unionByName(r)
    sheet = data.unionByName(extra)
    (
        sheet.repartition("ta_name").sortWithinPartitions("ta_name", "row_no").drop("row_no")
        .write.partitionBy("ta_name").option("header", "false").csv(base)
    )


@register(
    "positional_sheet_parse",
    V.with_ctes(V.SER_SQL)
    + """SELECT ta_name, quarter, """
    + ", ".join(
        f"min(CASE WHEN priority = '{t}' THEN total_price END) AS {v}" for t, v in _SHEET_TITLES.items() if v
    )
    + " FROM ser GROUP BY ta_name, quarter",
)
def positional_sheet_parse(spark, sf):
    """Headerless sheets: titles row 0, data from row 5, known titles mapped,
    bad dates skipped, empty rows dropped, end of quarter -> first day (S20)."""
    from geomart.sources import sheets

    base = scratch_path(spark, "sheets")
    _write_sheets(spark, sf, base)
    titles = {t: v for t, v in _SHEET_TITLES.items() if v}
    out = sheets.read_positional(spark, base, titles, data_from_row=5)
    ta = F.regexp_extract("sheet_file", r"ta_name=([^/]+)/", 1)
    return out.select(ta.alias("ta_name"), "quarter", *titles.values())


@register(
    "tidy_sheet_validate",
    V.with_ctes(V.SER_SQL)
    + """SELECT ta_name AS area_name, CAST(last_day(quarter + INTERVAL 2 MONTH) AS DATE) AS date, priority AS series,
       CAST(total_price AS VARCHAR) AS value
FROM ser""",
)
def tidy_sheet_validate(spark, sf):
    """Tidy sheet: padded headers trimmed, required columns checked, row floor,
    NULL / unparsable dates dropped (S21)."""
    from geomart.plans.views import ser as ser_view
    from geomart.sources import sheets

    base = scratch_path(spark, "tidy")
    s = ser_view(spark, sf)
    good = s.select(
        F.col("ta_name").alias(" area_name "), F.date_format(F.last_day(F.add_months("quarter", 2)), "yyyy-MM-dd").alias("  date"),
        F.col("priority").alias("series "), F.col("total_price").cast("string").alias(" value"),
    )
    junk = s.filter(F.col("priority") == "5-LOW").select(
        F.col("ta_name").alias(" area_name "), F.when(F.col("n_orders") % 2 == 0, "n/a").alias("  date"),
        F.lit("junk").alias("series "), F.lit("0").alias(" value"),
    )
    good.unionByName(junk).write.option("header", "true").csv(base)
    out = sheets.read_tidy(spark, base, ["area_name", "date", "series", "value"], min_rows=10)
    return out.select("area_name", "date", "series", F.col("value"))

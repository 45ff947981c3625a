"""Shape queries: rings over the antimeridian, ring validity, centroids of any
geometry type, WKB.

Test form: every customer is a small shape at its point; a shape's outline, or
its geometry type, goes by the customer's key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from geomart.functions import cells, features, rings, text, wkb
from geomart.operators import spatial
from geomart.plans import spatial_marts as S
from geomart.plans import views as V
from geomart.plans.registry import register
from geomart.session import scratch_path
from geomart.sources import sinks
from geomart.sources.tables import dealt, read_table

# Houses whose left side is at 179.50 to 180.49 degrees.
_EAST = "17950 + (c_custkey * 37) % 100"


def _crossing_rings(spark, sf):
    c = read_table(spark, sf, "customer", "c_custkey")
    k = F.col("c_custkey")
    x, y = F.lit(17950) + (k * 37) % 100, V.lat_h(k)
    wrapped = lambda h: F.when(h > 18000, h - 36000).otherwise(h)
    point = [F.concat(F.lit("["), S._coord(wrapped(x + dx)), F.lit(","), S._coord(y + dy), F.lit("]")) for dx, dy in S.HOUSE]
    shape = F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.concat_ws(",", *point), F.lit("]]}"))
    return rings.with_polygon_from_geojson(c.select(k.alias("area_id"), shape.alias("geojson")), "geojson").select("area_id", "ring")


_Y0 = "-4700 + (c_custkey * 53 + c_custkey // 1300) % 1300"
_RUN_ON_LON = f"(((CAST({cells.cell_q_sql('cell')} AS DOUBLE) + CAST({cells.cell_r_sql('cell')} AS DOUBLE) / 2.0) * {cells._lit(cells.SIDE_KM * cells.SQRT3)}) / {cells._lit(cells.KM_PER_DEG_X)} + {cells.CENTRE_LON!r})"


@register(
    "antimeridian_polyfill",
    f"""WITH poly AS (SELECT c_custkey AS area_id, CAST({_EAST} AS DOUBLE) / 100 AS x0, CAST({_EAST} + 2 AS DOUBLE) / 100 AS x1, CAST({_EAST} + 1 AS DOUBLE) / 100 AS xm,
       CAST({_Y0} AS DOUBLE) / 100 AS y0, CAST({_Y0} + 3 AS DOUBLE) / 100 AS y1 FROM customer),
cand AS (
  SELECT area_id, x0, y0, x1, xm, {cells.TAG} + (q + {cells.OFFSET}) * {cells.SHIFT} + (r + {cells.OFFSET}) AS cell
  FROM poly, range(CAST(floor({S._proj_y('y0')} / {S._ROW_H}) AS BIGINT) - 2, CAST(ceil({S._proj_y('y1')} / {S._ROW_H}) AS BIGINT) + 3) t(r),
       range(CAST(floor({S._proj_x('x0')} / {S._COL_W} - r / 2.0) AS BIGINT) - 2, CAST(ceil({S._proj_x('x1')} / {S._COL_W} - r / 2.0) AS BIGINT) + 3) u(q)),
centres AS (SELECT *, {_RUN_ON_LON} AS clon, {S._CLAT} AS clat FROM cand)
SELECT area_id, cell FROM centres WHERE clon >= x0 AND clon < x1 AND clat > y0 AND clat < y0 + 0.03 - abs(clon - xm)""",
)
def antimeridian_polyfill(spark, sf):
    """Cells of polygons east, west of and across 180 degrees."""
    return spatial.polyfill(_crossing_rings(spark, sf), "ring", "area_id")


@register(
    "antimeridian_centroid",
    f"""WITH c AS (SELECT c_custkey AS area_id, ({_EAST} + 1) / 100.0 AS x, CAST({_Y0} AS DOUBLE) / 100 + 19.0 * {S.SIDE} / 30.0 AS y FROM customer)
SELECT area_id, {S._sround('CASE WHEN x > 180 THEN x - 360 ELSE x END', 6)} AS centroid_lon, {S._sround('y', 6)} AS centroid_lat, {S._sround('0.0005', 8)} AS area_deg2 FROM c""",
)
def antimeridian_centroid(spark, sf):
    """Centroid and area of the same polygons."""
    p = spatial.polygon_centroids(_crossing_rings(spark, sf), "ring", "area")
    return p.select(
        "area_id", F.round("centroid_lon", 6).alias("centroid_lon"), F.round("centroid_lat", 6).alias("centroid_lat"), F.round("area", 8).alias("area_deg2")
    )


#: Outlines in hundredths of a degree, and how many pairs of edges touch that should not.
OUTLINES = [
    (S.HOUSE, 0),
    ([(0, 0), (3, 3), (3, 0), (0, 2), (0, 0)], 1),  # bow-tie
    ([(0, 0), (4, 0), (4, 3), (2, 0), (0, 3), (0, 0)], 2),  # a corner on another edge
    ([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (1, 1), (3, 1), (3, 3), (1, 1), (0, 0)], 7),  # a loop nested in a loop
    ([(0, 0), (3, 0), (3, 3), (3, 1), (0, 1), (0, 0)], 2),  # an edge that runs back
]


@register(
    "ring_validity",
    f"""SELECT c_custkey AS area_id, c_custkey % 6 < 5 AS is_closed,
       CAST(CASE c_custkey % 6 {" ".join(f"WHEN {i} THEN {n}" for i, (_, n) in enumerate(OUTLINES))} ELSE 0 END AS BIGINT) AS n_contacts, c_custkey % 6 = 0 AS is_valid FROM customer""",
)
def ring_validity(spark, sf):
    """Validity with self-intersection: houses, bow-ties, touching, nested and
    backward rings, and a text that is no polygon (X5)."""
    c = dealt(read_table(spark, sf, "customer", "c_custkey"), "c_custkey")
    k = F.col("c_custkey")
    shape = F.lit('{"type":"Point","coordinates":[1,2]}')
    for i, (outline, _) in enumerate(OUTLINES):
        shape = F.when(k % 6 == i, S._geojson(V.lon_h(k), V.lat_h(k), outline)).otherwise(shape)
    r = rings.with_polygon_from_geojson(c.select(k.alias("area_id"), shape.alias("geojson")), "geojson")
    return spatial.ring_validity(r.select("area_id", "ring"), "ring", "area_id")


#: Geometry by the key: type, coordinates in hundredths, centroid.
GEOMETRIES = [
    ("Point", (1, 2), ("1", "2")),
    ("LineString", [(0, 0), (4, 0), (4, 2)], ("16.0 / 6", "2.0 / 6")),
    ("MultiLineString", [[(0, 0), (2, 0)], [(0, 4), (0, 8)]], ("2.0 / 6", "4")),
    ("Polygon", [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(2, 2), (3, 2), (3, 3), (2, 3), (2, 2)]], ("29.5 / 15", "29.5 / 15")),
    ("MultiPolygon", [[[(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]], [[(4, 0), (4, 2), (8, 2), (8, 0), (4, 0)]]], ("52.0 / 12", "1")),
]


def _coordinates(x, y, shape):
    if isinstance(shape, tuple):
        return F.concat(F.lit("["), S._coord(x + shape[0]), F.lit(","), S._coord(y + shape[1]), F.lit("]"))
    return F.concat(F.lit("["), F.concat_ws(",", *[_coordinates(x, y, s) for s in shape]), F.lit("]"))


def _shapes(k):
    """GeoJSON text by the key; one of six is no geometry."""
    out = F.lit('{"type":"Polygon"}')
    for i, (kind, coordinates, _) in enumerate(GEOMETRIES):
        body = F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), _coordinates(V.lon_h(k), V.lat_h(k), coordinates), F.lit("}"))
        out = F.when(k % 6 == i, body).otherwise(out)
    return out


def _of_type(place: int) -> str:
    return " ".join(f"WHEN {i} THEN {c[place]}" for i, (_, _, c) in enumerate(GEOMETRIES))


@register(
    "feature_centroid",
    f"""WITH c AS (SELECT c_custkey, CAST(16600 + (c_custkey * 37) % 1300 AS DOUBLE) AS x, CAST({_Y0} AS DOUBLE) AS y FROM customer)
SELECT c_custkey AS feature_id, {S._sround(f"(x + CASE c_custkey % 6 {_of_type(0)} END) / 100", 6)} AS centroid_lon,
       {S._sround(f"(y + CASE c_custkey % 6 {_of_type(1)} END) / 100", 6)} AS centroid_lat FROM c""",
)
def feature_centroid(spark, sf):
    """Centroids of points, lines, polygons with holes and many-part shapes; a
    text that is no geometry has none (X12, A15)."""
    c = read_table(spark, sf, "customer", "c_custkey")
    k = F.col("c_custkey")
    out = features.with_feature_centroid(c.select(k.alias("feature_id"), _shapes(k).alias("geojson")), "geojson")
    return out.select("feature_id", F.round("centroid_lon", 6).alias("centroid_lon"), F.round("centroid_lat", 6).alias("centroid_lat"))


@register(
    "wkb_roundtrip",
    f"""SELECT c_custkey AS area_id, CAST(pos AS INTEGER) AS pos, 'Polygon' AS geom_type, CAST(109 AS INTEGER) AS n_bytes,
       CAST(16600 + (c_custkey * 37) % 1300 + dx AS DOUBLE) / 100 AS x, CAST({_Y0} + dy AS DOUBLE) / 100 AS y
FROM customer, (VALUES {", ".join(f"({i}, {dx}, {dy})" for i, (dx, dy) in enumerate(S.HOUSE))}) h(pos, dx, dy)""",
)
def wkb_roundtrip(spark, sf):
    """Ring -> WKB -> ring, vertex by vertex and bit for bit."""
    r = S.poly_rings(spark, sf).select("area_id", wkb.polygon_wkb(F.array("ring")).alias("wkb"))
    r = r.select("area_id", F.octet_length("wkb").alias("n_bytes"), wkb.read_wkb(F.col("wkb")).alias("g"))
    points = r.select("area_id", "n_bytes", F.col("g.type").alias("geom_type"), F.posexplode(F.col("g.parts")[0]).alias("pos", "p"))
    return points.select("area_id", "pos", "geom_type", "n_bytes", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


# ---- amenities: category, centroid, cell, area, partitioned sink ----------------------------

TAGS = [("shop", "supermarket"), ("amenity", "school"), ("amenity", "doctors"), ("leisure", "park"), ("amenity", "bank"), ("amenity", "library"), ("shop", "bakery")]
_TAG_SQL = {k: "CASE c_custkey % 7 " + " ".join(f"WHEN {i} THEN '{v}'" for i, (t, v) in enumerate(TAGS) if t == k) + " END" for k in ("shop", "amenity", "leisure")}


@register(
    "amenity_sink",
    f"""WITH {S.FILL_SQL},
c AS (SELECT c_custkey, {text.amenity_category_sql(_TAG_SQL)} AS amenity_type, CAST(16600 + (c_custkey * 37) % 1300 AS DOUBLE) AS x, CAST({_Y0} AS DOUBLE) AS y FROM customer),
p AS (SELECT c_custkey, amenity_type, (x + CASE c_custkey % 6 {_of_type(0)} END) / 100 AS lon, (y + CASE c_custkey % 6 {_of_type(1)} END) / 100 AS lat
      FROM c WHERE amenity_type IS NOT NULL AND c_custkey % 6 < 5),
q AS (SELECT *, {cells.hex_cell_sql('lon', 'lat')} AS cell FROM p)
SELECT CASE WHEN c_custkey % 2 = 0 THEN 'way/' ELSE 'node/' END || c_custkey AS osm_id, amenity_type, q.cell, b.area_id,
       {S._sround('lon', 6)} AS lon, {S._sround('lat', 6)} AS lat FROM q LEFT JOIN bridge b ON b.cell = q.cell""",
)
def amenity_sink(spark, sf):
    """Features of any geometry type -> category, centroid, cell and area, in a
    sink partitioned by category, read back (A15, J12, X12, S12)."""
    c = dealt(read_table(spark, sf, "customer", "c_custkey"), "c_custkey")
    k = F.col("c_custkey")
    tag = {t: F.lit(None).cast("string") for t in _TAG_SQL}
    for i, (t, v) in enumerate(TAGS):
        tag[t] = F.when(k % 7 == i, v).otherwise(tag[t])
    fid = F.when(k % 2 == 0, F.concat(F.lit("way/"), k.cast("string"))).otherwise(k.cast("string"))
    rows = c.select(text.normalise_feature_id(fid).alias("osm_id"), text.amenity_category(tag).alias("amenity_type"), _shapes(k).alias("geojson"))
    placed = features.with_feature_centroid(rows.filter("amenity_type IS NOT NULL"), "geojson", "lon", "lat")
    # Filtered before the cell is derived, and by a value that is there anyway.
    placed = placed.filter(F.col("lon").isNotNull()).withColumn("cell", cells.hex_cell("lon", "lat"))
    joined = spatial.facts_to_areas(placed, S.stored_bridge(spark, sf), salt_on="osm_id")
    path = scratch_path(spark, "amenity") + "/amenity"
    out = joined.select("osm_id", "cell", "area_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "amenity_type")
    sinks.write_partitioned(out, path, ["amenity_type"], sort_within=["cell", "osm_id"])
    return spark.read.parquet(path).select("osm_id", "amenity_type", "cell", "area_id", "lon", "lat")

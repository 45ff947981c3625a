"""Spatial queries: cells, rings, centroids, polyfill, cell-keyed joins.

Test form: every customer is an area whose boundary is a small "house"
polygon (a 0.02 deg square with a 0.01 deg roof) anchored at its point.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from geomart.functions import cells, rings
from geomart.operators import spatial
from geomart.plans import views as V
from geomart.plans.registry import register
from geomart.sources.tables import dealt, read_table, stored_by_key

# House outline in hundredths of a degree, counter-clockwise, closed.
HOUSE = [(0, 0), (2, 0), (2, 2), (1, 3), (0, 2), (0, 0)]
SIDE = 0.02


def _coord(h):
    return F.format_string("%.2f", h.cast("double") / 100)


def _geojson(xh, yh, pts):
    parts = [F.concat(F.lit("["), _coord(xh + dx), F.lit(","), _coord(yh + dy), F.lit("]")) for dx, dy in pts]
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.concat_ws(",", *parts), F.lit("]]}"))


def poly_text(spark, sf):
    """One GeoJSON house per customer (``area_id, segment, geojson``)."""
    c = dealt(read_table(spark, sf, "customer", "c_custkey", "c_mktsegment"), "c_custkey")
    k = F.col("c_custkey")
    return c.select(
        k.alias("area_id"),
        F.col("c_mktsegment").alias("segment"),
        _geojson(V.lon_h(k), V.lat_h(k), HOUSE).alias("geojson"),
    )


def poly_rings(spark, sf):
    return rings.with_polygon_from_geojson(poly_text(spark, sf), "geojson").select("area_id", "segment", "ring")


def bridge(spark, sf):
    """Cell -> area bridge from the polyfill of every area polygon."""
    return spatial.cell_bridge(poly_rings(spark, sf), "ring", "area_id")


def stored_bridge(spark, sf):
    """The bridge as a table stored by cell, written by the first query that needs it."""
    return stored_by_key(spark, sf, "bridge", "cell", lambda: bridge(spark, sf))


POLY_SQL = """poly AS (
  SELECT c_custkey AS area_id, c_mktsegment AS segment,
         CAST(16600 + (c_custkey * 37) % 1300 AS DOUBLE) / 100 AS x0,
         CAST(-4700 + (c_custkey * 53 + c_custkey // 1300) % 1300 AS DOUBLE) / 100 AS y0,
         CAST(16600 + (c_custkey * 37) % 1300 + 2 AS DOUBLE) / 100 AS x1,
         CAST(-4700 + (c_custkey * 53 + c_custkey // 1300) % 1300 + 3 AS DOUBLE) / 100 AS y1,
         CAST(16600 + (c_custkey * 37) % 1300 + 1 AS DOUBLE) / 100 AS xm,
         CAST(-4700 + (c_custkey * 53 + c_custkey // 1300) % 1300 + 2 AS DOUBLE) / 100 AS ye
  FROM customer)"""


def _proj_x(lon):
    return f"(({lon} - {cells.CENTRE_LON!r}) * {cells._lit(cells.KM_PER_DEG_X)})"


def _proj_y(lat):
    return f"(sin({lat} * {cells._lit(cells.DEG)}) * {cells._lit(cells.Y_SCALE)})"


_ROW_H = cells._lit(cells.SIDE_KM * 1.5)
_COL_W = cells._lit(cells.SIDE_KM * cells.SQRT3)
_CLON, _CLAT = cells.cell_centre_sql("cell")

# Polyfill oracle: generous candidate ranges, exact inside test for the house
# (x0 <= x < x1, y0 < y < y0 + 0.03 - |x - xm|; half-open like ray casting).
FILL_SQL = POLY_SQL + f""",
cand AS (
  SELECT area_id, x0, y0, x1, xm, {cells.TAG} + (q + {cells.OFFSET}) * {cells.SHIFT} + (r + {cells.OFFSET}) AS cell
  FROM poly,
       range(CAST(floor({_proj_y('y0')} / {_ROW_H}) AS BIGINT) - 2, CAST(ceil({_proj_y('y1')} / {_ROW_H}) AS BIGINT) + 3) t(r),
       range(CAST(floor({_proj_x('x0')} / {_COL_W} - r / 2.0) AS BIGINT) - 2,
             CAST(ceil({_proj_x('x1')} / {_COL_W} - r / 2.0) AS BIGINT) + 3) u(q)),
centres AS (SELECT area_id, x0, y0, x1, xm, cell, {_CLON} AS clon, {_CLAT} AS clat FROM cand),
fill AS (
  SELECT area_id, cell FROM centres
  WHERE clon >= x0 AND clon < x1 AND clat > y0 AND clat < y0 + 0.03 - abs(clon - xm)),
bridge AS (SELECT cell, min(area_id) AS area_id FROM fill GROUP BY cell)"""


def _sround(expr: str, n: int) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(38,12)), {n}) AS DOUBLE)"


@register(
    "point_to_cell",
    V.with_ctes(V.PT_SQL) + f"SELECT c_custkey, {cells.hex_cell_sql('lon', 'lat')} AS cell FROM pt",
)
def point_to_cell(spark, sf):
    """Point -> hex cell at the ~0.7 km2 resolution."""
    return V.pt(spark, sf).select("c_custkey", cells.hex_cell("lon", "lat").alias("cell"))


@register(
    "cell_centroid",
    V.with_ctes(V.PT_SQL)
    + f"""SELECT c_custkey, cell, {_sround(_CLON, 6)} AS centre_lon, {_sround(_CLAT, 6)} AS centre_lat
FROM (SELECT c_custkey, {cells.hex_cell_sql('lon', 'lat')} AS cell FROM pt) p""",
)
def cell_centroid(spark, sf):
    """Cell -> centre point."""
    p = point_to_cell(spark, sf)
    lon, lat = cells.cell_centre("cell")
    return p.select("c_custkey", "cell", F.round(lon, 6).alias("centre_lon"), F.round(lat, 6).alias("centre_lat"))


_OFFS = ", ".join(f"({dq * cells.SHIFT + dr})" for dq, dr in cells.ring_offsets(1))


@register(
    "kring_expand",
    V.with_ctes(V.PT_SQL)
    + f"""SELECT DISTINCT p.cell + o.d AS cell
FROM (SELECT {cells.hex_cell_sql('lon', 'lat')} AS cell FROM pt) p, (VALUES {_OFFS}) o(d)""",
)
def kring_expand(spark, sf):
    """Cells within one step of any customer cell, de-duplicated."""
    return spatial.kring_expand(point_to_cell(spark, sf), "cell", 1)


def _variant_text(spark, sf):
    """GeoJSON per customer with deliberate defects by key: bad JSON, a Point,
    an unclosed ring, a two-vertex ring, else a valid house."""
    c = read_table(spark, sf, "customer", "c_custkey")
    k = F.col("c_custkey")
    xh, yh = V.lon_h(k), V.lat_h(k)
    v = k % 7
    text = (
        F.when(v == 0, F.lit('{"type":"Polygon","coordinates":[[[1,2],'))
        .when(v == 1, F.concat(F.lit('{"type":"Point","coordinates":['), _coord(xh), F.lit(","), _coord(yh), F.lit("]}")))
        .when(v == 2, _geojson(xh, yh, HOUSE[:-1]))
        .when(v == 3, _geojson(xh, yh, [(0, 0), (2, 0)]))
        .otherwise(_geojson(xh, yh, HOUSE))
    )
    return c.select(k.alias("area_id"), text.alias("geojson"))


@register(
    "ring_parse",
    V.with_ctes(POLY_SQL)
    + """SELECT area_id,
       CASE WHEN area_id % 7 IN (0, 1, 3) THEN NULL ELSE 6 END AS n_points,
       area_id % 7 NOT IN (0, 1, 3) AS is_valid
FROM poly""",
)
def ring_parse(spark, sf):
    """GeoJSON -> closed outer ring; only Polygons with >= 4 vertices."""
    r = rings.with_polygon_from_geojson(_variant_text(spark, sf), "geojson").select("area_id", "ring")
    return r.select(
        "area_id",
        F.when(F.col("ring").isNotNull(), F.size("ring")).alias("n_points"),
        rings.is_valid("ring").alias("is_valid"),
    )


def _esri_text(spark, sf):
    c = read_table(spark, sf, "customer", "c_custkey")
    k = F.col("c_custkey")
    xh, yh = V.lon_h(k), V.lat_h(k)

    def pts(ps):
        return F.concat_ws(",", *[F.concat(F.lit("["), _coord(xh + dx), F.lit(","), _coord(yh + dy), F.lit("]")) for dx, dy in ps])

    v = k % 5
    text = (
        F.when(v == 0, F.concat(F.lit('{"rings":[['), pts(HOUSE[:-1]), F.lit("],["), pts([(0, 0), (1, 1)]), F.lit("]]}")))
        .when(v == 1, F.concat(F.lit('{"paths":[['), pts([(0, 0), (1, 1), (2, 1)]), F.lit("]]}")))
        .when(v == 2, F.concat(F.lit('{"x":'), _coord(xh), F.lit(',"y":'), _coord(yh), F.lit("}")))
        .when(v == 3, F.lit('{"rings":[[[1,1],[2,2]]]}'))
        .otherwise(F.concat(F.lit('{"rings":[['), pts(HOUSE), F.lit("]]}")))
    )
    return c.select(k.alias("area_id"), text.alias("esri"))


@register(
    "close_rings",
    """SELECT c_custkey AS area_id,
       CASE c_custkey % 5 WHEN 0 THEN 'Polygon' WHEN 1 THEN 'LineString' WHEN 2 THEN 'Point' WHEN 3 THEN NULL ELSE 'Polygon' END AS geom_type,
       CASE c_custkey % 5 WHEN 3 THEN NULL ELSE 1 END AS n_parts,
       CASE c_custkey % 5 WHEN 0 THEN 6 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN NULL ELSE 6 END AS n_points
FROM customer""",
)
def close_rings(spark, sf):
    """Esri rings/paths/point JSON -> GeoJSON-shaped geometry."""
    g = rings.with_esri_geometry(_esri_text(spark, sf), "esri", "g").select("area_id", "g")
    return g.select(
        "area_id",
        F.col("g.type").alias("geom_type"),
        F.when(F.col("g").isNotNull(), F.size("g.rings")).alias("n_parts"),
        F.when(F.col("g").isNotNull(), F.size(F.element_at("g.rings", 1))).alias("n_points"),
    )


@register(
    "polygon_centroid",
    V.with_ctes(POLY_SQL)
    + f"""SELECT area_id, centroid_lon, centroid_lat, area_deg2 FROM (
  SELECT area_id, {_sround('x0 + 0.01', 6)} AS centroid_lon,
         {_sround(f'y0 + 19.0 * {SIDE} / 30.0', 6)} AS centroid_lat,
         {_sround('0.0005', 8)} AS area_deg2
  FROM poly) c
WHERE centroid_lon BETWEEN 166.0 AND 179.0 AND centroid_lat BETWEEN -47.5 AND -34.0""",
)
def polygon_centroid(spark, sf):
    """Shoelace centroid and area, then the plausibility box filter."""
    p = spatial.polygon_centroids(poly_rings(spark, sf), "ring", "area")
    return p.select(
        "area_id",
        F.round("centroid_lon", 6).alias("centroid_lon"),
        F.round("centroid_lat", 6).alias("centroid_lat"),
        F.round("area", 8).alias("area_deg2"),
    ).filter(spatial.in_plausible_box("centroid_lon", "centroid_lat"))


@register("polygon_polyfill", V.with_ctes(FILL_SQL) + "SELECT cell, area_id FROM bridge")
def polygon_polyfill(spark, sf):
    """Centre-in-polygon fill; each cell to one area, the smallest id."""
    return bridge(spark, sf)


_CENT_CELL = cells.hex_cell_sql("(x0 + 0.01)", f"(y0 + 19.0 * {SIDE} / 30.0)")


@register(
    "hazard_cells",
    V.with_ctes(POLY_SQL) + f"SELECT DISTINCT segment AS layer, {_CENT_CELL} AS cell FROM poly",
)
def hazard_cells(spark, sf):
    """Polygon -> its single centroid cell, distinct per layer."""
    return spatial.centroid_cells(
        poly_rings(spark, sf).withColumnRenamed("segment", "layer"), "ring", ["layer"]
    )


def order_points(spark, sf):
    o = read_table(spark, sf, "orders", "o_orderkey")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        (V.lon_h(k).cast("double") / 100).alias("lon"),
        (V.lat_h(k).cast("double") / 100).alias("lat"),
    )


@register(
    "cell_to_area_join",
    V.with_ctes(FILL_SQL)
    + f""",
op AS (SELECT o_orderkey, CAST(16600 + (o_orderkey * 37) % 1300 AS DOUBLE) / 100 AS lon,
              CAST(-4700 + (o_orderkey * 53 + o_orderkey // 1300) % 1300 AS DOUBLE) / 100 AS lat FROM orders),
oc AS (SELECT o_orderkey, {cells.hex_cell_sql('lon', 'lat')} AS cell FROM op)
SELECT oc.o_orderkey, oc.cell, b.area_id FROM oc LEFT JOIN bridge b ON oc.cell = b.cell""",
)
def cell_to_area_join(spark, sf):
    """Fact point -> cell -> area key by an equi-join on the cell."""
    facts = order_points(spark, sf).select("o_orderkey", cells.hex_cell("lon", "lat").alias("cell"))
    return spatial.facts_to_areas(facts, stored_bridge(spark, sf), salt_on="o_orderkey").select("o_orderkey", "cell", "area_id")

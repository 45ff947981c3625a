"""Polygon rings as ``array<struct<x:double,y:double>>`` with native
higher-order functions (X4-X8, S18). No geometry library, no Python UDF.

Column-level functions expect a ring *column reference*; parsing helpers
work on DataFrames and stage intermediate columns, so a parsed ring is
never re-derived inside a larger expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

GEOJSON_POLYGON = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))),
    ]
)

ESRI_GEOMETRY = T.StructType(
    [
        T.StructField("rings", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))),
        T.StructField("paths", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
    ]
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it any number of times inside ``body``.

    Catalyst inlines projected aliases into later expressions (and filters
    pushed below them), so an expensive value referenced k times per stage
    would grow k-fold per stage; a lambda binding keeps it referenced once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def to_points(coords: Column) -> Column:
    """``[[lon, lat], ...]`` -> ring of ``struct(x, y)``."""
    return F.transform(coords, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def close_ring(ring: Column | str) -> Column:
    """Append the first vertex when the ring is not closed."""
    def body(r):
        first, last = F.element_at(r, 1), F.element_at(r, -1)
        return F.when(F.size(r) == 0, r).when(
            (first.x == last.x) & (first.y == last.y), r
        ).otherwise(F.concat(r, F.array(first)))

    return let(_col(ring), body)


def _edges(ring: Column) -> Column:
    """Consecutive vertex pairs of a closed ring as ``struct(a, b)``."""
    n = F.size(ring)
    return F.arrays_zip(F.slice(ring, 1, n - 1).alias("a"), F.slice(ring, 2, n - 1).alias("b"))


def shoelace(ring: Column | str) -> Column:
    """One pass over the edges: ``struct(a2, cx6, cy6)`` where ``a2`` is twice
    the signed area and ``cx6``/``cy6`` are the centroid moment sums, all in
    coordinates relative to the first vertex (keeps the sums well conditioned)."""
    zero = F.struct(F.lit(0.0).alias("a2"), F.lit(0.0).alias("cx6"), F.lit(0.0).alias("cy6"))

    def body(r):
        o = F.element_at(r, 1)

        def step(acc, e):
            ax, ay = e.a.x - o.x, e.a.y - o.y
            bx, by = e.b.x - o.x, e.b.y - o.y
            cross = ax * by - bx * ay
            return F.struct(
                (acc.a2 + cross).alias("a2"),
                (acc.cx6 + (ax + bx) * cross).alias("cx6"),
                (acc.cy6 + (ay + by) * cross).alias("cy6"),
            )

        return F.aggregate(_edges(r), zero, step)

    return let(_col(ring), body)


def signed_area(ring: Column | str) -> Column:
    """Shoelace area in squared degrees; positive for counter-clockwise rings."""
    return shoelace(ring).a2 / 2.0


def with_centroid(df, ring_col: str, lon_out: str = "centroid_lon", lat_out: str = "centroid_lat",
                  area_out: str | None = None):
    """Area centroid of a closed simple ring (NULL for zero area); a ring may
    cross the antimeridian (X6)."""
    def body(t):
        s, o = t.s, t.o
        return F.struct(
            F.when(s.a2 != 0, s.cx6 / (3.0 * s.a2) + o.x).alias("x"),
            F.when(s.a2 != 0, s.cy6 / (3.0 * s.a2) + o.y).alias("y"),
            (s.a2 / 2.0).alias("area"),
        )

    c = F.col("_c")
    moments = let(unwrap(ring_col), lambda r: F.struct(shoelace(r).alias("s"), F.element_at(r, 1).alias("o")))
    out = df.withColumn("_c", let(moments, body))
    out = out.withColumn(lon_out, east_west(c.x)).withColumn(lat_out, c.y)
    if area_out:
        out = out.withColumn(area_out, c.area)
    return out.drop("_c")


def unwrap(ring: Column | str) -> Column:
    """The ring with longitudes that run on over the antimeridian: an edge longer
    than 180 degrees goes the short way round, so a vertex after 179.9 may have
    180.1. Rings without such an edge stay as they are."""

    def body(r):
        n = F.size(r)
        jumps = F.exists(F.sequence(F.lit(2), n), lambda i: F.abs(F.element_at(r, i).x - F.element_at(r, i - 1).x) > 180.0)

        def step(acc, p):
            last = F.element_at(acc, -1).x
            x = p.x - 360.0 * F.floor((p.x - last + 180.0) / 360.0)
            return F.concat(acc, F.array(F.struct(x.alias("x"), p.y.alias("y"))))

        run_on = F.aggregate(F.slice(r, 2, n - 1), F.slice(r, 1, 1), step)
        return F.when((n > 1) & jumps, run_on).otherwise(r)

    return let(_col(ring), body)


def east_west(lon: Column) -> Column:
    """A longitude brought back to (-180, 180]."""
    return lon - 360.0 * F.ceil((lon - 180.0) / 360.0)


def is_closed(ring: Column | str) -> Column:
    ring = _col(ring)
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    return (first.x == last.x) & (first.y == last.y)


def is_valid(ring: Column | str) -> Column:
    """Closed, at least 4 vertices, non-zero area; whether edges cross or touch
    takes pairs of edges, see ``operators.spatial.ring_validity``."""
    ring = _col(ring)
    return F.coalesce((F.size(ring) >= 4) & is_closed(ring) & (signed_area(ring) != 0), F.lit(False))


def contains_point(ring: Column | str, px: Column, py: Column) -> Column:
    """Even-odd ray casting over the ring edges."""
    crossings = F.aggregate(
        _edges(_col(ring)),
        F.lit(0),
        lambda acc, e: acc
        + F.when(
            ((e.a.y > py) != (e.b.y > py))
            & (px < (e.b.x - e.a.x) * (py - e.a.y) / (e.b.y - e.a.y) + e.a.x),
            1,
        ).otherwise(0),
    )
    return crossings % 2 == 1


def with_polygon_from_geojson(df, text_col: str, out: str = "ring"):
    """GeoJSON text -> closed outer ring of a Polygon, else NULL.

    Only type ``Polygon`` is accepted and only its outer ring is kept; bad
    JSON, other types and rings under 4 vertices after closing give NULL.
    Steps are separate columns so no parsed value is re-derived per use.
    """
    def body(g):
        ring = close_ring(to_points(F.element_at(g.coordinates, 1)))
        return let(ring, lambda r: F.when((g.type == "Polygon") & (F.size(r) >= 4), r))

    return df.withColumn(out, let(F.from_json(_col(text_col), GEOJSON_POLYGON), body))


def with_esri_geometry(df, text_col: str, out: str = "geom"):
    """Esri JSON geometry -> ``struct(type, rings)``.

    ``rings`` become a Polygon whose rings are closed and kept only with at
    least 4 vertices; ``paths`` a LineString / MultiLineString; ``x``/``y`` a
    Point. Anything else is NULL.
    """
    g = F.col("_e")
    staged = (
        df.withColumn("_e", F.from_json(_col(text_col), ESRI_GEOMETRY))
        .withColumn("_rings", F.transform(g.rings, lambda r: to_points(r)))
        .withColumn(
            "_rings",
            F.filter(F.transform("_rings", lambda r: close_ring(r)), lambda r: F.size(r) >= 4),
        )
        .withColumn("_paths", F.transform(g.paths, lambda r: to_points(r)))
    )
    rings_c, paths_c = F.col("_rings"), F.col("_paths")
    point = F.array(F.array(F.struct(g.x.alias("x"), g.y.alias("y"))))
    geom = (
        F.when(g.rings.isNotNull() & (F.size(rings_c) > 0), F.struct(F.lit("Polygon").alias("type"), rings_c.alias("rings")))
        .when(
            g.paths.isNotNull(),
            F.struct(
                F.when(F.size(paths_c) == 1, "LineString").otherwise("MultiLineString").alias("type"),
                paths_c.alias("rings"),
            ),
        )
        .when(g.x.isNotNull() & g.y.isNotNull(), F.struct(F.lit("Point").alias("type"), point.alias("rings")))
    )
    return staged.withColumn(out, geom).drop("_e", "_rings", "_paths")

"""Centroids of GeoJSON geometries of any type.

Polygons are weighted by area (holes taken away, parts summed), lines by
length, points equally. The geometry text is parsed per type into
``array<array<array<struct<x, y>>>>`` (parts, rings, points); no geometry
library and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomart.functions import rings

_COORDINATES = {
    "Point": "array<double>",
    "MultiPoint": "array<array<double>>",
    "LineString": "array<array<double>>",
    "MultiLineString": "array<array<array<double>>>",
    "Polygon": "array<array<array<double>>>",
    "MultiPolygon": "array<array<array<array<double>>>>",
}


def _parts(kind: Column, text: Column) -> Column:
    """Parts, rings and points of the coordinates ``text`` of a geometry."""
    read = {t: F.from_json(F.concat(F.lit('{"c":'), text, F.lit("}")), f"c {of}").c for t, of in _COORDINATES.items()}
    nested = {
        "Point": F.array(F.array(F.array(read["Point"]))),
        "MultiPoint": F.array(F.array(read["MultiPoint"])),
        "LineString": F.array(F.array(read["LineString"])),
        "MultiLineString": F.array(read["MultiLineString"]),
        "Polygon": F.array(read["Polygon"]),
        "MultiPolygon": read["MultiPolygon"],
    }
    out = F.lit(None)
    for t, parts in nested.items():
        out = F.when(kind == t, parts).otherwise(out)
    return F.transform(out, lambda part: F.transform(part, rings.to_points))


def _sums(parts: Column, one) -> Column:
    """``struct(w, x, y)``: the sums of ``one(ring, place)`` over all rings."""
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    flat = F.flatten(F.transform(parts, lambda part: F.transform(part, one)))
    return F.aggregate(flat, zero, lambda a, s: F.struct((a.w + s.w).alias("w"), (a.x + s.x).alias("x"), (a.y + s.y).alias("y")))


def _ring_moments(ring: Column, place: Column, origin: Column) -> Column:
    """Area and moments of a ring about ``origin``; the first ring of a part
    counts for it and the others, its holes, against it, however they turn."""
    def body(t):
        s, o = t.s, t.o
        sign = F.when(place == 0, 1.0).otherwise(-1.0) * F.signum(s.a2)
        area = sign * s.a2 / 2.0
        return F.struct(
            area.alias("w"),
            (sign * s.cx6 / 6.0 + area * (o.x - origin.x)).alias("x"),
            (sign * s.cy6 / 6.0 + area * (o.y - origin.y)).alias("y"),
        )

    closed = rings.close_ring(ring)
    return rings.let(F.struct(rings.shoelace(closed).alias("s"), F.element_at(ring, 1).alias("o")), body)


def _line_moments(line: Column, origin: Column) -> Column:
    n = F.size(line)
    legs = F.when(n > 1, F.arrays_zip(F.slice(line, 1, n - 1).alias("a"), F.slice(line, 2, n - 1).alias("b"))).otherwise(F.array())
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(acc, e):
        length = F.sqrt((e.b.x - e.a.x) * (e.b.x - e.a.x) + (e.b.y - e.a.y) * (e.b.y - e.a.y))
        return F.struct(
            (acc.w + length).alias("w"),
            (acc.x + length * ((e.a.x + e.b.x) / 2.0 - origin.x)).alias("x"),
            (acc.y + length * ((e.a.y + e.b.y) / 2.0 - origin.y)).alias("y"),
        )

    return F.aggregate(legs, zero, step)


def with_feature_centroid(df: DataFrame, text_col: str, lon_out: str = "centroid_lon", lat_out: str = "centroid_lat") -> DataFrame:
    """Centroid of the GeoJSON geometry in ``text_col``; null where the text is
    no such geometry or has neither area, length nor points. A line without
    length or a polygon without area has the mean of its points."""
    kind = F.get_json_object(text_col, "$.type")
    staged = df.withColumn("_kind", kind).withColumn("_parts", _parts(F.col("_kind"), F.get_json_object(text_col, "$.coordinates")))

    def body(parts):
        points = F.flatten(F.flatten(parts))
        origin = F.element_at(points, 1)

        def centre(o):
            point = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
            dots = F.aggregate(points, F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), lambda a, p: F.struct((a.w + point.w).alias("w"), (a.x + p.x - o.x).alias("x"), (a.y + p.y - o.y).alias("y")))
            areas = _sums_by_place(parts, o)
            lengths = _sums(parts, lambda line: _line_moments(line, o))
            pick = F.struct(dots.alias("d"), F.when(F.col("_kind").endswith("Polygon"), areas).when(F.col("_kind").endswith("LineString"), lengths).alias("m"))
            best = lambda t: F.when(F.coalesce(t.m.w, F.lit(0.0)) > 0, t.m).otherwise(t.d)
            return rings.let(pick, lambda t: rings.let(best(t), lambda s: F.when(s.w > 0, F.struct((s.x / s.w + o.x).alias("x"), (s.y / s.w + o.y).alias("y")))))

        return F.when(F.size(points) > 0, rings.let(origin, centre))

    out = staged.withColumn("_c", rings.let(F.col("_parts"), body))
    return out.withColumn(lon_out, F.col("_c.x")).withColumn(lat_out, F.col("_c.y")).drop("_kind", "_parts", "_c")


def _sums_by_place(parts: Column, origin: Column) -> Column:
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    flat = F.flatten(F.transform(parts, lambda part: F.transform(part, lambda ring, i: _ring_moments(ring, i, origin))))
    return F.aggregate(flat, zero, lambda a, s: F.struct((a.w + s.w).alias("w"), (a.x + s.x).alias("x"), (a.y + s.y).alias("y")))

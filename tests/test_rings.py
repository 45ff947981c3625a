from pyspark.sql import functions as F

from geomart.functions import rings
from geomart.operators import spatial


def _parse(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    return {r.id: r.ring for r in rings.with_polygon_from_geojson(df, "t").collect()}


def test_geojson_polygon_rules(spark):
    out = _parse(
        spark,
        [
            '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1],[0,0]],[[0.2,0.2],[0.3,0.2],[0.3,0.3],[0.2,0.2]]]}',
            '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1]]]}',
            '{"type":"Polygon","coordinates":[[[0,0],[1,0]]]}',
            '{"type":"Point","coordinates":[1,2]}',
            "{not json",
        ],
    )
    assert len(out[0]) == 5  # outer ring only
    assert len(out[1]) == 5 and out[1][0] == out[1][-1]  # closed
    assert out[2] is None and out[3] is None and out[4] is None


def test_square_centroid_area_and_validity(spark):
    df = spark.createDataFrame([(1, '{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,2],[0,0]]]}')], "id int, t string")
    r = spatial.polygon_centroids(rings.with_polygon_from_geojson(df, "t"), "ring", "area")
    row = r.select("centroid_lon", "centroid_lat", "area", rings.is_valid("ring").alias("ok")).first()
    assert (round(row.centroid_lon, 12), round(row.centroid_lat, 12), row.area, row.ok) == (1.0, 1.0, 4.0, True)


def test_contains_point_even_odd(spark):
    df = spark.createDataFrame([(1, '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[2,1],[0,4],[0,0]]]}')], "id int, t string")
    r = rings.with_polygon_from_geojson(df, "t")
    pts = [(1.0, 0.5, True), (2.0, 3.0, False), (5.0, 1.0, False), (3.5, 3.0, True)]
    for x, y, inside in pts:
        got = r.select(rings.contains_point("ring", F.lit(x), F.lit(y)).alias("c")).first().c
        assert got == inside, (x, y)


def test_polyfill_one_area_per_cell(spark):
    from geomart.plans import spatial_marts

    b = spatial_marts.bridge(spark, "/root/testdata/sf0.001")
    assert b.groupBy("cell").count().filter("count > 1").count() == 0

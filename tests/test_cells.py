import math

from pyspark.sql import functions as F

from geomart.functions import cells


def _pts(spark):
    rows = [(166.0 + i * 0.137, -47.0 + i * 0.131) for i in range(100)]
    return spark.createDataFrame(rows, "lon double, lat double")


def test_cell_centre_roundtrip_is_identity(spark):
    df = _pts(spark).select(cells.hex_cell("lon", "lat").alias("cell"))
    lon, lat = cells.cell_centre("cell")
    back = df.select("cell", cells.hex_cell(lon, lat).alias("again"))
    assert back.filter(F.col("cell") != F.col("again")).count() == 0


def test_point_is_near_its_cell_centre(spark):
    df = _pts(spark).withColumn("cell", cells.hex_cell("lon", "lat"))
    lon, lat = cells.cell_centre("cell")
    rows = df.select("lon", "lat", lon.alias("clon"), lat.alias("clat")).collect()
    for r in rows:
        dx = (r.lon - r.clon) * 111.32 * math.cos(math.radians(r.lat))
        dy = (r.lat - r.clat) * 110.57
        assert math.hypot(dx, dy) < cells.SIDE_KM * 1.2


def test_kring_has_seven_distinct_cells(spark):
    df = _pts(spark).select(cells.kring(cells.hex_cell("lon", "lat"), 1).alias("ring"))
    for r in df.collect():
        assert len(set(r.ring)) == 7
    assert len(cells.ring_offsets(2)) == 19


def test_cell_area_about_0_7_km2():
    area = 3 * math.sqrt(3) / 2 * cells.SIDE_KM**2
    assert abs(area - 0.7) < 1e-9


def test_null_point_gives_null_cell(spark):
    df = spark.createDataFrame([(None, -41.0)], "lon double, lat double")
    assert df.select(cells.hex_cell("lon", "lat").alias("c")).first().c is None

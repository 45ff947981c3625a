"""WKB (well-known binary) of points, lines and polygons as column expressions.

Written big-endian; read in either byte order. A double is put together from
its sign, exponent and mantissa with exact arithmetic, so every finite value
that is not subnormal comes back bit for bit (subnormal ones become zero).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geomart.functions.rings import let

# Fixed values of the format.
POINT, LINE_STRING, POLYGON = 1, 2, 3
_MANTISSA = 1 << 52


def _hex_number(n: Column, digits: int) -> Column:
    return F.lpad(F.hex(n.cast("bigint")), digits, "0")


def double_hex(x: Column) -> Column:
    """The 16 hex digits of a double, most significant first."""

    def body(v):
        size = F.abs(v)
        # log2 may be one off next to a power of two.
        guess = F.floor(F.log2(size)).cast("double")

        def scaled(g):
            e = F.when(size < F.pow(F.lit(2.0), g), g - 1).when(size >= F.pow(F.lit(2.0), g + 1), g + 1).otherwise(g)

            def bits(e):
                mantissa = ((size / F.pow(F.lit(2.0), e) - 1) * float(_MANTISSA)).cast("bigint")
                head = (e + 1023).cast("bigint") + F.when(v < 0, 2048).otherwise(0)
                return F.concat(_hex_number(head, 3), _hex_number(mantissa, 13))

            return let(e, bits)

        return F.when(size < 2.0**-1022, F.lit("0" * 16)).otherwise(let(guess, scaled))

    return let(x, body)


def hex_double(digits: Column) -> Column:
    """The double of 16 hex digits, most significant first."""

    def body(h):
        head = F.conv(F.substring(h, 1, 3), 16, 10).cast("bigint")
        mantissa = F.conv(F.substring(h, 4, 13), 16, 10).cast("bigint")
        exponent = (head.bitwiseAND(2047) - 1023).cast("double")
        value = (F.lit(1.0) + mantissa.cast("double") / float(_MANTISSA)) * F.pow(F.lit(2.0), exponent)
        return F.when(head.bitwiseAND(2047) == 0, F.lit(0.0)).otherwise(F.when(head >= 2048, -value).otherwise(value))

    return let(digits, body)


def _points_hex(ring: Column) -> Column:
    points = F.transform(ring, lambda p: F.concat(double_hex(p.x), double_hex(p.y)))
    return F.concat(_hex_number(F.size(ring), 8), F.array_join(points, ""))


def polygon_wkb(rings: Column) -> Column:
    """WKB of a polygon given as its rings (``array<array<struct<x, y>>>``)."""
    parts = F.array_join(F.transform(rings, _points_hex), "")
    return F.unhex(F.concat(F.lit("00"), F.lit("%08X" % POLYGON), _hex_number(F.size(rings), 8), parts))


def line_wkb(points: Column) -> Column:
    return F.unhex(F.concat(F.lit("00"), F.lit("%08X" % LINE_STRING), _points_hex(points)))


def point_wkb(x: Column, y: Column) -> Column:
    return F.unhex(F.concat(F.lit("00"), F.lit("%08X" % POINT), double_hex(x), double_hex(y)))


def _field(text: Column, start: Column, n_bytes: int, little: Column) -> Column:
    """Hex digits of ``n_bytes`` bytes from byte ``start`` (0 is the first),
    most significant first."""
    plain = F.substr(text, start * 2 + 1, F.lit(2 * n_bytes))
    turned = F.concat(*[F.substr(text, (start + i) * 2 + 1, F.lit(2)) for i in reversed(range(n_bytes))])
    return F.when(little, turned).otherwise(plain)


def _count(text: Column, start: Column, little: Column) -> Column:
    return F.conv(_field(text, start, 4, little), 16, 10).cast("int")


def _read_points(text: Column, start: Column, n: Column, little: Column) -> Column:
    at = F.filter(F.sequence(F.lit(0), n), lambda i: i < n)
    value = lambda i, k: hex_double(_field(text, start + i * 16 + 8 * k, 8, little))
    return F.transform(at, lambda i: F.struct(value(i, 0).alias("x"), value(i, 1).alias("y")))


def read_wkb(wkb: Column) -> Column:
    """``struct(type, parts)`` of a point, line or polygon (``parts``: its rings,
    or one list of points); null for other types."""

    def body(text):
        little = F.substring(text, 1, 2) == "01"
        kind = _count(text, F.lit(1), little)

        def rings(_):
            def step(acc, _):
                n = _count(text, acc.at, little)
                return F.struct((acc.at + 4 + n * 16).alias("at"), F.concat(acc.rings, F.array(F.struct((acc.at + 4).alias("start"), n.alias("n")))).alias("rings"))

            none = F.struct(F.lit(9).alias("at"), F.array().cast("array<struct<start:int,n:int>>").alias("rings"))
            count = _count(text, F.lit(5), little)
            found = F.aggregate(F.filter(F.sequence(F.lit(0), count), lambda i: i < count), none, step).rings
            return F.transform(found, lambda r: _read_points(text, r.start, r.n, little))

        one = lambda start, n: F.array(_read_points(text, start, n, little))
        return (
            F.when(kind == POLYGON, F.struct(F.lit("Polygon").alias("type"), let(F.lit(0), rings).alias("parts")))
            .when(kind == LINE_STRING, F.struct(F.lit("LineString").alias("type"), one(F.lit(9), _count(text, F.lit(5), little)).alias("parts")))
            .when(kind == POINT, F.struct(F.lit("Point").alias("type"), one(F.lit(5), F.lit(1)).alias("parts")))
        )

    return let(F.hex(wkb), body)

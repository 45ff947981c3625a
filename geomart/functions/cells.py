"""Hexagonal cells as native column expressions.

Equal-area hexagons of about 0.7 km2 on a Lambert cylindrical equal-area
projection centred on 173 E with standard parallel 41 S. Longitudes are
unwrapped relative to the centre meridian, so the antimeridian does not
split the domain. A cell id packs the axial (q, r) coordinates:

    cell = (8 << 56) | ((q + 2^27) << 28) | (r + 2^27)

Everything is ``+ - * /``, ``sin``/``asin``, ``floor`` and integer
arithmetic, so the expressions stay inside whole-stage codegen. The same
arithmetic is emitted as SQL text for the DuckDB oracle (``*_sql``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the grid.
EARTH_RADIUS_KM = 6371.0088
CENTRE_LON = 173.0
STANDARD_PARALLEL = -41.0
CELL_AREA_KM2 = 0.7
RESOLUTION_TAG = 8

DEG = math.pi / 180.0
COS_SP = math.cos(STANDARD_PARALLEL * DEG)
KM_PER_DEG_X = EARTH_RADIUS_KM * COS_SP * DEG
Y_SCALE = EARTH_RADIUS_KM / COS_SP
SIDE_KM = math.sqrt(2.0 * CELL_AREA_KM2 / (3.0 * math.sqrt(3.0)))
SQRT3 = math.sqrt(3.0)
OFFSET = 1 << 27
SHIFT = 1 << 28
TAG = RESOLUTION_TAG << 56


def _c(v: float) -> Column:
    return F.lit(v)


def _round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def project(lon: Column, lat: Column) -> tuple[Column, Column]:
    dlon = lon - CENTRE_LON
    dlon = F.when(dlon > 180.0, dlon - 360.0).when(dlon <= -180.0, dlon + 360.0).otherwise(dlon)
    x = dlon * _c(KM_PER_DEG_X)
    y = F.sin(lat * _c(DEG)) * _c(Y_SCALE)
    return x, y


def axial(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Fractional axial coordinates rounded to the containing hexagon."""
    x, y = project(lon, lat)
    qf = (x * _c(SQRT3 / 3.0) - y / 3.0) / _c(SIDE_KM)
    rf = (y * _c(2.0 / 3.0)) / _c(SIDE_KM)
    sf = -qf - rf
    rq, rr, rs = _round_half_up(qf), _round_half_up(rf), _round_half_up(sf)
    dq, dr, ds = F.abs(rq - qf), F.abs(rr - rf), F.abs(rs - sf)
    q = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    r = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return q.cast("bigint"), r.cast("bigint")


def pack(q: Column, r: Column) -> Column:
    return F.lit(TAG) + (q + OFFSET) * SHIFT + (r + OFFSET)


def hex_cell(lon: Column | str, lat: Column | str) -> Column:
    """Cell id (BIGINT) of the hexagon holding the point; NULL for NULL input."""
    lon = F.col(lon) if isinstance(lon, str) else lon
    lat = F.col(lat) if isinstance(lat, str) else lat
    q, r = axial(lon, lat)
    return pack(q, r)


def cell_q(cell: Column | str) -> Column:
    cell = F.col(cell) if isinstance(cell, str) else cell
    return F.shiftright(cell, 28).bitwiseAND(SHIFT - 1) - OFFSET


def cell_r(cell: Column | str) -> Column:
    cell = F.col(cell) if isinstance(cell, str) else cell
    return cell.bitwiseAND(SHIFT - 1) - OFFSET


def centre_xy(q: Column, r: Column) -> tuple[Column, Column]:
    x = (q.cast("double") + r.cast("double") / 2.0) * _c(SIDE_KM * SQRT3)
    y = r.cast("double") * _c(SIDE_KM * 1.5)
    return x, y


def unproject(x: Column, y: Column) -> tuple[Column, Column]:
    lon = x / _c(KM_PER_DEG_X) + CENTRE_LON
    lon = F.when(lon > 180.0, lon - 360.0).otherwise(lon)
    lat = F.asin(y / _c(Y_SCALE)) / _c(DEG)
    return lon, lat


def cell_centre(cell: Column | str) -> tuple[Column, Column]:
    """(lon, lat) of the cell centre."""
    x, y = centre_xy(cell_q(cell), cell_r(cell))
    return unproject(x, y)


def ring_offsets(k: int) -> list[tuple[int, int]]:
    """Axial offsets of all cells within ``k`` steps, (0, 0) first."""
    out = [(0, 0)]
    for dq in range(-k, k + 1):
        for dr in range(-k, k + 1):
            if (dq, dr) != (0, 0) and abs(dq) <= k and abs(dr) <= k and abs(dq + dr) <= k:
                out.append((dq, dr))
    return out


def kring(cell: Column | str, k: int = 1) -> Column:
    """Array of the cells within ``k`` steps of ``cell`` (including it)."""
    cell = F.col(cell) if isinstance(cell, str) else cell
    return F.array(*[cell + (dq * SHIFT + dr) for dq, dr in ring_offsets(k)])


# ---- SQL twins for the oracle -------------------------------------------------


def _lit(v: float) -> str:
    return f"CAST('{v!r}' AS DOUBLE)"


def axial_sql(lon: str, lat: str) -> tuple[str, str]:
    dlon = f"({lon} - {CENTRE_LON!r})"
    dlon = f"(CASE WHEN {dlon} > 180.0 THEN {dlon} - 360.0 WHEN {dlon} <= -180.0 THEN {dlon} + 360.0 ELSE {dlon} END)"
    x = f"({dlon} * {_lit(KM_PER_DEG_X)})"
    y = f"(sin({lat} * {_lit(DEG)}) * {_lit(Y_SCALE)})"
    qf = f"(({x} * {_lit(SQRT3 / 3.0)} - {y} / 3.0) / {_lit(SIDE_KM)})"
    rf = f"(({y} * {_lit(2.0 / 3.0)}) / {_lit(SIDE_KM)})"
    return qf, rf


def hex_cell_sql(lon: str, lat: str) -> str:
    """Scalar SQL for ``hex_cell``; uses a lateral-free nested select."""
    qf, rf = axial_sql(lon, lat)
    return f"""(SELECT {TAG} + (CAST(q AS BIGINT) + {OFFSET}) * {SHIFT} + (CAST(r AS BIGINT) + {OFFSET}) FROM (
  SELECT CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS q,
         CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS r
  FROM (SELECT rq, rr, rs, abs(rq - qf) AS dq, abs(rr - rf) AS dr, abs(rs - sf) AS ds FROM (
    SELECT qf, rf, sf, floor(qf + 0.5) AS rq, floor(rf + 0.5) AS rr, floor(sf + 0.5) AS rs FROM (
      SELECT qf, rf, -qf - rf AS sf FROM (SELECT {qf} AS qf, {rf} AS rf) a) b) c) d) e)"""


def cell_q_sql(cell: str) -> str:
    return f"((({cell}) >> 28) & {SHIFT - 1}) - {OFFSET}"


def cell_r_sql(cell: str) -> str:
    return f"(({cell}) & {SHIFT - 1}) - {OFFSET}"


def cell_centre_sql(cell: str) -> tuple[str, str]:
    q, r = cell_q_sql(cell), cell_r_sql(cell)
    x = f"((CAST({q} AS DOUBLE) + CAST({r} AS DOUBLE) / 2.0) * {_lit(SIDE_KM * SQRT3)})"
    y = f"(CAST({r} AS DOUBLE) * {_lit(SIDE_KM * 1.5)})"
    lon = f"({x} / {_lit(KM_PER_DEG_X)} + {CENTRE_LON!r})"
    lon = f"(CASE WHEN {lon} > 180.0 THEN {lon} - 360.0 ELSE {lon} END)"
    lat = f"(asin({y} / {_lit(Y_SCALE)}) / {_lit(DEG)})"
    return lon, lat

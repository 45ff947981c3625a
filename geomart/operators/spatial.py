"""Spatial operators over cells and rings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomart.functions import cells, rings
from geomart.operators.quality import LAT_RANGE, LON_RANGE
from geomart.session import ensure_checkpoint_dir


def kring_expand(df: DataFrame, cell_col: str, k: int = 1, out: str = "cell") -> DataFrame:
    """All cells within ``k`` steps of the input cells, de-duplicated."""
    return df.select(F.explode(cells.kring(cell_col, k)).alias(out)).distinct()


def polygon_centroids(df: DataFrame, ring_col: str, area_out: str | None = None) -> DataFrame:
    return rings.with_centroid(df, ring_col, "centroid_lon", "centroid_lat", area_out)


def in_plausible_box(
    lon: str, lat: str, lon_range=LON_RANGE, lat_range=LAT_RANGE
):
    """Centroid bounding-box plausibility predicate."""
    return F.col(lon).between(*lon_range) & F.col(lat).between(*lat_range)


def centroid_cells(df: DataFrame, ring_col: str, keys: list[str]) -> DataFrame:
    """One centroid cell per polygon, de-duplicated over ``keys``."""
    # Filter on the centroid, not on the derived cell: a filter above the cell
    # expression would be pushed below it and inline the whole derivation.
    return (
        polygon_centroids(df, ring_col)
        .filter(F.col("centroid_lon").isNotNull() & F.col("centroid_lat").isNotNull())
        .select(*keys, cells.hex_cell("centroid_lon", "centroid_lat").alias("cell"))
        .distinct()
    )


_EPS = 1e-9


def _row_lat(r):
    """Latitude of the centre line of cell row ``r``."""
    return F.asin(r.cast("double") * cells.SIDE_KM * 1.5 / F.lit(cells.Y_SCALE)) / F.lit(cells.DEG)


def _cut_at_seam(lo, hi):
    """The longitudes from ``lo`` to ``hi`` as intervals between the seam and the
    seam one turn on."""
    seam = cells.CENTRE_LON - 180.0
    first, last = F.floor((lo - seam) / 360.0), F.floor((hi - seam) / 360.0)
    return F.transform(
        F.sequence(first, last),
        lambda k: F.struct(
            (F.greatest(lo, k * 360.0 + seam) - k * 360.0).alias("lo"), (F.least(hi, (k + 1) * 360.0 + seam) - k * 360.0).alias("hi")
        ),
    )


def polyfill(df: DataFrame, ring_col: str, id_col: str) -> DataFrame:
    """Cells whose centre lies inside each polygon: ``(id, cell)``.

    Scanline fill. Each ring edge is crossed with the centre line of every
    cell row it straddles (rows come from the edge's projected y-range), the
    crossings of one (polygon, row) are sorted and paired into inside
    intervals, and the cells of each interval are exploded. This is the
    even-odd ray test with the same straddle rule and the same crossing
    arithmetic, but the ring is never copied per candidate, and a large
    polygon spreads over many (polygon, row) groups instead of one task.
    """
    # Longitudes run on over the antimeridian; the inside intervals are cut at the
    # seam of the projection, where cell numbers start anew.
    n = F.size("_ring")
    edges = df.select(F.col(id_col), rings.unwrap(ring_col).alias("_ring")).select(
        F.col(id_col),
        F.explode(F.arrays_zip(F.slice("_ring", 1, n - 1).alias("a"), F.slice("_ring", 2, n - 1).alias("b"))).alias("e"),
    ).select(
        id_col,
        F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"),
        F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"),
    ).filter(F.col("ay") != F.col("by"))
    row_h = cells.SIDE_KM * 1.5
    _, ylo = cells.project(F.lit(cells.CENTRE_LON), F.least("ay", "by"))
    _, yhi = cells.project(F.lit(cells.CENTRE_LON), F.greatest("ay", "by"))
    rows = edges.select(
        "*",
        F.explode(
            F.sequence(F.ceil(ylo / row_h - _EPS).cast("bigint"), F.floor(yhi / row_h + _EPS).cast("bigint"))
        ).alias("_r"),
    ).withColumn("_lat", _row_lat(F.col("_r")))
    py = F.col("_lat")
    crossings = rows.filter((F.col("ay") > py) != (F.col("by") > py)).select(
        id_col,
        "_r",
        ((F.col("bx") - F.col("ax")) * (py - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")).alias("_xint"),
    )
    # One group per (polygon, row): its crossings, bounded by the ring size.
    lines = crossings.groupBy(id_col, "_r").agg(F.array_sort(F.collect_list("_xint")).alias("_xs"))
    spans = lines.select(
        id_col,
        "_r",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), (F.size("_xs") / 2).cast("int") - 1),
                lambda i: F.struct(F.element_at("_xs", i * 2 + 1).alias("lo"), F.element_at("_xs", i * 2 + 2).alias("hi")),
            )
        ).alias("_s"),
    ).select(id_col, "_r", F.explode(_cut_at_seam(F.col("_s.lo"), F.col("_s.hi"))).alias("_s"))
    col_w = cells.SIDE_KM * cells.SQRT3
    x_lo, x_hi = [(F.col(f"_s.{c}") - cells.CENTRE_LON) * F.lit(cells.KM_PER_DEG_X) for c in ("lo", "hi")]
    half_r = F.col("_r").cast("double") / 2.0
    cand = spans.select(
        id_col,
        "_r",
        "_s",
        F.explode(
            F.sequence(
                F.ceil(x_lo / col_w - half_r - _EPS).cast("bigint"),
                F.floor(x_hi / col_w - half_r + _EPS).cast("bigint"),
            )
        ).alias("_q"),
    )
    cx, _ = cells.centre_xy(F.col("_q"), F.col("_r"))
    # Exact half-open test on the same centre longitude the ray test uses.
    lon = cx / F.lit(cells.KM_PER_DEG_X) + cells.CENTRE_LON
    return cand.filter((lon >= F.col("_s.lo")) & (lon < F.col("_s.hi"))).select(
        F.col(id_col), cells.pack(F.col("_q"), F.col("_r")).alias("cell")
    )


def cell_bridge(df: DataFrame, ring_col: str, id_col: str) -> DataFrame:
    """Cell -> area bridge: each cell assigned to at most one polygon, the
    smallest id wins (deterministic form of the reference's de-duplication)."""
    return polyfill(df, ring_col, id_col).groupBy("cell").agg(F.min(id_col).alias(id_col))


#: Shares that the facts of a cell are cut into when they meet its area.
FACT_SALTS = 8


def facts_to_areas(facts: DataFrame, bridge: DataFrame, cell: str = "cell", salt_on: str | None = None, salts: int = FACT_SALTS) -> DataFrame:
    """``facts`` left-joined to ``bridge`` on the cell (X11, J12). A cell with
    very many facts (a city centre) is cut into ``salts`` keys, by ``salt_on``
    or the whole row; the bridge has one row per cell and is copied to each."""
    by = F.xxhash64(salt_on) if salt_on else F.xxhash64(*[F.col(c) for c in facts.columns])
    shared = bridge.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    # The copies are no part of the size that the planner sees: never broadcast.
    return facts.withColumn("_salt", F.pmod(by, F.lit(salts)).cast("int")).join(shared.hint("merge"), [cell, "_salt"], "left").drop("_salt")


def hazard_polygon_cells(df: DataFrame, ring_col: str, id_col: str, keys: list[str], mode: str = "centroid") -> DataFrame:
    """Cells of hazard polygons, de-duplicated over ``keys``.

    ``centroid`` (default) emits the single centroid cell per polygon;
    ``polyfill`` emits every cell whose centre is inside the polygon.
    """
    if mode == "centroid":
        return centroid_cells(df, ring_col, keys)
    if mode == "polyfill":
        meta = df.select(id_col, *[k for k in keys if k != id_col])
        return polyfill(df, ring_col, id_col).join(meta, id_col).select(*keys, "cell").distinct()
    raise ValueError(f"unknown mode {mode}")


def _exact(c):
    """Coordinates as decimals of 9 places, so orientation tests are exact."""
    return c.cast("decimal(12,9)")


def _turn(ax, ay, bx, by, cx, cy):
    """On which side of the line from a to b the point c is: 1, -1 or 0 (on it)."""
    return F.signum(((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)).cast("double"))


def _within(ax, ay, bx, by, cx, cy):
    """Whether c, known to be on the line of a and b, is between them."""
    return cx.between(F.least(ax, bx), F.greatest(ax, bx)) & cy.between(F.least(ay, by), F.greatest(ay, by))


def self_contacts(df: DataFrame, ring_col: str, id_col: str) -> DataFrame:
    """``(id, i, j)``: pairs of edges of a ring that share a point which they
    should not: edges that are not neighbours and meet anywhere, and neighbours
    that run back over each other (X5).

    A ring of n edges is laid on a grid of about sqrt(n) by sqrt(n) cells; an
    edge is put into the cells it passes, row by row, and pairs meet by an
    equi-join on (ring, cell), so a long ring is many small groups. Points that
    repeat the one before are no edges.
    """
    def edges_of(r):
        """Edges of points of which none repeats the one before, with the ring's
        box; none for less than two edges. Every value is bound once."""
        xs, ys = F.transform(r, lambda p: p.x), F.transform(r, lambda p: p.y)
        n = F.size(r) - 1
        box = F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
        ends = F.arrays_zip(F.slice(r, 1, n).alias("a"), F.slice(r, 2, n).alias("b"))
        each = lambda o: F.transform(ends, lambda e, i: F.struct(i.alias("i"), e.a.alias("a"), e.b.alias("b"), o.n.alias("n"), o.box.alias("box")))
        return F.when(n >= 2, rings.let(F.struct(n.alias("n"), box.alias("box")), each))

    def distinct_points(r):
        return F.filter(r, lambda p, i: (i == 0) | ~((p.x == F.element_at(r, F.greatest(i, F.lit(1))).x) & (p.y == F.element_at(r, F.greatest(i, F.lit(1))).y)))

    exact = F.transform(rings.unwrap(ring_col), lambda p: F.struct(_exact(p.x).alias("x"), _exact(p.y).alias("y")))
    staged = df.select(id_col, F.explode(rings.let(rings.let(exact, distinct_points), edges_of)).alias("e"))
    edges = staged.select(
        id_col, F.col("e.n").alias("_n"), F.ceil(F.sqrt(F.col("e.n").cast("double"))).cast("int").alias("_side"), F.col("e.i").alias("_i"),
        F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"), F.col("e.box").alias("_box"),
    )

    def cell(v, low, high):
        at = F.floor((v - low).cast("double") / F.greatest((high - low).cast("double"), F.lit(1e-9)) * F.col("_side")).cast("int")
        return F.least(F.greatest(at, F.lit(0)), F.col("_side") - 1)

    b = F.col("_box")
    rows = edges.withColumn("_gy", F.explode(F.sequence(cell(F.least("ay", "by"), b.y, b.y1), cell(F.greatest("ay", "by"), b.y, b.y1))))
    # Longitudes of the edge within its row of cells, a hair wider for rounding.
    height = (b.y1 - b.y).cast("double") / F.col("_side")
    y0, y1 = b.y.cast("double") + F.col("_gy") * height, b.y.cast("double") + (F.col("_gy") + 1) * height
    ax, ay, bx, by = [F.col(c).cast("double") for c in ("ax", "ay", "bx", "by")]

    def at(y):
        share = F.greatest(F.least((y - ay) / (by - ay), F.lit(1.0)), F.lit(0.0))
        return ax + (bx - ax) * share

    hair = (b.x1 - b.x).cast("double") * 1e-6 + 1e-9
    level = F.abs(by - ay) < 1e-9
    left = F.when(level, F.least(ax, bx)).otherwise(F.least(at(y0), at(y1))) - hair
    right = F.when(level, F.greatest(ax, bx)).otherwise(F.greatest(at(y0), at(y1))) + hair
    low_x, high_x = b.x.cast("double"), b.x1.cast("double")
    # Both sides of the join read it; the planner takes it for as small as the table.
    ensure_checkpoint_dir(df.sparkSession)
    met = rows.withColumn("_gx", F.explode(F.sequence(cell(left, low_x, high_x), cell(right, low_x, high_x)))).drop("_box", "_side").checkpoint()
    one, two = met.alias("s"), met.hint("merge").alias("t")
    pairs = one.join(two, (F.col(f"s.{id_col}") == F.col(f"t.{id_col}")) & (F.col("s._gx") == F.col("t._gx")) & (F.col("s._gy") == F.col("t._gy")) & (F.col("s._i") < F.col("t._i")))
    a, c = [F.col("s.ax"), F.col("s.ay")], [F.col("t.ax"), F.col("t.ay")]
    e, d = [F.col("s.bx"), F.col("s.by")], [F.col("t.bx"), F.col("t.by")]
    t1, t2, t3, t4 = _turn(*a, *e, *c), _turn(*a, *e, *d), _turn(*c, *d, *a), _turn(*c, *d, *e)
    meet = (
        ((t1 * t2 < 0) & (t3 * t4 < 0))
        | ((t1 == 0) & _within(*a, *e, *c)) | ((t2 == 0) & _within(*a, *e, *d))
        | ((t3 == 0) & _within(*c, *d, *a)) | ((t4 == 0) & _within(*c, *d, *e))
    )
    follows = F.col("t._i") == F.col("s._i") + 1
    closes = (F.col("s._i") == 0) & (F.col("t._i") == F.col("s._n") - 1)
    # Neighbours share one point; a second one means that they run back.
    back = ((t2 == 0) & _within(*a, *e, *d)) | ((t3 == 0) & _within(*c, *d, *a))
    shut = ((t1 == 0) & _within(*a, *e, *c)) | ((t4 == 0) & _within(*c, *d, *e))
    bad = F.when(follows & closes, back & shut).when(follows, back).when(closes, shut).otherwise(meet)
    return pairs.filter(bad).select(F.col(f"s.{id_col}").alias(id_col), F.col("s._i").alias("i"), F.col("t._i").alias("j")).distinct()


def ring_validity(df: DataFrame, ring_col: str, id_col: str) -> DataFrame:
    """``(id, is_closed, n_contacts, is_valid)`` of each ring: valid is a closed
    ring of at least 4 points with an area, whose edges meet only where they
    follow one another (X5). Ids are distinct; a null ring is not valid."""
    ensure_checkpoint_dir(df.sparkSession)
    # Rings may be parsed from texts: once, and not again for either use.
    df = df.select(F.col(id_col), F.col(ring_col), rings.is_valid(ring_col).alias("_shape")).checkpoint()
    contacts = self_contacts(df.filter("_shape"), ring_col, id_col).groupBy(id_col).agg(F.count(F.lit(1)).alias("n_contacts"))
    shape = df.select(F.col(id_col), F.coalesce(rings.is_closed(ring_col), F.lit(False)).alias("is_closed"), "_shape")
    joined = shape.join(contacts.hint("merge"), id_col, "left").withColumn("n_contacts", F.coalesce("n_contacts", F.lit(0)))
    return joined.select(id_col, "is_closed", "n_contacts", (F.col("_shape") & (F.col("n_contacts") == 0)).alias("is_valid"))

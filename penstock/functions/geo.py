"""Spatial expressions without a geometry type.

Points are (lng, lat) columns; a ring is array<struct<x,y>> that ends where it begins; a polygon is an array of rings,
the first its outline and the others holes; a multipolygon is an array of polygons.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import cut

EARTH_KM = 6371.0088
#: Kilometres of a degree of latitude.
DEGREE_KM = math.pi * EARTH_KM / 180
#: Half axis of the Mercator projection in metres.
MERCATOR_M = 6378137.0


def haversine_km(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


#: Half axis in metres and flattening of the spheroid.
AXIS, FLAT = 6378137.0, 1 / 298.257223563
#: Least and largest ratio of a distance on the spheroid and on the sphere, rounded outwards.
STRETCH = 1.006


def _geodesic(su, cu, sv, s, c, a0):
    """(metres, longitude on the auxiliary sphere less that on the spheroid) of arcs with sine and cosine of their length and the sine of their azimuth at the equator."""
    cos2 = 1 - a0 * a0
    mid = np.where(cos2 > 1e-14, c - 2 * su * sv / np.maximum(cos2, 1e-14), 0.0)
    arc = np.arctan2(s, c)
    u2 = cos2 * (FLAT * (2 - FLAT) / (1 - FLAT) ** 2)
    a = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    b = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    short = b * s * (mid + b / 4 * (c * (2 * mid * mid - 1) - b / 6 * mid * (4 * s * s - 3) * (4 * mid * mid - 3)))
    k = FLAT / 16 * cos2 * (4 + FLAT * (4 - 3 * cos2))
    return AXIS * (1 - FLAT) * a * (arc - short), (1 - k) * FLAT * a0 * (arc + k * s * (mid + k * c * (2 * mid * mid - 1)))


def spheroid_m(lng1, lat1, lng2, lat2):
    """Metres of the shortest lines on the spheroid, of arrays of degrees; within a millimetre, also between nearly opposite points.

    The longitude on the auxiliary sphere is found in a fixed number of steps. Where these do not converge, near opposite
    points, the azimuth is bisected: the longitude that it leads to grows with it, if a line begins at the end that is
    farther from the equator, taken in the south.
    """
    u, v = (np.arctan((1 - FLAT) * np.tan(np.radians(x))) for x in (lat1, lat2))
    l = np.radians(np.abs(np.mod(lng2 - lng1 + 180, 360.0) - 180))
    su, cu, sv, cv = np.sin(u), np.cos(u), np.sin(v), np.cos(v)
    lam = l
    for _ in range(20):
        s, c = np.hypot(cv * np.sin(lam), cu * sv - su * cv * np.cos(lam)), su * sv + cu * cv * np.cos(lam)
        a0 = np.where(s > 0, cu * cv * np.sin(lam) / np.where(s > 0, s, 1), 0.0)
        out, more = _geodesic(su, cu, sv, s, c, a0)
        lam, before = l + more, lam
    out = np.where(s > 0, out, 0.0)
    hard = np.flatnonzero((np.abs(lam - before) > 1e-13) | (lam > np.pi) | ((l > 3) & (np.abs(u + v) < 0.02)))
    if len(hard):
        x, y, l = u[hard], v[hard], l[hard]
        x, y = np.where(np.abs(x) >= np.abs(y), x, y), np.where(np.abs(x) >= np.abs(y), y, x)
        y, x = np.where(x > 0, -y, y), np.minimum(-np.abs(x), -1e-200)
        su, cu, sv, cv = np.sin(x), np.cos(x), np.sin(y), np.cos(y)
        low, high = np.zeros(len(l)), np.full(len(l), np.pi)
        for _ in range(60):
            azimuth = (low + high) / 2
            a0, ca = np.sin(azimuth) * cu, np.cos(azimuth)
            cb = np.sqrt(np.maximum(ca * ca * cu * cu + (cv * cv - cu * cu), 0.0))
            arc = np.clip(np.arctan2(sv, cb) - np.arctan2(su, ca * cu), 0, np.pi)  # rounding must not carry it beyond
            m, more = _geodesic(su, cu, sv, np.sin(arc), np.cos(arc), a0)
            short = np.arctan2(a0 * sv, cb) - np.arctan2(a0 * su, ca * cu) - more < l
            low, high = np.where(short, azimuth, low), np.where(short, high, azimuth)
        out[hard] = m
    return out


def spheroid_km(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Kilometres of the shortest line on the spheroid; null where a degree is null. In batches of columns, as it takes steps."""

    @F.pandas_udf("double")
    def km(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        with np.errstate(invalid="ignore"):
            return pd.Series(spheroid_m(*(x.to_numpy(float) for x in (a, b, c, d))) / 1000)

    known = lng1.isNotNull() & lat1.isNotNull() & lng2.isNotNull() & lat2.isNotNull()
    return F.when(known, km(*[x.cast("double") for x in (lng1, lat1, lng2, lat2)]))


def _edges(ring: Column) -> Column:
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.arrays_zip(F.slice(ring, F.lit(1), n).alias("a"), F.slice(ring, F.lit(2), n).alias("b"))


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting: true inside a closed ring; points on a left or lower edge are inside."""
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    return F.size(F.filter(_edges(ring), crosses)) % 2 == 1


def in_polygons(polygons: Column, x: Column, y: Column) -> Column:
    """Whether a multipolygon has the point: inside an odd number of a polygon's rings, so that holes are outside."""
    return F.exists(polygons, lambda p: F.size(F.filter(p, lambda r: in_ring(r, x, y))) % 2 == 1)


def bounds(polygons: Column) -> Column:
    """struct<x0,y0,x1,y1> of a multipolygon."""
    points = F.flatten(F.flatten(polygons))
    of = lambda c, pick: pick(F.transform(points, lambda p: p[c]))
    return F.struct(of("x", F.array_min).alias("x0"), of("y", F.array_min).alias("y0"), of("x", F.array_max).alias("x1"), of("y", F.array_max).alias("y1"))


def centroid(polygons: Column) -> Column:
    """struct<x,y>: centroid by area of a multipolygon; holes count against it. Rings may run either way round; without an area x and y are null."""

    def ring(r: Column, hole: Column) -> Column:
        cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
        start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        step = lambda s, e: F.struct((s["a"] + cross(e)).alias("a"), (s["x"] + (e["a"]["x"] + e["b"]["x"]) * cross(e)).alias("x"), (s["y"] + (e["a"]["y"] + e["b"]["y"]) * cross(e)).alias("y"))
        sign = lambda s: F.signum(s["a"]) * F.when(hole, -1.0).otherwise(1.0)
        return F.aggregate(_edges(r), start, step, lambda s: F.struct((s["a"] * sign(s)).alias("a"), (s["x"] * sign(s)).alias("x"), (s["y"] * sign(s)).alias("y")))

    sums = F.flatten(F.transform(polygons, lambda p: F.transform(p, lambda r, k: ring(r, k > 0))))
    total = lambda c: F.aggregate(sums, F.lit(0.0), lambda s, v: s + v[c])
    return F.struct(F.try_divide(total("x"), 3 * total("a")).alias("x"), F.try_divide(total("y"), 3 * total("a")).alias("y"))


def cells_of(shapes: DataFrame, key: str, geom: str = "geom", step: float = 1.0) -> DataFrame:
    """(key, i, j, parts) of the grid cells that multipolygons touch or fill: a cell has its own edges only.

    parts: struct<edges, inside> for each polygon in the cell; inside says whether the cell's middle is in the polygon.
    Where the middle is comes from the crossings of its row, an aggregate by row; cells without an edge are all inside.
    """
    middle = lambda k: (k + F.lit(0.5)) * step
    place = lambda v: F.floor(v / step).cast("long")
    rings = shapes.select(F.col(key).alias("key"), F.posexplode(geom).alias("polygon", "p")).select("key", "polygon", F.explode("p").alias("r"))
    e = rings.select("key", "polygon", F.explode(_edges(F.col("r"))).alias("e")).select("key", "polygon", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))
    rows = e.withColumn("j", F.explode(F.sequence(place(F.least("ay", "by")), place(F.greatest("ay", "by")))))
    # the stretch of an edge within a row: one cell or a few
    slope = F.try_divide(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    x_at = lambda y: F.coalesce(F.col("ax") + (y - F.col("ay")) * slope, F.col("ax"))
    clip = lambda y: F.greatest(F.least(y, F.greatest("ay", "by")), F.least("ay", "by"))
    flat = F.col("ay") == F.col("by")
    xs = F.array(F.when(flat, F.col("ax")).otherwise(x_at(clip(F.col("j") * step))), F.when(flat, F.col("bx")).otherwise(x_at(clip((F.col("j") + 1) * step))))
    slack = step * 1e-9
    within = rows.withColumn("i", F.explode(F.sequence(place(F.array_min(xs) - slack), place(F.array_max(xs) + slack))))
    own = within.groupBy("key", "polygon", "i", "j").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("edges"))
    # middles of a row inside: between its crossings, in pairs
    y = middle(F.col("j"))
    crossing = rows.filter((F.col("ay") > y) != (F.col("by") > y)).groupBy("key", "polygon", "j").agg(F.sort_array(F.collect_list((F.col("bx") - F.col("ax")) * (y - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax"))).alias("x"))
    pair = F.transform(F.sequence(F.lit(0), (F.size("x") / 2).cast("int") - 1), lambda k: F.struct(F.get("x", 2 * k).alias("a"), F.get("x", 2 * k + 1).alias("b")))
    # a middle m is inside if a <= m < b, as a crossing counts for what is strictly left of it
    first, last = (lambda v: F.ceil(v / step - 0.5).cast("long")), (lambda v: F.ceil(v / step - 0.5).cast("long") - 1)
    spans = crossing.select("key", "polygon", "j", F.explode(pair).alias("s")).filter(last(F.col("s.b")) >= first(F.col("s.a")))
    inner = spans.select("key", "polygon", "j", F.explode(F.sequence(first(F.col("s.a")), last(F.col("s.b")))).alias("i")).withColumn("inside", F.lit(True))
    both = own.join(inner, ["key", "polygon", "i", "j"], "full").select("key", "i", "j", F.struct(F.coalesce("edges", F.array().cast("array<struct<ax:double,ay:double,bx:double,by:double>>")).alias("edges"), F.coalesce("inside", F.lit(False)).alias("inside")).alias("part"))
    return both.groupBy("key", "i", "j").agg(F.collect_list("part").alias("parts"))


def in_cell(parts: Column, x: Column, y: Column, i: Column, j: Column, step: float) -> Column:
    """Whether a point of cell (i, j) is in one of the cell's polygons: from it along x, then along y to the cell's middle, each edge crossed changes sides."""
    mx, my = (i + F.lit(0.5)) * step, (j + F.lit(0.5)) * step
    along_x = lambda e: ((e["ay"] > y) != (e["by"] > y)) & ((x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]) != (mx < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]))
    along_y = lambda e: ((e["ax"] > mx) != (e["bx"] > mx)) & ((y < (e["by"] - e["ay"]) * (mx - e["ax"]) / (e["bx"] - e["ax"]) + e["ay"]) != (my < (e["by"] - e["ay"]) * (mx - e["ax"]) / (e["bx"] - e["ax"]) + e["ay"]))
    return F.exists(parts, lambda p: ((F.size(F.filter(p["edges"], along_x)) + F.size(F.filter(p["edges"], along_y))) % 2 == 1) != p["inside"])


def _places(df: DataFrame, xy: tuple[str, str], x: str, y: str) -> DataFrame:
    """(x, y) of the distinct places of rows."""
    return df.select(F.col(xy[0]).alias(x), F.col(xy[1]).alias(y)).distinct()


def containing(points: DataFrame, shapes: DataFrame, *, xy=("lng", "lat"), geom: str = "geom", step: float = 1.0, how: str = "inner") -> DataFrame:
    """Points with the shapes that contain them: an equi-join on grid cells, each with its own edges of a shape.

    Distinct places are compared with distinct geometries; then the rows of both are put in, the shapes first.
    ``step`` in degrees should be so that a cell has a few edges; shapes of any size are cut to their cells.
    """
    x, y = F.col("__x"), F.col("__y")
    forms = cut(shapes.select(F.col(geom).alias("__geom")).distinct().withColumn("__id", F.monotonically_increasing_id()))
    left = _places(points, xy, "__x", "__y").withColumn("__i", F.floor(x / step).cast("long")).withColumn("__j", F.floor(y / step).cast("long"))
    right = cells_of(forms, "__id", "__geom", step).withColumnsRenamed({"key": "__key", "i": "__k", "j": "__l", "parts": "__parts"})
    met = left.join(right, (F.col("__i") == F.col("__k")) & (F.col("__j") == F.col("__l")) & in_cell(F.col("__parts"), x, y, F.col("__i"), F.col("__j"), step)).select("__x", "__y", "__key")
    rows = shapes.join(forms, F.col(geom) == F.col("__geom")).drop("__geom")
    met = met.join(rows, F.col("__key") == F.col("__id")).drop("__key", "__id")
    return points.join(met, (F.col(xy[0]) == x) & (F.col(xy[1]) == y), how).drop("__x", "__y")


#: Degrees of a latitude band: within one, longitude cells have one width.
BAND = 5.0
#: Rows of one list of a place's rows; a place with more has several lists.
LISTED = 256
#: A cell with over so great a part of all pairs of rows is dealt out to several tasks.
PARTS = 64


def _listed(df: DataFrame, x: str, y: str, rows: str) -> DataFrame:
    """(x, y, c, rows) of (x, y, row): the rows of a place as lists of LISTED at most."""
    turn = F.row_number().over(Window.partitionBy(x, y).orderBy(x))
    return df.withColumn("__c", F.floor((turn - 1) / LISTED)).groupBy(x, y, "__c").agg(F.collect_list("__row").alias(rows))


def within_km(a: DataFrame, b: DataFrame, km: float, a_xy=("lng", "lat"), b_xy=("blng", "blat"), *, spheroid: bool = False, measure: Callable[[Column], Column] | None = None) -> DataFrame:
    """All pairs at most ``km`` apart, anywhere on the globe: an equi-join on cells with the distance as its condition.

    Rows go into the join as lists by place, so a distance is that of two lists, and pairs of rows come out of it one by one:
    no pair is shuffled, sorted or written, only the rows of a and those of b with their replicas. ``b`` should have the
    columns that are wanted; ``measure`` is applied to the distance in km, once for two lists.

    With ``spheroid`` the distance is that on the spheroid: cells and the sphere's distance allow for STRETCH.

    Rows of the grid are ``km`` high. Each row belongs to a latitude band; in it, cells are wide enough for ``km`` at
    the band's highest latitude and the rows next to it, and wrap at 180 degrees; near a pole a row is one cell. b's places are
    replicated to its cell, both neighbours, and the rows above and below: 9 times, less where cells coincide. A cell
    with over one in PARTS of the pairs of rows that cells have has its lists of a dealt out, and b's replicas to each part:
    the parts are PARTS at most, besides one a cell.
    """
    asked, km = km, km * STRETCH if spheroid else km
    lat_step = km / DEGREE_KM

    def columns_of(row: Column) -> Column:
        """Cells of a row: at most so many that none is narrower than ``km``."""
        reach = F.abs((F.floor(row * lat_step / BAND) + F.lit(0.5)) * BAND) + BAND / 2 + 2 * lat_step
        narrow = F.cos(F.radians(F.least(reach, F.lit(90.0))))
        return F.greatest(F.floor(narrow * 360 / (lat_step * 1.0001)), F.lit(1)).cast("long")

    row = lambda lat: F.floor(lat / lat_step).cast("long")
    column = lambda lng, n: F.pmod(F.floor((lng + 180) / 360 * n).cast("long"), n)

    def home(df: DataFrame) -> DataFrame:
        return df.withColumn("__i", row(F.col("__y"))).withColumn("__n", columns_of(F.col("__i"))).withColumn("__j", column(F.col("__x"), F.col("__n")))

    def around(df: DataFrame) -> DataFrame:
        df = df.withColumn("__k", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: row(F.col("__v")) + s))).withColumn("__m", columns_of(F.col("__k")))
        at = column(F.col("__u"), F.col("__m"))
        return df.withColumn("__l", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: F.pmod(at + s, F.col("__m"))))))

    # what is null is near to nothing
    rows_of = lambda df, xy, x, y: df.select(F.col(xy[0]).alias(x), F.col(xy[1]).alias(y), F.struct(*df.columns).alias("__row")).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows_a, rows_b = rows_of(a, a_xy, "__x", "__y"), rows_of(b, b_xy, "__u", "__v")
    # cells with the most pairs: PARTS at most, as each has more than its share
    pairs = home(rows_a).groupBy("__i", "__j").count().join(around(rows_b).groupBy(F.col("__k").alias("__i"), F.col("__l").alias("__j")).agg(F.count(F.lit(1)).alias("__b")), ["__i", "__j"])
    pairs = pairs.select("__i", "__j", (F.col("count").cast("double") * F.col("__b")).alias("__w"))
    heavy = pairs.crossJoin(pairs.agg(F.sum("__w").alias("__all"))).select("__i", "__j", F.floor(F.col("__w") * PARTS / F.col("__all")).cast("int").alias("__parts")).filter("__parts > 1")
    left = home(_listed(rows_a, "__x", "__y", "__as")).join(F.broadcast(heavy), ["__i", "__j"], "left").withColumn("__s", F.pmod(F.xxhash64("__x", "__y", "__c"), F.coalesce("__parts", F.lit(1))))
    left = left.select("__x", "__y", "__i", "__j", "__s", "__as", _unit(F.col("__x"), F.col("__y")).alias("__p"))
    right = around(_listed(rows_b, "__u", "__v", "__bs")).join(F.broadcast(heavy.withColumnsRenamed({"__i": "__k", "__j": "__l"})), ["__k", "__l"], "left")
    right = right.withColumn("__t", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    right = right.select("__u", "__v", "__k", "__l", F.col("__t").cast("long").alias("__t"), "__bs", _unit(F.col("__u"), F.col("__v")).alias("__q"))
    place = [F.col(c) for c in ("__x", "__y", "__u", "__v")]
    d = haversine_km(*place)
    # the chord, with a slack for its rounding, spares most pairs of a cell the distance itself
    chord = sum(((F.col(f"__p.{c}") - F.col(f"__q.{c}")) * (F.col(f"__p.{c}") - F.col(f"__q.{c}")) for c in "xyz"), F.lit(0.0)) <= (2 * math.sin(min(km / EARTH_KM, math.pi) / 2)) ** 2 * (1 + 1e-9) + 1e-12
    # sort-merge at every size: Spark takes replicas for a table as small as b
    met = left.join(right.hint("merge"), (F.col("__i") == F.col("__k")) & (F.col("__j") == F.col("__l")) & (F.col("__s") == F.col("__t")) & chord & (d <= km))
    met = met.select("__as", "__bs", (spheroid_km(*place) if spheroid else d).alias("__d"))
    met = met.filter(F.col("__d") <= asked) if spheroid else met  # what the sphere's distance admits is measured
    met = met.withColumn("__d", measure(F.col("__d"))) if measure else met
    return met.select(F.inline("__as"), "__bs", "__d").select(*a.columns, F.inline("__bs"), F.col("__d").alias("distance_km"))


#: Points of ``b`` that a cell of the tree may have without being split, and its deepest level (0.8 m).
LEAF, DEEPEST = 16, 24


def _unit(lng: Column, lat: Column) -> Column:
    """struct<x,y,z> of a place on the unit sphere."""
    return F.struct((F.cos(F.radians(lat)) * F.cos(F.radians(lng))).alias("x"), (F.cos(F.radians(lat)) * F.sin(F.radians(lng))).alias("y"), F.sin(F.radians(lat)).alias("z"))


def _tree(points: DataFrame) -> tuple[DataFrame, int]:
    """(level, cell, up, count, box, leaf) of the cells of ``points`` (p) on the sphere, split where they have over LEAF points, and the deepest level.

    A level's cells are grouped only of the points whose cell above was split.
    """
    code = lambda level: F.concat_ws(":", *[F.floor((F.col(f"p.{c}") + 1) * 2.0 ** (level - 1)).cast("long").cast("string") for c in "xyz"])
    box = F.struct(*[f(f"p.{c}").alias(f"{c}{k}") for c in "xyz" for k, f in ((0, F.min), (1, F.max))])
    left, out, level = points.withColumn("up", F.lit("")), None, 1
    while True:
        cells = left.withColumn("cell", F.concat(F.lit(f"{level}/"), code(level))).groupBy("up", "cell").agg(F.count(F.lit(1)).alias("count"), box.alias("box"))
        cells = cut(cells.withColumn("leaf", (F.col("count") <= LEAF) | F.lit(level == DEEPEST)).withColumn("level", F.lit(level)))
        out = cells if out is None else out.unionByName(cells)
        split = cells.filter("not leaf").select(F.col("cell").alias("up"))
        if split.isEmpty():
            return out, level
        named = left.drop("up").withColumn("up", F.concat(F.lit(f"{level}/"), code(level)))
        left, level = cut(named.join(split, "up", "left_semi")), level + 1


def nearest(a: DataFrame, b: DataFrame, key: str, tie: str, *, a_xy=("lng", "lat"), b_xy=("blng", "blat")) -> DataFrame:
    """Each row of ``a`` (by ``key``) with its nearest of ``b`` (equal distances by ``tie``) and distance_km; none if ``b`` is empty or a coordinate null.

    ``b`` is put into a tree of cells by its density. A row of ``a`` goes down the tree with the cells that can have its
    nearest point: those whose box is not farther than the farthest corner of another cell's box. Boxes are in three
    dimensions, where the poles and the 180th meridian are like other places. A cell at the end has LEAF points at most,
    as of points in one place only the first by ``tie`` takes part, so no row meets more than a few of ``b``.
    """
    known = lambda df, xy: df.filter(F.col(xy[0]).isNotNull() & F.col(xy[1]).isNotNull())
    others = known(b, b_xy)
    one = others.groupBy(F.col(b_xy[0]).alias("__x"), F.col(b_xy[1]).alias("__y")).agg(F.min_by(F.struct(*b.columns), tie).alias("__row"))
    one = cut(one.withColumn("p", _unit(F.col("__x"), F.col("__y"))))
    tree, deepest = _tree(one.select("p"))
    far = lambda s, c: F.greatest(F.abs(F.col(f"q.{c}") - s[f"{c}0"]), F.abs(F.col(f"q.{c}") - s[f"{c}1"]))
    near = lambda s, c: F.greatest(s[f"{c}0"] - F.col(f"q.{c}"), F.col(f"q.{c}") - s[f"{c}1"], F.lit(0.0))
    square = lambda f, s: sum((f(s, c) * f(s, c) for c in "xyz"), F.lit(0.0))
    asked = known(a, a_xy).select(key, _unit(F.col(a_xy[0]), F.col(a_xy[1])).alias("q"))
    front, ends = asked.withColumn("cells", F.array(F.lit(""))).withColumn("best", F.lit(16.0)), None
    for level in range(1, deepest + 1):
        cells = tree.filter(F.col("level") == level).select("up", "cell", "leaf", "box")
        met = front.select(key, "q", "best", F.explode("cells").alias("up")).join(cells, "up").withColumn("lo", square(near, F.col("box")))
        met = met.withColumn("best", F.least("best", square(far, F.col("box"))))
        # of a row the cells that its best bound leaves, a few
        front = met.groupBy(key).agg(F.first("q").alias("q"), F.min("best").alias("best"), F.collect_list(F.struct("cell", "leaf", "lo")).alias("x"))
        keep = lambda leaf: F.transform(F.filter("x", lambda c: (c["leaf"] == leaf) & (c["lo"] <= F.col("best") * (1 + 1e-9) + 1e-15)), lambda c: F.struct(c["cell"].alias("cell"), c["lo"].alias("lo")))
        front = cut(front.select(key, "q", "best", keep(F.lit(True)).alias("ends"), F.transform(keep(F.lit(False)), lambda c: c["cell"]).alias("cells")))
        found = front.select(key, F.explode("ends").alias("e"))
        ends = found if ends is None else ends.unionByName(found)
        bounds_now = front.select(key, F.col("best").alias("bound"))
        final = bounds_now if level == 1 else final.unionByName(bounds_now)
    least = final.groupBy(key).agg(F.min("bound").alias("bound"))
    ends = ends.join(least, key).filter(F.col("e.lo") <= F.col("bound") * (1 + 1e-9) + 1e-15).select(key, F.col("e.cell").alias("cell"))
    place = lambda level: F.concat(F.lit(f"{level}/"), F.concat_ws(":", *[F.floor((F.col(f"p.{c}") + 1) * 2.0 ** (level - 1)).cast("long").cast("string") for c in "xyz"]))
    placed = one.withColumn("cell", F.explode(F.array(*[place(k) for k in range(1, deepest + 1)]))).join(tree.filter("leaf").select("cell"), "cell", "left_semi")
    d = haversine_km(F.col(a_xy[0]), F.col(a_xy[1]), F.col("__x"), F.col("__y"))
    met = ends.join(a.select(key, *a_xy), key).join(placed.select("cell", "__row", "__x", "__y"), "cell").withColumn("distance_km", d)
    best = met.groupBy(key).agg(F.min_by(F.struct("__row", "distance_km"), F.struct("distance_km", F.col(f"__row.{tie}"))).alias("__b"))
    best = best.select(key, *[F.col(f"__b.__row.{c}").alias(c) for c in b.columns], F.col("__b.distance_km").alias("distance_km"))
    return a.join(best, key)


def distance_class(km: Column) -> Column:
    return F.when(km < 1, "high").when(km < 3, "medium").when(km < 5, "low").otherwise("candidate")


def from_ewkt(text: Column) -> Column:
    """struct<srid,lng,lat> of SRID=n;POINT(x y); null for other texts."""
    number = r"(-?\d+(?:\.\d+)?)"
    pattern = rf"^SRID=(\d+);POINT\({number} {number}\)$"
    part = lambda k, kind: F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast(kind)
    return F.when(text.rlike(pattern), F.struct(part(1, "int").alias("srid"), part(2, "double").alias("lng"), part(3, "double").alias("lat")))


def from_mercator(x: Column, y: Column) -> Column:
    """struct<lng,lat> of web Mercator metres."""
    return F.struct(F.degrees(x / MERCATOR_M).alias("lng"), F.degrees(2 * F.atan(F.exp(y / MERCATOR_M)) - math.pi / 2).alias("lat"))


def as_multipolygon(kind: Column, polygon: Column, polygons: Column) -> Column:
    """A polygon as a multipolygon of one; null for other kinds."""
    return F.when(kind == "Polygon", F.array(polygon)).when(kind == "MultiPolygon", polygons)


def simplified(ring: list, tolerance: float) -> list:
    """Points of a line that Douglas-Peucker keeps, with a stack in place of recursion."""
    keep, todo = {0, len(ring) - 1}, [(0, len(ring) - 1)]
    while todo:
        a, b = todo.pop()
        (ax, ay), (bx, by) = ring[a], ring[b]
        far, at = tolerance, None
        for k in range(a + 1, b):
            x, y = ring[k]
            length = math.hypot(bx - ax, by - ay)
            # to the segment, as a closed ring begins and ends in one point
            t = 0.0 if not length else max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length**2))
            d = math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))
            if d > far:
                far, at = d, k
        if at is not None:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return [ring[k] for k in sorted(keep)]


def simplify(df: DataFrame, ring: str, tolerance: float) -> DataFrame:
    """``df`` with the ring column simplified; rings that would fall below four points stay. An Arrow pass, as no built-in folds a line."""
    place, schema = df.columns.index(ring), df.schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = []
            for points in batch.column(place).to_pylist():
                line = simplified([(p["x"], p["y"]) for p in points], tolerance) if points and len(points) > 4 else None
                made.append(points if line is None or len(line) < 4 else [{"x": x, "y": y} for x, y in line])
            columns = list(batch.columns)
            columns[place] = pa.array(made, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return df.mapInArrow(run, schema)


def feature(properties: list[str], lng: Column, lat: Column) -> Column:
    """A GeoJSON feature of a point as text."""
    shape = F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*properties).alias("properties")))


def shape_feature(properties: list[str], polygons: Column) -> Column:
    """A GeoJSON feature of a multipolygon as text."""
    rings = F.transform(polygons, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.array(q["x"], q["y"]))))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("MultiPolygon").alias("type"), rings.alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties")))

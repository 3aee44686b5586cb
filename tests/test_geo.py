"""Distances on the spheroid, nearest points, polygons cut to cells."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from penstock.functions import geo

#: Published distances in metres: latitude and longitude of both ends.
PAIRS = [
    (40.6, -73.8, 51.6, -0.5, 5551759.400), (-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777, 54972.271), (-30, 0, 29.9, 179.8, 19989832.82761), (0, 0, 0.5, 179.5, 19936288.579), (0, 0, 0.5, 179.7, 19944127.421),
    (0, 0, 0, 90, 10018754.171), (0, 0, 0, 180, 20003931.458625), (45, 0, -45, 180, 20003931.458625), (90, 0, -90, 0, 20003931.458625), (10, 20, 10, 20, 0.0),
]


def test_published_distances(spark):
    a, b, c, d, m = np.array(PAIRS, float).T
    for got in (geo.spheroid_m(b, a, d, c), geo.spheroid_m(d, c, b, a), geo.spheroid_m(b + 360, a, d, c)):
        assert np.abs(got - m).max() < 0.001
    rows = spark.createDataFrame([(1.0, None, 2.0, 3.0), (0.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double").select(geo.spheroid_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()
    assert rows[0][0] is None and abs(rows[1][0] - 110.574389) < 1e-6


def test_spheroid_pairs_are_whole(spark):
    rng = random.Random(3)
    place = lambda k: (k, rng.choice([179.9, -179.9, 10.0]) + rng.uniform(-0.2, 0.2), rng.choice([88.9, 0.0, -60.0]) + rng.uniform(-1, 1))
    a, b = [place(k) for k in range(150)], [place(k) for k in range(150)]
    got = geo.within_km(spark.createDataFrame(a, "id int, lng double, lat double"), spark.createDataFrame(b, "oid int, blng double, blat double"), 30.0, spheroid=True).select("id", "oid").collect()
    x, y = (np.array(v)[:, 1:] for v in (a, b))
    d = geo.spheroid_m(np.repeat(x[:, 0], 150), np.repeat(x[:, 1], 150), np.tile(y[:, 0], 150), np.tile(y[:, 1], 150)).reshape(150, 150)
    assert {tuple(r) for r in got} == set(zip(*map(list, np.nonzero(d <= 30_000)))) and len(got) > 100


def haversine(x, y):
    a, b, c, d = (np.radians(v) for v in (x[:, None, 0], x[:, None, 1], y[None, :, 0], y[None, :, 1]))
    return 2 * geo.EARTH_KM * np.arcsin(np.sqrt(np.minimum(1, np.sin((d - b) / 2) ** 2 + np.cos(b) * np.cos(d) * np.sin((c - a) / 2) ** 2)))


@pytest.mark.parametrize("kind", ["globe", "far", "same"])
def test_nearest_like_all_pairs(spark, kind):
    rng = np.random.default_rng(7)
    everywhere = lambda n: np.stack([rng.uniform(-180, 180, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))], 1)
    if kind == "globe":
        x, y = everywhere(300), np.concatenate([everywhere(200), [[179.99, 0.0], [-179.99, 0.0], [0.0, 90.0], [0.0, -90.0]]])
    elif kind == "far":  # one dense cluster and an isolated point, asked from everywhere and from another dense cluster
        x, y = np.concatenate([everywhere(100), rng.normal(0, 0.05, (200, 2))]), np.concatenate([rng.normal(0, 0.05, (2000, 2)) + [90, 10], [[-100.0, -50.0]]])
    else:  # many points in one place
        x, y = everywhere(50), np.concatenate([np.full((300, 2), 5.0), [[6.0, 6.0]]])
    a = spark.createDataFrame([(k, float(p), float(q)) for k, (p, q) in enumerate(x)] + [(-1, None, 1.0)], "id int, lng double, lat double")
    b = spark.createDataFrame([(k, float(p), float(q)) for k, (p, q) in enumerate(y)] + [(-2, 1.0, None)], "oid int, blng double, blat double")
    got = {r["id"]: r for r in geo.nearest(a, b, "id", "oid").collect()}
    d = haversine(x, y)
    assert sorted(got) == list(range(len(x)))
    for k, r in got.items():
        assert abs(r["distance_km"] - d[k].min()) < 1e-9 + 1e-9 * d[k].min() and d[k][r["oid"]] <= d[k].min() * (1 + 1e-12) + 1e-9
        assert kind != "same" or r["oid"] in (0, 300)


def test_nearest_rows_stay_few(spark):
    """Cells and points that the rows of ``a`` meet on the way down: a few each, however dense ``b`` is."""
    rng = np.random.default_rng(1)
    y = rng.normal(0, 0.02, (4000, 2)) + [90, 10]
    one = spark.createDataFrame([(float(p), float(q)) for p, q in y], "lng double, lat double").select(geo._unit(F.col("lng"), F.col("lat")).alias("p"))
    tree, deepest = geo._tree(one)
    assert tree.filter("leaf").agg(F.max("count"), F.sum("count")).first() == (geo.LEAF, 4000) or tree.filter("leaf").agg(F.max("count")).first()[0] <= geo.LEAF
    assert deepest < geo.DEEPEST and tree.count() < 2 * 4000


def test_polygon_of_many_points_is_cut(spark):
    n, step = 100_000, 0.02
    angle = np.linspace(0, 2 * math.pi, n)
    radius = 1 + 0.2 * np.sin(9 * angle) + 0.01 * np.sin(601 * angle)
    outline = [(float(a), float(b)) for a, b in zip(radius * np.cos(angle), radius * np.sin(angle))]
    outline[-1] = outline[0]
    hole = [(0.1, 0.1), (0.1, 0.3), (0.3, 0.1), (0.1, 0.1)]
    island = [(2.0, 2.0), (2.02, 2.0), (2.02, 2.04), (2.0, 2.04), (2.0, 2.0)]  # along the lines of the grid
    plain = [[outline, hole], [island]]
    ring = lambda r: [{"x": x, "y": y} for x, y in r]
    shapes = spark.createDataFrame([(7, [[ring(r) for r in p] for p in plain]), (8, [[ring([(-3.0, -3.0), (3.0, -3.0), (0.0, 3.0), (-3.0, -3.0)])]]), (9, [])], "id int, geom array<array<array<struct<x:double,y:double>>>>")
    cells = geo.cells_of(shapes.filter("id = 7"), "id", step=step)
    size = cells.select(F.count("i"), F.max(F.aggregate("parts", F.lit(0), lambda s, p: s + F.size(p["edges"]))), F.sum(F.aggregate("parts", F.lit(0), lambda s, p: s + F.size(p["edges"])))).first()
    assert size[0] > 7000 and size[1] < 2000 and size[2] < 1.2 * n
    rng = np.random.default_rng(2)
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(np.concatenate([rng.uniform(-1.4, 1.4, (400, 2)), rng.uniform(1.98, 2.06, (50, 2)), [[2.01, 2.0], [2.0, 2.02], [2.02, 2.02], [0.3, 0.1]]]))]
    got = {tuple(r) for r in geo.containing(spark.createDataFrame(points, "k int, lng double, lat double"), shapes, step=step).select("k", "id").collect()}

    def crossings(r, x, y):
        p, q = np.array(r[:-1]), np.array(r[1:])
        up = (p[:, 1] > y) != (q[:, 1] > y)
        p, q = p[up], q[up]
        return int((x < (q[:, 0] - p[:, 0]) * (y - p[:, 1]) / (q[:, 1] - p[:, 1]) + p[:, 0]).sum())

    want = {(k, 7) for k, x, y in points if any(sum(crossings(r, x, y) for r in p) % 2 for p in plain)} | {(k, 8) for k, x, y in points if crossings([(-3.0, -3.0), (3.0, -3.0), (0.0, 3.0), (-3.0, -3.0)], x, y) % 2}
    assert got == want
    left = geo.containing(spark.createDataFrame([(1, 50.0, 50.0)], "k int, lng double, lat double"), shapes, step=step, how="left").collect()
    assert len(left) == 1 and left[0]["id"] is None


def test_centroid_of_no_area(spark):
    flat = [[[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 0.0}]]]
    got = spark.createDataFrame([(flat,), ([],)], "g array<array<array<struct<x:double,y:double>>>>").select(geo.centroid(F.col("g")).alias("c")).collect()
    assert [tuple(r["c"]) for r in got] == [(None, None)] * 2


def test_copies_of_places_and_shapes_are_measured_once(spark, monkeypatch):
    # lists of three rows; the distance is rounded between two places, then both places' rows are put in
    monkeypatch.setattr(geo, "LISTED", 3)
    a = [(k, 0.1 * (k % 2), 0.0) for k in range(20)] + [(90, None, 0.0)]
    b = [(k, 0.1 * (k % 3), 0.0) for k in range(30)] + [(91, 0.0, None)]
    got = geo.within_km(spark.createDataFrame(a, "id int, lng double, lat double"), spark.createDataFrame(b, "oid int, blng double, blat double"), 12.0, spheroid=True, measure=lambda km: F.round(km, 1))
    assert got.columns == ["id", "lng", "lat", "oid", "blng", "blat", "distance_km"]
    want = [(x[0], y[0], 11.1 * abs(x[0] % 2 - y[0] % 3)) for x in a[:-1] for y in b[:-1] if abs(x[0] % 2 - y[0] % 3) < 2]
    assert sorted((r.id, r.oid, r.distance_km) for r in got.collect()) == sorted(want)
    # 9 million pairs of 30,000 points and 300 copies of one shape
    square = [[[{"x": 0.25, "y": 0.25}, {"x": 0.75, "y": 0.25}, {"x": 0.75, "y": 0.75}, {"x": 0.25, "y": 0.75}, {"x": 0.25, "y": 0.25}]]]
    shapes = spark.createDataFrame([(square,)], "geom array<array<array<struct<x:double,y:double>>>>").crossJoin(spark.range(300).withColumnRenamed("id", "sid"))
    points = spark.range(30_000).select("id", F.lit(0.5).alias("lng"), F.lit(0.5).alias("lat"))
    met = geo.containing(points, shapes)
    assert met.select("id", "sid").count() == 9_000_000


def test_pairs_of_rows_are_not_shuffled(spark):
    """Rows are shuffled, with their replicas, before places meet; what comes out of the join goes to no other task, also where places are many."""
    a = spark.range(5000).select("id", (F.col("id") / 50_000).alias("lng"), F.lit(88.0).alias("lat"))
    b = spark.range(4000).select(F.col("id").alias("oid"), (F.col("id") / 50_000).alias("blng"), F.lit(88.0).alias("blat"))
    met = geo.within_km(a, b, 50.0).select("id", "oid")
    plan = met._jdf.queryExecution().executedPlan().toString()
    # the join whose condition has the places' chord
    assert "Exchange" not in plan[: plan.index("__p#")]
    # one cell has all pairs: its lists are dealt to several tasks
    parts = met.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert sum(r["count"] for r in parts) == 5000 * 4000 and len(parts) > 1


def test_pairs_of_dealt_cells_are_whole(spark, monkeypatch):
    monkeypatch.setattr(geo, "LISTED", 2)
    rng = random.Random(5)
    place = lambda k: (k, rng.choice([179.9, -179.9, 10.0]) + rng.choice([-0.2, 0.0, 0.2]), rng.choice([89.6, 0.0, -60.0]) + rng.choice([-0.3, 0.0, 0.3]))
    a, b = [place(k) for k in range(200)], [place(k) for k in range(150)]
    d = haversine(np.array(a)[:, 1:], np.array(b)[:, 1:])
    want = sorted(zip(*map(list, np.nonzero(d <= 40.0))))
    # both sides have a column of one name
    frames = spark.createDataFrame([*a, (900, None, 0.0)], "id int, lng double, lat double"), spark.createDataFrame([*b, (901, 0.0, None)], "id int, blng double, blat double")
    for parts in (1, 3, 1000):
        monkeypatch.setattr(geo, "PARTS", parts)
        got = geo.within_km(*frames, 40.0)
        assert got.columns == ["id", "lng", "lat", "id", "blng", "blat", "distance_km"]
        rows = sorted((r[0], r[3]) for r in got.collect())
        assert rows == want and len(rows) > 1000

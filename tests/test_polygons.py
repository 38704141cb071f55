"""Points in polygons through the index of squares, against ray casting over whole rings."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import polygons, spatial

POINTS = "cell_id long, lat double, lon double"
RINGS = "way_id long, ring array<struct<lon:double,lat:double>>"


def casts(ring, x, y):
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:])) % 2


def star(rng, n, x=120.0, y=10.0, size=2.0):
    """A closed ring that winds around a place, in and out."""
    out = [(x + size * (0.3 + 0.7 * rng.random()) * math.cos(2 * math.pi * i / n), y + size * (0.3 + 0.7 * rng.random()) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return [*out, out[0]]


@pytest.mark.parametrize("step", [0.05, 0.5, 3.0])
def test_stars_holes_and_nulls(spark, step):
    rng = random.Random(7)
    areas = {1: [star(rng, 60), star(rng, 9, size=0.4)], 2: [star(rng, 200, x=121.5)], 3: [[(118.0, 8.0), (118.5, 8.0), (118.5, 9.0), (118.0, 9.0), (118.0, 8.0)]], 4: [[(123.0, 11.0), (124.0, 12.0), (123.0, 13.0), (122.0, 12.0), (123.0, 11.0)]]}
    rings = spark.createDataFrame([(k, r) for k, rs in areas.items() for r in rs], RINGS)
    points = [(i, 10 + 4 * rng.uniform(-1, 1), 120.5 + 4.5 * rng.uniform(-1, 1)) for i in range(1500)] + [(2000, None, 120.0), (2001, 10.0, None), (2002, float("nan"), 120.0), (2003, float("inf"), 120.0)]
    got = {r.cell_id: r.inside for r in polygons.inside_areas(spark.createDataFrame(points, POINTS), polygons.edges_of_rings(rings), step=step).collect()}
    want = {i: lat is not None and lon is not None and math.isfinite(lat) and any(sum(casts(r, lon, lat) for r in rs) % 2 for rs in areas.values()) for i, lat, lon in points}
    assert got == want and 100 < sum(want.values()) < 1400


def test_rings_on_the_grids_own_lines(spark):
    """Vertices where the lines cross, and edges along them."""
    o = polygons.ORIGIN
    ring = [(o + 119.0, o + 9.0), (o + 121.0, o + 9.0), (o + 121.0, o + 11.0), (o + 119.0, o + 11.0), (o + 119.0, o + 9.0)]
    points = [(i, 8.7 + (i // 40) * 0.0701, 118.7 + (i % 40) * 0.0703) for i in range(1600)]
    got = {r.cell_id: r.protected for r in spatial.inside_any(spark.createDataFrame(points, POINTS), spark.createDataFrame([(1, ring)], RINGS)).collect()}
    assert got == {i: casts(ring, lon, lat) for i, lat, lon in points}


def test_rings_that_repeat_or_lie_in_each_other(spark):
    """Any ring will do: neither a second copy nor a ring around it takes a place out."""
    box = lambda s: [(-s, -s), (s, -s), (s, s), (-s, s), (-s, -s)]
    rings = spark.createDataFrame([(1, box(1.0)), (1, box(1.0)), (2, box(2.0))], RINGS)
    got = spatial.inside_any(spark.createDataFrame([(1, 0.1, 0.1), (2, 1.5, 0.1), (3, 2.5, 0.1)], POINTS), rings)
    assert dict(map(tuple, got.collect())) == {1: 1, 2: 1, 3: 0}


def test_open_and_short_rings(spark):
    rings = spark.createDataFrame([(1, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]), (2, [(5.0, 5.0), (6.0, 5.0), (5.0, 5.0)])], RINGS)
    got = spatial.inside_any(spark.createDataFrame([(1, 1.0, 1.0), (2, 5.1, 5.1), (3, 3.0, 3.0)], POINTS), rings)
    assert dict(map(tuple, got.collect())) == {1: 1, 2: 0, 3: 0}


def test_relations_by_parity(spark):
    """An outer ring of two ways, of which one runs backwards, with an inner ring; and relations that a way or a node is missing of."""
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 4.0, 0.0), (3, 4.0, 4.0), (4, 0.0, 4.0), (5, 1.0, 1.0), (6, 3.0, 1.0), (7, 2.0, 3.0)], "id long, lon double, lat double")
    ways = spark.createDataFrame([(10, [1, 2, 3]), (11, [1, 4, 3]), (12, [5, 6, 7, 5]), (13, [1, 2, 99, 1])], "id long, nodes array<long>")
    members = spark.createDataFrame([(100, 10), (100, 11), (100, 12), (100, 12), (101, 10), (102, 13), (103, 77), (104, 10), (104, 88)], "relation long, way long")
    edges, open_ = polygons.edges_of_relations(members, ways, nodes)
    assert {r.area for r in open_.collect()} == {101, 102, 103, 104}
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 2.0), (3, 3.5, 3.5), (4, 5.0, 5.0)], POINTS)
    assert {r.cell_id: r.inside for r in polygons.inside_areas(points, edges).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_a_large_ring_is_never_sent_whole(spark):
    """100,000 vertices: no square holds more than its own edges, so what is exchanged grows with edges and squares."""
    rng = random.Random(1)
    ring = star(rng, 100_000)
    squares = polygons.squares_of(polygons.edges_of_rings(spark.createDataFrame([(1, ring)], RINGS)), 0.05).select(F.explode("areas").alias("a")).select(F.size("a.edges").alias("n"))
    r = squares.agg(F.sum(F.greatest("n", F.lit(0))).alias("held"), F.max("n").alias("most")).first()
    length = sum(math.dist(a, b) for a, b in zip(ring, ring[1:]))
    assert r.held <= 4 * (length / 0.05 + 2 * len(ring)) and r.most < len(ring) / 5
    points = [(i, 10 + 2 * rng.uniform(-1, 1), 120 + 2 * rng.uniform(-1, 1)) for i in range(150)]
    got = {r.cell_id: r.inside for r in polygons.inside_areas(spark.createDataFrame(points, POINTS), polygons.edges_of_rings(spark.createDataFrame([(1, ring)], RINGS)), step=0.05).collect()}
    assert got == {i: bool(casts(ring, lon, lat)) for i, lat, lon in points}


def test_nothing(spark):
    none = spark.createDataFrame([], RINGS)
    assert [tuple(r) for r in spatial.inside_any(spark.createDataFrame([(1, 1.0, 1.0)], POINTS), none).collect()] == [(1, 0)]
    assert spatial.inside_any(spark.createDataFrame([], POINTS), none).count() == 0

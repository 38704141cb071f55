"""Spatial joins and clusters against brute force, and the cases that have known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import geo
from gridloom.operators import cluster, features, spatial, split
from gridloom.plans.components import connected_components


def points(n, seed, lat0=10.0, lon0=120.0, spread=0.6):
    rng = random.Random(seed)
    return [(i, lat0 + rng.random() * spread, lon0 + rng.random() * spread) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "cell_id long, lat double, lon double")


def haversine(a, b):
    p = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(p))


@pytest.mark.parametrize("inclusive, apart", [(False, False), (True, False), (False, True)])
def test_radius_pairs_by_brute_force(spark, inclusive, apart):
    rows = points(120, 1) + [(500, 10.1, 120.1), (501, 10.1, 120.1)]
    df = spatial.with_km(frame(spark, rows))
    km = [(r.cell_id, r.x, r.y) for r in df.collect()]
    want = set()
    for i, x, y in km:
        for j, u, v in km:
            d = math.sqrt((x - u) ** 2 + (y - v) ** 2)
            if (d <= 9 if inclusive else d < 9) and (d > 0 or not apart):
                want.add((i, j))
    got = spatial.radius_pairs(df, df, 9.0, inclusive, apart).select("cell_id", "r_cell_id").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_nearest_by_brute_force(spark):
    left, right = points(60, 2), points(7, 3, lat0=11.0, lon0=118.0, spread=5.0)
    got = {r.cell_id: r.km for r in spatial.nearest(frame(spark, left), frame(spark, right), "cell_id").collect()}
    for a in left:
        assert got[a[0]] == pytest.approx(min(haversine(a, b) for b in right), rel=1e-9)


def test_nearest_far_away_and_of_nothing(spark):
    left = [(1, 0.0, 0.0), (2, 60.0, 10.0), (3, -50.0, 170.0)]
    right = [(9, 55.0, 20.0)]
    got = {r.cell_id: r.km for r in spatial.nearest(frame(spark, left), frame(spark, right), "cell_id").collect()}
    assert got == pytest.approx({a[0]: haversine(a, right[0]) for a in left})
    none = spatial.nearest(frame(spark, left), frame(spark, []), "cell_id").collect()
    assert {r.km for r in none} == {spatial.MISSING_KM}


@pytest.mark.parametrize("right", [[(9, 10.2, 120.2), (8, None, 1.0)], [(9, 80.0, 20.0)], [(8, None, None)]])
def test_nearest_keeps_rows_without_a_place(spark, right):
    left = [(1, 10.0, 120.0), (2, None, 120.0), (3, 10.0, None)]
    got = {r.cell_id: r.km for r in spatial.nearest(frame(spark, left), frame(spark, right), "cell_id").collect()}
    near = [b for b in right if None not in b]
    assert got == {1: pytest.approx(haversine(left[0], near[0]) if near else spatial.MISSING_KM), 2: None, 3: None}


def test_boxes(spark):
    cells = frame(spark, points(200, 4, spread=3.0))
    boxes = spark.createDataFrame([("a", 10.0, 11.0, 120.0, 121.0), ("b", 10.5, 12.9, 119.0, 122.0), ("none", 0.0, 1.0, 0.0, 1.0)], "name string, lat_min double, lat_max double, lon_min double, lon_max double")
    got = {(r.name, r.cell_id) for r in spatial.join_boxes(boxes, cells).collect()}
    want = {("none", None)}
    for name, a, b, c, d in [tuple(r) for r in boxes.collect()]:
        want |= {(name, i) for i, lat, lon in points(200, 4, spread=3.0) if a <= lat <= b and c <= lon <= d}
    assert got == want
    assert spatial.in_box(cells, 10.0, 11.0, 120.0).count() == 200  # one bound is missing: no filter


def test_point_in_ring(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0), (0.0, 0.0)]
    rings = spark.createDataFrame([(1, ring)], "way_id long, ring array<struct<lon:double,lat:double>>")
    cells = frame(spark, [(1, 0.5, 2.0), (2, 3.0, 2.0), (3, 3.0, 0.5), (4, 9.0, 9.0)])
    assert {r.cell_id: r.protected for r in spatial.inside_any(cells, rings).collect()} == {1: 1, 2: 0, 3: 1, 4: 0}


def clusters(spark, lats, lons, probs, **kw):
    rows = [(i, *x) for i, x in enumerate(zip(lats, lons, probs))]
    return cluster.risk_clusters(spark.createDataFrame(rows, "cell_id long, lat double, lon double, p double"), **kw)


def test_two_clusters(spark):
    lats = [10, 10.01, 10.02, 9.99, 11, 11.01, 11.02, 10.99, 12, 13]
    lons = [119, 119.01, 119.02, 118.99, 120, 120.01, 120.02, 119.99, 121, 122]
    found = clusters(spark, map(float, lats), map(float, lons), [0.8, 0.9, 0.7, 0.85, 0.6, 0.7, 0.65, 0.75, 0.1, 0.2])
    summary = cluster.cluster_summary(found).orderBy("cluster").collect()
    assert found.count() == 8 and [r.cells for r in summary] == [4, 4]
    assert summary[0].max_risk == 0.9 and summary[0].severity == "critical" and summary[0].area_km2 >= 1


def test_no_high_risk_and_all_noise(spark):
    assert clusters(spark, [10.0, 10.1], [119.0, 119.1], [0.1, 0.2]).count() == 0
    noise = clusters(spark, [10.0, 12.0, 14.0], [119.0, 121.0, 123.0], [0.8, 0.9, 0.7], eps=10.0)
    assert [r.cluster for r in noise.collect()] == [None] * 3


def test_dbscan_does_not_depend_on_row_order(spark):
    rows = points(150, 6)
    df = spatial.with_km(frame(spark, rows))
    one = {tuple(r) for r in cluster.dbscan(df, 5.0, 4).collect()}
    two = {tuple(r) for r in cluster.dbscan(df.orderBy(F.desc("cell_id")).repartition(5), 5.0, 4).collect()}
    assert one == two and any(c for _, c in one)


def test_splits(spark):
    rows = [(i, i % 50, i // 50, int(i % 9 == 0)) for i in range(900)]
    df = spark.createDataFrame(rows, "cell_id long, rw long, col long, high_risk int").withColumn("lat", 8.5 + F.col("rw") * 0.02).withColumn("lon", 117.2 + F.col("col") * 0.02).withColumn("block", split.block_of(F.col("rw"), F.col("col")))
    one = split.stratified(df)
    share = {r.high_risk: (r.t, r.n) for r in one.groupBy("high_risk").agg(F.count_if("is_test").alias("t"), F.count("*").alias("n")).collect()}
    assert all(t == n * 2 // 10 for t, n in share.values())
    two = split.spatial(df)
    assert two.groupBy("block").agg(F.countDistinct("is_test").alias("k")).where("k > 1").count() == 0
    three = split.buffer_exclusion(two, 3.0)
    assert three.where("NOT is_test").count() == two.where("NOT is_test").count() and three.count() < two.count()
    assert split.buffer_exclusion(two, 0).count() == 900


def test_neighbors_leave_out_the_cells_own_place(spark):
    rows = [(1, 10.0, 120.0, 1, 500), (2, 10.0, 120.0, 1, 300), (3, 10.02, 120.0, 0, 100)]
    df = spark.createDataFrame(rows, "cell_id long, lat double, lon double, pre_period_loss int, tc10 long")
    assert {tuple(r) for r in features.neighbor_features(df).collect()} == {(1, 1, 0, 100), (2, 1, 0, 100), (3, 2, 2, 800)}


def test_tiles_and_slope(spark):
    row = spark.range(1).select(*geo.tile_of(F.lit(0.0), F.lit(0.0)), geo.slope_degrees(F.lit(0.0), F.lit(10.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), 0.0).alias("flat")).first()
    assert (row[0], row[1], row.flat) == (2048, 2048, 0.0)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(None, 5), (400, 400)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 400: 400}


def test_nearest_on_the_whole_globe_by_brute_force(spark):
    """Across longitude 180, at the poles, and at places that nothing is near."""
    rng = random.Random(12)
    anywhere = lambda i: (i, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180))
    left = [anywhere(i) for i in range(150)] + [(900, 0.0, 179.99), (901, 90.0, 10.0), (902, -90.0, 0.0), (903, 89.9, -120.0), (904, 45.0, -180.0), (905, 45.0, 180.0)]
    right = [anywhere(i) for i in range(40)] + [(90, 0.0, -179.99), (91, 0.0, 179.93), (92, 89.95, 60.0), (93, -89.0, 179.0), (94, 44.9, 179.9)]
    got = {r.cell_id: r.km for r in spatial.nearest(frame(spark, left), frame(spark, right), "cell_id").collect()}
    for a in left:
        assert got[a[0]] == pytest.approx(min(haversine(a, b) for b in right), rel=1e-6, abs=1e-6)
    assert got[900] == pytest.approx(2.2239, abs=1e-3)


def test_dense_clusters_by_brute_force(spark):
    """Full squares, ones that touch by their outermost points and ones that don't, borders and noise; pairs stay few."""
    rng = random.Random(31)
    xy = [(rng.gauss(0, 0.4), rng.gauss(0, 0.4)) for _ in range(250)] + [(rng.gauss(2.6, 0.3), rng.gauss(0.2, 0.3)) for _ in range(120)]
    xy += [(rng.uniform(-6, 9), rng.uniform(-6, 6)) for _ in range(120)] + [(5.0, 5.0)] * 6
    for eps, least in ((0.5, 4), (0.9, 8), (0.25, 3)):
        rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
        near = {i: [j for j, u, v in rows if math.sqrt((x - u) ** 2 + (y - v) ** 2) <= eps] for i, x, y in rows}
        core = {i for i in near if len(near[i]) >= least}
        name = {}
        for i in sorted(core):
            if i not in name:
                todo = [i]
                while todo:
                    j = todo.pop()
                    if j not in name:
                        name[j] = i
                        todo += [k for k in near[j] if k in core]
        want = {i: name.get(i, min((name[j] for j in near[i] if j in core), default=None)) for i in near}
        got = cluster.dbscan(spark.createDataFrame(rows, "cell_id long, x double, y double"), eps, least).collect()
        assert {r.cell_id: r.cluster for r in got} == want


def test_exact_quantiles(spark):
    import numpy as np

    rng = random.Random(3)
    for values in ([rng.randint(0, 50) for _ in range(5000)], [rng.random() for _ in range(3001)], [7], [1, 2], [5] * 100 + [6], [-(2.0**70), 1.0, 3.0]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
        for q in (0.0, 0.25, 0.5, 0.75, 1.0):
            assert features.exact_quantile(df, "v", q).first()[0] == pytest.approx(float(np.percentile(values, q * 100)), rel=1e-12)
    assert features.exact_quantile(df.where("v IS NULL"), "v", 0.5).first()[0] is None


def test_nearest_never_sorts_pairs(spark, monkeypatch):
    """Pairs of rows and points around them are reduced by hash: a sort of them all took 9 GB of one task's memory at a million rows."""
    plans, real = [], spatial.materialize

    def watched(df, name, rows=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name, rows)

    monkeypatch.setattr(spatial, "materialize", watched)
    left = spark.range(300).select(F.col("id").alias("cell_id"), (F.col("id") % 20 * 0.02).alias("lat"), (F.col("id") / 20 * 0.02).alias("lon"))
    found = {r.cell_id: r.km for r in spatial.nearest(left, left.where("cell_id % 7 = 0").select("lat", "lon"), "cell_id").collect()}
    assert len(found) == 300 and found[7] == 0
    assert len(plans) > 1 and not any("SortAggregate" in p for p in plans)


@pytest.mark.parametrize("many", [False, True])
def test_nearest_of_a_crowd_looks_at_few_pairs(spark, monkeypatch, many):
    """1,024 places a kilometre's fifth apart, all within one cube of 0.1 degrees and those around it: a row used to meet every point. The same where points are too many to be sent."""
    met = spark.sparkContext.accumulator(0)

    def counted(*four):
        def one(lat, lon, r_lat, r_lon):
            met.add(1)
            p = math.sin(math.radians(r_lat - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(r_lat)) * math.sin(math.radians(r_lon - lon) / 2) ** 2
            return 2 * 6371.0 * math.asin(math.sqrt(p))

        return F.udf(one, "double")(*four)

    monkeypatch.setattr(spatial, "haversine_km", counted)
    if many:
        monkeypatch.setattr(spatial, "BROADCAST_BYTES", 0)
    places = [(i, 10.0 + i % 32 * 0.002, 120.0 + i // 32 * 0.002) for i in range(1024)]
    left = places[::8] + [(5000, -40.0, 10.0), (5001, 10.5, 120.5), (5002, 89.99, 0.0)]
    right = [(i, lat + 0.0003, lon) for i, lat, lon in places if i % 3]
    out = spatial.nearest(frame(spark, left), frame(spark, right), "cell_id")
    got = {r.cell_id: r.km for r in out.collect()}
    assert len(got) == len(left)
    for a in left:
        assert got[a[0]] == pytest.approx(min(haversine(a, b) for b in right), rel=1e-9)
    assert met.value < 100 * len(left) < len(left) * len(right) / 6


def test_nearest_of_many_points_on_the_whole_globe(spark, monkeypatch):
    """Points that are dealt to the cubes around them miss none: at poles, across longitude 180, on axes."""
    monkeypatch.setattr(spatial, "BROADCAST_BYTES", 0)
    rng = random.Random(7)
    right = [(i, math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for i in range(60)] + [(90, 0.0, 180.0), (91, 90.0, 0.0), (92, 0.0, 0.0), (93, 0.0, 90.0), (94, -90.0, 5.0)]
    left = [(i, max(-90.0, min(90.0, lat + rng.uniform(-0.06, 0.06))), lon + rng.uniform(-0.06, 0.06)) for i, lat, lon in right]
    got = {r.cell_id: r.km for r in spatial.nearest(frame(spark, left), frame(spark, right), "cell_id").collect()}
    for a in left:
        assert got[a[0]] == pytest.approx(min(haversine(a, b) for b in right), rel=1e-6, abs=1e-6)

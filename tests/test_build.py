"""A region built from landed inputs, and the synthetic table."""

from pyspark.sql import functions as F

from gridloom.functions.geo import pixel_of, tile_of
from gridloom.operators import build

BOX = (9.0, 9.19, 118.0, 118.19, 0.02)


def tiles(spark, **values):
    """Tiles under the box, each of one value a channel."""
    from gridloom.operators.spatial import grid

    x, y = tile_of(F.col("lat"), F.col("lon"))
    at = grid(spark, *BOX).select(F.lit(12).alias("z"), x.alias("x"), y.alias("y")).distinct()
    return at.select("z", "x", "y", *(F.array_repeat(F.lit(v), 65536).alias(k) for k, v in values.items()))


def test_region_from_landed_inputs(spark):
    roads = spark.createDataFrame([(9.1, 118.1)], "lat double, lon double")
    rings = spark.createDataFrame([(1, [(118.0, 9.0), (118.05, 9.0), (118.05, 9.05), (118.0, 9.05), (118.0, 9.0)])], "id long, ring array<struct<lon:double,lat:double>>")
    heights = spark.createDataFrame([(9.0, 118.0, 50.0)], "lat double, lon double, elevation_m double")
    people = spark.createDataFrame([(9.0, 118.0, 7.0)], "lat double, lon double, population double")
    before, after = tiles(spark, r=10.0, g=200.0, b=10.0), tiles(spark, r=200.0, g=10.0, b=10.0)
    out = build.build_region(spark, "here", BOX, tiles(spark, alpha=255, red=255, blue=5, cover=0), heights, roads, rings, people, before, after)
    rows = out.collect()
    assert len(rows) == 100 and {r.loss_year for r in rows} == {5} and {r.pre_period_loss for r in rows} == {1} and {r.high_risk for r in rows} == {0}
    assert {r.tree_cover_2000_pct for r in rows} == {25.0} and {r.dist_to_deforestation_frontier_km for r in rows} == {0.0}
    assert all(abs(r.annual_loss_rate_pct - 2 * 100 / 19) < 1e-9 for r in rows) and all(r.exg_change_2018_2019 < -1 for r in rows)
    first = next(r for r in rows if r.cell_id == 0)
    assert first.elevation_m == 50 and first.slope_deg > 0 and first.population_density_per_km2 == 700 and min(r.dist_to_road_km for r in rows) < 1.6
    water = build.build_region(spark, "sea", BOX, tiles(spark, alpha=0, red=0, blue=0, cover=0), heights, roads, rings, people)
    assert water.count() == 0


def test_chunks_cover_a_box(spark):
    rows = build.box_chunks(spark, 8.5, 10.8, 117.0, 119.0).collect()
    assert len(rows) == 6 and max(r.lat_max for r in rows) == 10.8 and min(r.lon_min for r in rows) == 117.0
    assert all(r.lat_max - r.lat_min <= 1 and r.lon_max - r.lon_min <= 1 for r in rows)
    assert len(build.box_chunks(spark, 1.0, 1.0, 2.0, 2.0).collect()) == 1


def test_synthetic_cells(spark):
    one = build.synthetic_cells(spark, (8.5, 10.5, 117.0, 119.0, 0.02))
    row = one.agg(F.count("*").alias("n"), F.avg("high_risk").alias("risk"), F.min("annual_loss_rate_pct").alias("lo"), F.max("annual_loss_rate_pct").alias("hi"), F.avg("elevation_m").alias("height")).first()
    assert row.n == 10_000 and 0.05 < row.risk < 0.3 and 0 <= row.lo < row.hi <= 15 and 240 < row.height < 260
    again = build.synthetic_cells(spark, (8.5, 10.5, 117.0, 119.0, 0.02)).repartition(7)
    assert one.exceptAll(again).count() == 0


def test_pixels_stay_inside(spark):
    px, py = pixel_of(F.lit(9.0), F.lit(179.9999999999))
    row = spark.range(1).select(px.alias("px"), py.alias("py")).first()
    assert 0 <= row.px <= 255 and 0 <= row.py <= 255

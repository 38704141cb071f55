"""Tables laid out by place: what is read, and that nothing else than what was asked is returned."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import spatial
from gridloom.sources import layout

ROWS = 40_000


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = [(i, rng.uniform(-20, 20), rng.uniform(100, 140)) for i in range(ROWS)] + [(ROWS, None, 120.0), (ROWS + 1, 3.0, None), (ROWS + 2, 95.0, 200.0), (ROWS + 3, -91.0, -181.0)]
    df = spark.createDataFrame(rows, "cell_id long, lat double, lon double").cache()
    path = f"{tmp_path_factory.mktemp('layout')}/cells"
    layout.write_layout(df, path, group_rows=100, file_rows=10_000)
    return df, path


def scanned(df):
    """Rows that the scan gave on, which are those of the row groups (and pages) that it read."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.head().metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("seed", range(6))
def test_box_equals_plain_filter(cells, spark, seed):
    df, path = cells
    rng = random.Random(seed)
    a, o, h, w = rng.uniform(-25, 20), rng.uniform(95, 140), rng.choice([0.0, 0.1, 4, 60]), rng.choice([0.0, 0.1, 4, 60])
    got = layout.read_box(spark, path, a, a + h, o, o + w)
    assert got.columns == df.columns
    assert sorted(r.cell_id for r in got.collect()) == sorted(r.cell_id for r in spatial.in_box(df, a, a + h, o, o + w).collect())


def test_all_rows_stay(cells, spark):
    df, path = cells
    assert spark.read.parquet(path).drop(layout.KEY).exceptAll(df).count() == 0 and spark.read.parquet(path).count() == df.count()


def test_small_box_reads_few_row_groups(cells, spark):
    """4 by 4 degrees of 40 by 40: 1 % of the rows from under 5 % of the row groups."""
    _, path = cells
    for a, o in ((-3.3, 111.1), (7.9, 131.7), (-16.2, 121.3)):
        read = scanned(layout.read_box(spark, path, a, a + 4, o, o + 4))
        assert 0 < read < 0.05 * ROWS


def test_nearest_reads_few_row_groups(cells, spark):
    df, path = cells
    for lat, lon in ((1.234, 120.5), (19.9, 139.9), (-60.0, 10.0), (89.0, 179.0), (0.0, 100.0)):
        got = layout.read_nearest(spark, path, lat, lon, "cell_id")
        assert got.collect() == spatial.nearest_cell(df.where("lat IS NOT NULL AND lon IS NOT NULL"), lat, lon).collect()
    near = layout.read_box(spark, path, 1.234 - 0.2, 1.234 + 0.2, 120.3, 120.7)
    assert scanned(near) < 0.02 * ROWS


def test_nearest_of_nothing(spark, tmp_path):
    layout.write_layout(spark.createDataFrame([(1, None, 2.0)], "cell_id long, lat double, lon double"), f"{tmp_path}/none")
    assert layout.read_nearest(spark, f"{tmp_path}/none", 0.0, 0.0, "cell_id").collect() == []


def test_ranges_hold_every_key_of_the_box(spark):
    rng = random.Random(3)
    for _ in range(20):
        a, o = rng.uniform(-90, 80), rng.uniform(-180, 170)
        h, w = rng.uniform(0, 10), rng.uniform(0, 10)
        ranges = layout.z_ranges(a, a + h, o, o + w)
        assert len(ranges) <= 4 * layout.MOST_RANGES and all(x[1] < y[0] for x, y in zip(ranges, ranges[1:]))
        points = [(rng.uniform(a, a + h), rng.uniform(o, o + w)) for _ in range(50)] + [(a, o), (a + h, o + w)]
        df = spark.createDataFrame(points, "lat double, lon double").select(layout.z_key(F.col("lat"), F.col("lon")).alias("k"))
        assert all(any(lo <= r.k <= hi for lo, hi in ranges) for r in df.collect())

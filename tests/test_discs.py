"""Sums over discs of a grid against pairs, and rounding against Python's."""

import math
import random

from pyspark.sql import functions as F

from gridloom.functions.rounding import present, round_binary
from gridloom.operators import discs

SCHEMA = "cell_id long, rw long, col long, lat double, lon double, a long, b long"


def grid(spark, rows, cols, keep=1.0, seed=1, step=0.02, move=(0, 0), lat0=8.5):
    rng = random.Random(seed)
    out = []
    for r in range(rows):
        for c in range(cols):
            if rng.random() < keep:
                i, j = r + move[0], c + move[1]
                out.append((len(out), i, j, lat0 + i * step, 117.2 + j * step, rng.choice([None, 0, 1, 7, -3]), rng.randrange(1000)))
    rng.shuffle(out)
    return spark.createDataFrame(out, SCHEMA)


def both(cells, radius=15.0, step=0.02):
    f = cells.agg(F.avg("lat").alias("m")).first()
    widths = discs.half_widths(f.m, step, radius)
    return sorted(map(tuple, discs._by_steps(cells, ["a", "b"], widths).collect())), sorted(map(tuple, discs._by_pairs(cells, ["a", "b"], radius).collect()))


def test_full_grid_over_several_squares(spark):
    got, want = both(grid(spark, 70, 140).cache())
    assert got == want and len(got) == 9800


def test_holes_negative_places_and_high_latitudes(spark):
    for keep, move, lat0, radius in ((0.3, (-40, -70), 8.5, 15.0), (0.7, (50, 60), 60.0, 9.0), (0.5, (0, 0), 0.0, 2.5), (1.0, (-3, -3), 8.5, 1.0)):
        got, want = both(grid(spark, 30, 60, keep, move=move, lat0=lat0).cache(), radius)
        assert got == want


def test_what_the_grid_cannot_tell_goes_by_pairs(spark):
    assert discs.half_widths(0.0, 0.02, 2.22 * 3) is None  # the third row lies on the edge
    cells = grid(spark, 8, 8).cache()
    want = sorted(map(tuple, discs._by_pairs(cells, ["a"], 6.66).collect()))
    assert sorted(map(tuple, discs.disc_sums(cells, ["a"], 6.66, 0.02).collect())) == want
    moved = cells.withColumn("lat", F.when(F.col("cell_id") == 5, F.col("lat") + 0.003).when(F.col("cell_id") != 9, F.col("lat")))  # one off the grid, one without a place
    got = sorted(map(tuple, discs.disc_sums(moved, ["a"], 5.0, 0.02).collect()))
    assert len(got) == 64 and got == sorted(map(tuple, discs._by_pairs(moved, ["a"], 5.0).collect())) and got[9] == (9, 0, 0)


def test_empty_alone_and_shared_places(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert discs.disc_sums(none, ["a"], 15.0, 0.02).collect() == []
    one = [(1, 0, 0, 8.5, 117.2, 4, 5)]
    assert [tuple(r) for r in discs.disc_sums(spark.createDataFrame(one, SCHEMA), ["a"], 15.0, 0.02).collect()] == [(1, 0, 0)]
    shared = one + [(2, 0, 0, 8.5, 117.2, 6, 5), (3, 0, 1, 8.5, 117.22, 100, 5)]
    got = {tuple(r) for r in discs.disc_sums(spark.createDataFrame(shared, SCHEMA), ["a"], 15.0, 0.02).collect()}
    assert got == {(1, 1, 100), (2, 1, 100), (3, 2, 10)}


def test_one_exchange_of_rows(spark):
    """Between the scan and the result rows are exchanged once, by square."""
    cells = grid(spark, 20, 20)
    plan = discs.disc_sums(cells, ["a"], 15.0, 0.02)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan and "SinglePartition" not in plan


def test_rounding_equals_python(spark):
    rng = random.Random(4)
    values = [2.675, 1.005, 0.5, 1.5, 2.5, -2.675, -0.001, 0.125, 0.375, -0.125, 0.0, -0.0, 1e300, -1e300, 4503599627370496.5, 9007199254740993.0, 5e-324, 1e15 + 0.3, math.inf, -math.inf]
    values += [rng.uniform(-1, 1) * 10 ** rng.randrange(-6, 18) for _ in range(20000)]
    values += [(2 * rng.randrange(10**7) + 1) / 2 / 10**d for d in (1, 2, 3, 4, 6) for _ in range(10000)]  # texts that end in a 5
    values += [rng.randrange(1 << 20) / 1024 for _ in range(20000)]  # true halves
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", *(round_binary(F.col("x"), d).alias(f"d{d}") for d in (0, 1, 2, 3, 4, 6, 15)))
    for row in df.collect():
        for d in (0, 1, 2, 3, 4, 6, 15):
            want = row.x if math.isinf(row.x) else round(row.x, d)
            assert row[f"d{d}"] == want and math.copysign(1, row[f"d{d}"]) == math.copysign(1, want), (row.x, d)


def test_rounding_of_nothing(spark):
    df = spark.createDataFrame([(None, 1), (math.nan, 2)], "x double, k int")
    got = {r.k: r.x for r in present(df, {"x": 2}).collect()}
    assert got[1] is None and math.isnan(got[2])


def test_what_a_task_adds_up_does_not_grow_with_the_cells(spark, monkeypatch):
    from gridloom.plans import shared

    cells = grid(spark, 40, 150).cache()
    want = sorted(map(tuple, discs._by_pairs(cells, ["a"], 5.0).collect()))
    monkeypatch.setattr(shared, "TASK_ROWS", 1000)
    sums = discs.disc_sums(cells, ["a"], 5.0, 0.02)
    assert sums.rdd.getNumPartitions() == 6 and sorted(map(tuple, sums.collect())) == want

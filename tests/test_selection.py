"""Exact quantiles by counting, against NumPy."""

import numpy as np
import pytest

from gridloom.operators.selection import exact_quantiles

QS = {"q0": 0.0, "q25": 0.25, "median": 0.5, "p75": 0.75, "q999": 0.999, "q1": 1.0}


def cases():
    rng = np.random.default_rng(3)
    yield rng.normal(size=501)
    yield rng.integers(0, 4, 300).astype(float)
    yield np.array([7.0])
    yield np.array([-1.7e308, 1.7e308, 5e-324, 0.0, -0.0])
    yield 10.0 ** rng.uniform(-300, 300, 400)  # where buckets of one width say little
    yield np.repeat([1.0, 1.0 + 2**-52, 2.0], 50)


@pytest.mark.parametrize("buckets", [32, None])
def test_groups(spark, buckets):
    groups = {None if i == 2 else f"g{i}": v for i, v in enumerate(cases())}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("g0", None), ("g1", float("nan")), ("g1", float("inf")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r for r in exact_quantiles(df, "x", QS, by=("g",), buckets=buckets).collect()}
    for g, v in groups.items():
        for name, q in QS.items():
            a, b = np.sort(v)[[int(np.floor(q * (len(v) - 1))), int(np.ceil(q * (len(v) - 1)))]]
            part = q * (len(v) - 1) - np.floor(q * (len(v) - 1))
            assert got[g][name] == a + (b - a) * part
    assert all(got["none"][name] is None for name in QS)


def test_whole_frame_and_nothing(spark):
    df = spark.range(1, 5).selectExpr("id AS v")
    assert [tuple(r) for r in exact_quantiles(df, "v", {"p": 0.75}).collect()] == [(3.25,)]
    assert [tuple(r) for r in exact_quantiles(df.where("v > 9"), "v", {"p": 0.75}).collect()] == [(None,)]
    assert exact_quantiles(df.where("v > 9"), "v", {"p": 0.75}, by=("v",)).count() == 0


def test_no_window_over_everything(spark):
    """The only order is among a span's buckets."""
    rows = spark.range(0, 5000).selectExpr("id * 7919 % 5000 AS v", "id % 3 AS g")
    plan = exact_quantiles(rows, "v", {"p": 0.5}, by=("g",))._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window" not in plan

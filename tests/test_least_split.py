"""Forests without splits that too few rows reach: against a walk over the node table of the forest as it was."""

import random

import pytest
from pyspark.ml import PipelineModel

from gridloom.operators import model
from gridloom.plans.shared import workdir

FEATURES = ["tree_cover_2000_pct", "elevation_m"]
LEAST = 12


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(5)
    rows = [(i, rng.random() * 100, rng.random() * 10, int(rng.random() < 0.3)) for i in range(400)]
    df = spark.createDataFrame(rows, f"cell_id long, {FEATURES[0]} double, {FEATURES[1]} double, high_risk int").cache()
    whole = model.fit(df, FEATURES, model.TrainRequest(trees=7, depth=9, min_split=2))
    return df, whole, PipelineModel([whole.stages[0], model.least_split(whole.stages[1], LEAST)])


def nodes(spark, forest):
    path = workdir(spark, "test-forest")
    forest.write().save(path)
    found = {}
    for r in spark.read.parquet(f"{path}/data").collect():
        found.setdefault(r.treeID, {})[r.nodeData.id] = r.nodeData
    return found


def walk(tree, row, least):
    node = tree[0]
    while node.leftChild >= 0 and node.rawCount >= least:
        node = tree[node.leftChild if row[FEATURES[node.split.featureIndex]] <= node.split.leftCategoriesOrThreshold[0] else node.rightChild]
    return node.impurityStats[1] / sum(node.impurityStats)


def test_scores_are_those_of_a_walk_that_stops(fitted, spark):
    df, whole, pruned = fitted
    trees = nodes(spark, whole.stages[1])
    for r in model.score(pruned, df).collect():
        assert r.p == pytest.approx(sum(walk(t, r, LEAST) for t in trees.values()) / len(trees), abs=1e-12)


def test_no_split_is_reached_by_fewer_rows(fitted, spark):
    _, whole, pruned = fitted
    before, after = nodes(spark, whole.stages[1]), nodes(spark, pruned.stages[1])
    inner = lambda trees: [n for t in trees.values() for n in t.values() if n.leftChild >= 0]
    assert any(n.rawCount < LEAST for n in inner(before)) and inner(after) and all(n.rawCount >= LEAST for n in inner(after))
    assert all(sorted(t) == list(range(len(t))) for t in after.values()) and len(after) == len(before)
    assert sum(pruned.stages[1].featureImportances) == pytest.approx(1)


def test_explanations_add_up(fitted):
    df, _, pruned = fitted
    some = df.where("cell_id < 20")
    got = {r.cell_id: r.base + sum(d.shap for d in r.drivers) for r in model.explain(pruned, some, FEATURES).collect()}
    want = {r.cell_id: r.p if r.p > 0.5 else 1 - r.p for r in model.score(pruned, some).collect()}
    assert got == pytest.approx(want, abs=1e-9) and len(got) == 20


def test_a_small_limit_changes_nothing_and_a_large_one_leaves_roots(fitted, spark):
    df, whole, _ = fitted
    assert model.least_split(whole.stages[1], 2) is whole.stages[1]
    roots = model.least_split(whole.stages[1], 10_000)
    assert all(len(t) == 1 for t in nodes(spark, roots).values())

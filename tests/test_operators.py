"""Labels, metrics, rasters, feedback, registry, models and streams: known answers and properties."""

import math
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.catalog import models
from gridloom.functions import scores
from gridloom.operators import evaluate, feedback, features, model, raster, registry, report
from gridloom.sources import schema, tables
from gridloom.streaming import events

SF = "/root/testdata/sf0.001"


def test_temporal_split_truth_table(spark):
    df = spark.createDataFrame([(0, 1), (5, 1), (19, 1), (20, 0), (22, 0)], "loss_year int, high_risk int")
    got = [(r.high_risk, r.pre_period_loss) for r in features.temporal_split(df).orderBy("loss_year").collect()]
    assert got == [(0, 0), (0, 1), (0, 1), (1, 0), (1, 0)]
    assert features.temporal_split(df.drop("loss_year")).columns == ["high_risk"]


@pytest.mark.parametrize("name", ["exg_change_2018_2022", "loss_year", "high_risk", "pre_period_loss"])
def test_banned_features(name):
    with pytest.raises(ValueError, match="not allowed"):
        schema.check_features(["slope_deg", name])
    assert schema.check_features(["slope_deg", "my own"]) == ["slope_deg", "my own"]


def test_excess_green(spark):
    rows = spark.createDataFrame([(0.0, 255.0, 0.0), (255.0, 0.0, 0.0), (128.0, 128.0, 128.0), (0.0, 0.0, 0.0)], "r double, g double, b double")
    got = [r[0] for r in rows.select(scores.excess_green(F.col("r"), F.col("g"), F.col("b"))).collect()]
    assert got[0] > 0.5 and got[1] < -0.5 and abs(got[2]) < 0.1 and got[3] == 0


def test_change_needs_both_dates(spark):
    kind = "z int, x int, y int, r array<double>, g array<double>, b array<double>"
    green, red = ([0.0] * 4, [200.0] * 4, [0.0] * 4), ([200.0] * 4, [0.0] * 4, [0.0] * 4)
    before = spark.createDataFrame([(12, 1, 1, *green), (12, 2, 1, *green), (12, 3, 1, *red)], kind)
    after = spark.createDataFrame([(12, 1, 1, *red), (12, 3, 1, *red), (12, 9, 9, *red)], kind)
    tiles = raster.tile_change(before, after)
    assert {(r.x, r.loss, r.gain) for r in tiles.collect()} == {(1, 4, 0), (3, 0, 0)}
    assert raster.total_change(tiles).first().loss == 4
    assert raster.total_change(tiles.limit(0)).first().loss_pct == 0


def test_metrics_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, int(rng.random() < 0.3), rng.randint(0, 10**6)) for i in range(500)]
    df = spark.createDataFrame(rows, "cell_id long, high_risk int, p6 long")
    best, first = 0.0, None
    for r in evaluate.threshold_sweep(df).orderBy("threshold").collect():
        t = r.threshold * 10_000
        tp = sum(y and p >= t for _, y, p in rows)
        fp = sum((not y) and p >= t for _, y, p in rows)
        fn = sum(y and p < t for _, y, p in rows)
        assert (r.tp, r.fp, r.fn) == (tp, fp, fn)
        f1 = 2 * tp / (2 * tp + fp + fn)
        assert r.f1 == pytest.approx(f1)
        if f1 > best:
            best, first = f1, r.threshold
    assert [r.threshold for r in evaluate.threshold_sweep(df).where("best").collect()] == [first]


def test_metrics_of_one_class_and_of_nothing(spark):
    df = spark.createDataFrame([(0, 0)] * 3, "high_risk int, predicted int")
    row = evaluate.metrics(df).first()
    assert (row.tn, row.precision, row.recall, row.f1, row.accuracy) == (3, 0, 0, 0, 1)
    assert evaluate.metrics(df.limit(0)).first().accuracy == 0
    assert evaluate.threshold_sweep(df.withColumn("p6", F.lit(5)).limit(0)).where("best").count() == 0
    assert evaluate.leakage_scan(df, ["predicted"]).first().r == 0
    assert evaluate.change_validation(df.withColumn("e", F.lit(0.1)), "e").first().valid is False


def annotation_log(spark):
    rows = [(1, 1, "r1", "accept", 10), (2, 2, "r1", "accept", 11), (3, 3, "r1", "reject", 12), (4, 1, "r1", "reject", 13), (5, 1, "r1", "accept", 9), (6, 1, "r2", "accept", 1)]
    return spark.createDataFrame(rows, "event_id long, cell_id long, run_id string, verdict string, updated_at long")


def test_feedback(spark):
    log = annotation_log(spark)
    current = feedback.latest(log)
    row = current.where("cell_id = 1 AND run_id = 'r1'").first()
    assert (row.verdict, row.updated_at, row.created_at) == ("reject", 13, 9)
    assert {tuple(r) for r in feedback.stats(current).collect()} == {("r1", 1, 2, 3), ("r2", 1, 0, 1)}
    with pytest.raises(Exception, match="unknown verdict"):
        feedback.check_verdicts(log.withColumn("verdict", F.lit("maybe"))).collect()
    placed = current.withColumn("lat", F.col("cell_id").cast("double")).withColumn("lon", F.lit(5.0))
    assert feedback.cell_verdict(placed, 2.0004, 5.0, "r1").first().cell_id == 2
    assert feedback.cell_verdict(placed, 99.0, 99.0, "r1").count() == 0


def test_overrides_in_both_orders(spark):
    cells = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 1)], "cell_id long, high_risk int")
    newest = {r.cell_id: (r.label, r.changes) for r in feedback.override_labels(cells, annotation_log(spark)).collect()}
    oldest = {r.cell_id: (r.label, r.changes) for r in feedback.override_labels(cells, annotation_log(spark), newest_wins=False).collect()}
    assert newest == {1: (0, 2), 2: (1, 0), 3: (0, 1), 4: (1, 0)}
    assert oldest[1] == (1, 2)


def test_registry(spark, tmp_path):
    root = str(tmp_path / "runs")
    a = registry.save_run(spark, root, {"n_estimators": 100, "max_depth": 10}, {"accuracy": 0.85, "f1": 0.82}, ["slope_deg"], "/m", [1, 2])
    b = registry.save_run(spark, root, {}, {"f1": 0.9}, [])
    assert [r.run_id for r in registry.list_runs(spark, root).collect()] == [b, a]
    assert registry.get_run(spark, root, a).test_ids == [1, 2] and len(a) == 8
    with pytest.raises(KeyError):
        registry.get_run(spark, root, "none")
    assert {r.metric: r.delta for r in registry.compare_runs(registry.list_runs(spark, root), a, b).collect()}["f1"] == pytest.approx(0.08)


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    assert registry.fingerprint(df).first() == registry.fingerprint(df.orderBy(F.desc("id")).repartition(7)).first()
    assert registry.fingerprint(df).first().hash != registry.fingerprint(df.withColumn("x", F.col("x") + 1)).first().hash


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_explanations_add_up(spark, tmp_path, kind):
    table = models.grid_table(spark, SF)
    request = model.TrainRequest(features=models.FEATURES, model_type=kind, trees=5, depth=4, spatial_split=False)
    run = model.train(table, request)
    told = model.explain(run["model"], run["tested"], run["features"]).join(run["model"].transform(run["tested"].drop("p", "p6", "predicted")), "cell_id").collect()
    assert len({r.predicted for r in told}) == 2 or kind == "boosted"
    assert told
    for r in told:
        total = r.base + sum(d.shap for d in r.drivers)
        want = r.probability[r.predicted] if kind == "forest" else r.rawPrediction[1]
        assert total == pytest.approx(want, abs=1e-6)
        assert [abs(d.shap) for d in r.drivers] == sorted((abs(d.shap) for d in r.drivers), reverse=True)
    model.save(run["model"], str(tmp_path / "m"))
    again = model.score(model.load(str(tmp_path / "m")), table).select("cell_id", "p6")
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in model.score(run["model"], table).select("cell_id", "p6").collect()}


def test_shapley_by_brute_force():
    """All orders of features over one tree."""
    from itertools import permutations

    inf = np.inf
    # x0 <= 1 (60 %): [x1 <= 2 (30 %): 0.9, else 0.1], else 0.4
    leaves = [(0.9, [(0, -inf, 1.0, 0.6), (1, -inf, 2.0, 0.3)]), (0.1, [(0, -inf, 1.0, 0.6), (1, 2.0, inf, 0.7)]), (0.4, [(0, 1.0, inf, 0.4)])]
    x = np.array([[0.5, 3.0, 7.0], [2.0, 1.0, 7.0]])

    def value(row, known):
        return sum(v * math.prod(float(lo < row[f] <= hi) if f in known else share for f, lo, hi, share in path) for v, path in leaves)

    base, got = model.shap_values(model.group_leaves(leaves), x)
    for row, mine in zip(x, got):
        want = np.zeros(3)
        for order in permutations(range(3)):
            for k, f in enumerate(order):
                want[f] += (value(row, order[: k + 1]) - value(row, order[:k])) / 6
        assert mine == pytest.approx(want) and base == pytest.approx(value(row, ()))


def test_training_metrics_and_regions(spark):
    table = models.grid_table(spark, "/root/testdata/sf0.01")
    request = model.TrainRequest(features=models.FEATURES, trees=8, depth=5)
    run = model.train(table, request)
    m = run["metrics"].first()
    assert m.tp + m.fp + m.fn + m.tn == run["tested"].count() and 0 < m.accuracy <= 1
    assert run["sweep"].count() == 16
    assert sum(r.importance for r in run["importances"].collect()) == pytest.approx(1)
    assert model.hold_out_region(table, "ASIA", request).first().accuracy > 0.3
    with pytest.raises(ValueError):
        model.train(table, model.TrainRequest(features=["high_risk"]))


def test_reports(spark):
    cells = spark.createDataFrame([(1, 10.0, 120.0, 0.95, 950_000, 1), (2, 10.5, 120.5, 0.2, 200_000, 0)], "cell_id long, lat double, lon double, p double, p6 long, predicted int")
    text = report.region_report(cells, "sierra_madre", cached={"narrative": "N"}).first().report
    assert '"region_name":"Sierra Madre"' in text and '"cached":true' in text and '"high":1' in text
    assert [r.finding for r in report.notable(cells).collect()] == ["Highest risk cell at (10.00, 120.00) with 95% probability", "Region has elevated risk: 50% of cells are high-risk"]
    assert report.notable(cells.where("predicted = 0")).count() == 0
    assert report.risk_distribution(cells.limit(0)).first().high_pct == 0
    said = spark.range(1).select(report.driver_sentence(F.lit("High risk"), F.expr("array(named_struct('feature', 'a', 'value', 1.5D, 'shap', 0.25D), named_struct('feature', 'b', 'value', 2.0D, 'shap', -0.5D))")).alias("t")).first().t
    assert said == "High risk — driven by: a (1.5, +0.2500), b (2.0, -0.5000)"


def test_sources(spark, tmp_path):
    cells = spark.createDataFrame([("palawan", 9.0, 118.0)], "region string, lat double, lon double")
    for f in schema.CELLS.fields[3:]:
        cells = cells.withColumn(f.name, F.lit(1).cast(f.dataType))
    tables.write_cells(cells, str(tmp_path / "all"))
    assert tables.read_cells(spark, str(tmp_path / "all"), "palawan").count() == 1
    with pytest.raises(FileNotFoundError):
        tables.read_cells(spark, str(tmp_path / "all"), "nowhere")
    cells.toPandas().to_csv(tmp_path / "one.csv", index=False)
    assert tables.read_cells(spark, path=str(tmp_path / "one.csv")).first().loss_year == 1
    assert tables.read_cells(spark, fallback=str(tmp_path / "all")).count() == 1
    (tmp_path / "map.json").write_text('{"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0}, {"type": "node", "id": 2}, {"type": "way", "id": 3, "nodes": [1, 2], "tags": {"highway": "track"}}]}')
    elements = tables.read_elements(spark, str(tmp_path / "map.json"))
    assert elements.count() == 3 and tables.road_nodes(elements).count() == 1
    (tmp_path / "fires.csv").write_text("latitude,longitude,confidence,frp\n10,120,h,5.5\n50,120,h,1\n")
    assert tables.read_fires(spark, str(tmp_path / "fires.csv")).count() == 1
    tables.write_brief(spark, str(tmp_path / "b" / "x.json"), {"narrative": "N"})
    assert tables.read_brief(spark, str(tmp_path / "b" / "x.json")) == {"narrative": "N"} and tables.read_brief(spark, str(tmp_path / "no.json")) is None


def test_streams_equal_batches(spark, tmp_path):
    shutil.copy(f"{SF}/events.parquet", tmp_path / "events.parquet")
    stream = events.read_events(spark, str(tmp_path))
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = events.run_once(events.windowed_counts(stream), "w1", "complete").select("start", "event_type", "n").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in events.windowed_counts(batch).select("start", "event_type", "n").collect()}
    slid = events.run_once(events.windowed_counts(stream, "1 hour", "30 minutes"), "w2", "complete")
    assert slid.agg(F.sum("n")).first()[0] == 2 * batch.count()
    assert events.run_once(events.distinct_events(stream), "w3").count() == batch.select("event_id").distinct().count()
    done = events.sessions(stream)
    assert done.isStreaming and events.sessions(batch).agg(F.sum("n")).first()[0] == batch.count()


def test_stream_of_verdicts_settles(spark, tmp_path):
    source, log = tmp_path / "in", tmp_path / "log"
    annotation_log(spark).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(annotation_log(spark).schema).parquet(str(source))
    fold = lambda df: feedback.latest(df).drop("created_at")
    for _ in range(2):
        events.settle(stream, str(log), str(tmp_path / "cp"), fold).awaitTermination()
    settled = feedback.latest(spark.read.parquet(str(log)).drop("epoch"))
    want = feedback.latest(annotation_log(spark))
    columns = ["cell_id", "run_id", "event_id", "verdict"]
    assert {tuple(r) for r in settled.select(columns).collect()} == {tuple(r) for r in want.select(columns).collect()}


def test_shapley_of_deep_trees_by_brute_force():
    """Random leaves of up to six features, all orders, a small bound on the arrays."""
    from itertools import permutations

    rng = np.random.default_rng(8)
    leaves = []
    for _ in range(12):
        features_ = rng.permutation(6)[: rng.integers(1, 7)]
        path = []
        for f in features_:
            lo, hi = sorted(rng.uniform(-2, 2, 2))
            path.append((int(f), float(lo), float(hi), float(rng.uniform(0.05, 0.95))))
        leaves.append((float(rng.uniform(-1, 1)), path))
    x = rng.uniform(-2, 2, (5, 6))

    def value(row, known):
        return sum(v * math.prod(float(lo < row[f] <= hi) if f in known else share for f, lo, hi, share in path) for v, path in leaves)

    bound, model.EXPLAIN_CELLS = model.EXPLAIN_CELLS, 1
    try:
        base, got = model.shap_values(model.group_leaves(leaves), x)
    finally:
        model.EXPLAIN_CELLS = bound
    orders = list(permutations(range(6)))
    for row, mine in zip(x, got):
        want = np.zeros(6)
        for order in orders:
            before = value(row, ())
            for k, f in enumerate(order):
                after = value(row, order[: k + 1])
                want[f] += (after - before) / len(orders)
                before = after
        assert mine == pytest.approx(want, abs=1e-9) and base == pytest.approx(value(row, ()))


def test_shapley_values_work_out_each_case_once(monkeypatch):
    """Many rows: what is worked out grows with the leaves' cases and not with the rows; every row has, bit for bit, the values that it has alone. Bounds, NaN and infinities included."""
    rng = np.random.default_rng(9)
    leaves = []
    for _ in range(20):
        path = []
        for f in rng.permutation(5)[: rng.integers(1, 6)]:
            lo, hi = sorted(rng.integers(-3, 4, 2).tolist())
            path.append((int(f), float(lo) if rng.random() < 0.7 else -np.inf, float(hi) if rng.random() < 0.7 else np.inf, float(rng.uniform(0.05, 0.95))))
        leaves.append((float(rng.uniform(-1, 1)), path))
    grouped = model.group_leaves(leaves)
    x = rng.integers(-4, 5, (2000, 5)).astype(float)
    x[0], x[1], x[2] = np.nan, np.inf, -np.inf

    worked = []
    product = model._adds
    monkeypatch.setattr(model, "_adds", lambda value, share, keeps: worked.append(len(value) * keeps[0].shape[-1]) or product(value, share, keeps))
    base, got = model.shap_values(grouped, x)
    assert sum(worked) == sum(1 << len(path) for _, path in leaves) < len(x) * len(leaves) / 20
    monkeypatch.setattr(model, "EXPLAIN_ROWS", 300)
    assert np.array_equal(model.shap_values(grouped, x)[1], got)
    assert all(np.array_equal(model.shap_values(grouped, x[i : i + 1])[1][0], got[i]) for i in range(60))
    total = [sum(v * all(lo < row[f] <= hi for f, lo, hi, _ in path) for v, path in leaves) for row in x]
    assert base + got.sum(axis=1) == pytest.approx(total)


def test_rows_to_explain_are_dealt_out(spark):
    """One file's rows become tasks of a shuffle's number, and rows without any give none."""
    table = models.grid_table(spark, SF)
    run = model.train(table, model.TrainRequest(features=models.FEATURES, trees=3, depth=3, spatial_split=False))
    one = run["tested"].coalesce(1)
    assert model.explain(run["model"], one, run["features"]).rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert model.explain(run["model"], one.where("false"), run["features"]).count() == 0


def test_a_run_is_kept_and_calibrated(spark, tmp_path):
    from pathlib import Path

    table = models.grid_table(spark, SF)
    request = model.TrainRequest(features=models.FEATURES, trees=4, depth=3, spatial_split=False)
    run = model.train_run(table, request, f"file://{tmp_path}")
    kept = registry.get_run(spark, f"file://{tmp_path}/runs", run["run_id"])
    tested = {r.cell_id: (r.p6, r.high_risk, r.predicted) for r in run["tested"].collect()}
    rows = registry.test_rows(table, f"file://{tmp_path}/runs", run["run_id"])
    assert kept.test_ids is None and {r.cell_id for r in rows.collect()} == set(tested) and len(kept.dataset_hash) == 16 and kept.features == models.FEATURES
    assert {"f1", "other_f1", "best_threshold"} <= set(kept.metrics) and run["recommended"] in ("primary", "alternative")
    params = {r.name: r.value for r in registry.run_params(registry.list_runs(spark, f"file://{tmp_path}/runs")).collect()}
    assert params["trees"] == "4" and params["recommended"] == run["recommended"]
    outcomes = {r.cell_id: (r.p6, r.outcome) for r in model.calibrate_run(table, f"file://{tmp_path}", run["run_id"]).collect()}
    word = {(1, 1): "tp", (0, 1): "fp", (1, 0): "fn", (0, 0): "tn"}
    assert outcomes == {i: (p6, word[label, said]) for i, (p6, label, said) in tested.items()}
    assert Path(kept.model_path.removeprefix("file://")).exists()


def test_fallback_and_roads(spark, tmp_path):
    cells = spark.createDataFrame([("palawan", 9.0, 118.0)], "region string, lat double, lon double")
    for f in schema.CELLS.fields[3:]:
        cells = cells.withColumn(f.name, F.lit(1).cast(f.dataType))
    tables.write_cells(cells, str(tmp_path / "spare"))
    assert tables.read_cells(spark, str(tmp_path / "none"), fallback=str(tmp_path / "spare")).count() == 1
    for bad in ({"root": str(tmp_path / "none")}, {"root": str(tmp_path / "none"), "region": "palawan", "fallback": str(tmp_path / "spare")}):
        with pytest.raises(FileNotFoundError):
            tables.read_cells(spark, **bad)
    (tmp_path / "map.json").write_text('{"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0}, {"type": "node", "id": 2, "lat": 3.0, "lon": 4.0}, {"type": "node", "id": 5, "lat": 9.0, "lon": 9.0}, {"type": "way", "id": 3, "nodes": [1], "tags": {"highway": "track"}}, {"type": "way", "id": 4, "nodes": [1, 2], "tags": {"highway": "footway"}}]}')
    assert [tuple(r) for r in tables.road_nodes(tables.read_elements(spark, str(tmp_path / "map.json"))).collect()] == [(1.0, 2.0)]
    people = spark.createDataFrame([(9.0, 118.0, 1.234)], "lat double, lon double, population double")
    assert tables.lookup_population(cells, people).first().population == pytest.approx(123.4)


def test_years_must_follow(spark):
    from gridloom.operators import raster

    with pytest.raises(ValueError):
        raster.change_between(spark.createDataFrame([], "year int, z int, x int, y int, r array<double>, g array<double>, b array<double>"), 2019, 2019)


def test_validation_of_few_points_says_why(spark):
    few = spark.createDataFrame([(-0.1, 1), (0.2, 0)], "e double, high_risk int")
    row = evaluate.change_validation(few, "e").first()
    assert not row.valid and row.reason == "Only 2 valid land points found"


def test_random_points_spread_over_the_box(spark):
    from gridloom.operators import raster

    rows = raster.random_points(spark, 8.0, 10.0, 117.0, 121.0, 400).collect()
    assert all(8 <= r.lat <= 10 and 117 <= r.lon <= 121 for r in rows)
    assert abs(np.mean([r.lat for r in rows]) - 9) < 0.1 and abs(np.mean([r.lon for r in rows]) - 119) < 0.2
    assert rows != raster.random_points(spark, 8.0, 10.0, 117.0, 121.0, 400, seed=7).collect()


def test_feature_table_follows_its_tables(spark, tmp_path):
    """Tables that are replaced between two queries of an application give other features."""
    import shutil

    from gridloom.catalog import models

    for t in ("customer", "orders", "nation", "region", "supplier"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", f"{tmp_path}/{t}.parquet")
    assert models.feature_table(spark, str(tmp_path)).count() == 150
    few = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").limit(40).toPandas()
    (tmp_path / "customer.parquet").unlink()
    few.to_parquet(f"{tmp_path}/customer.parquet")
    assert models.feature_table(spark, str(tmp_path)).count() == 40


def test_cells_are_not_exchanged_by_region(spark):
    cells = models.grid_table(spark, SF)
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the regions' size weren't known
    try:
        plan = features.annual_loss_rate(cells)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert "hashpartitioning(region" not in plan


def test_features_of_many_cells_come_in_parts_of_a_bounded_size(spark, monkeypatch):
    from gridloom.plans import shared
    from gridloom.sources import binding

    cells = shared.materialize(binding.cells(spark, SF).drop("p", "p6", "predicted"), "cells")
    found = []
    for least in (shared.TASK_ROWS, 20):
        monkeypatch.setattr(shared, "TASK_ROWS", least)
        table = features.screening_features(cells, binding.roads(spark, SF), binding.areas(spark, SF))
        found.append((table.rdd.getNumPartitions(), table.orderBy("cell_id").toPandas()))
    (few, a), (many, b) = found
    assert few <= 4 and many == -(-len(a) // 20)
    np.testing.assert_allclose(a.pop("loss_acceleration"), b.pop("loss_acceleration"), rtol=0, atol=1e-9)
    assert a.equals(b)


def test_training_rows_are_dealt_evenly_and_learnt_alike(spark, monkeypatch):
    """Whatever parts the rows come in, each core has its share and the same forest is learnt."""
    monkeypatch.setattr(model, "LEARN_FROM", 1)
    table = models.grid_table(spark, SF)
    rows = table.count()
    parts = model._evenly(table.coalesce(1), rows, "cell_id").rdd.glom().map(len).collect()
    assert len(parts) == spark.sparkContext.defaultParallelism and max(parts) < 2 * rows / len(parts)
    monkeypatch.setattr(model, "LEARN_ROWS", 10)
    assert model._evenly(table, rows, "cell_id").rdd.getNumPartitions() == 4 * -(-rows // 40)
    request = model.TrainRequest(trees=4, depth=4)
    trees = [model.fit(t, models.FEATURES, request).stages[-1].toDebugString.split("\n", 1)[1] for t in (table.coalesce(1), table.repartition(7, "elev10"))]
    assert trees[0] == trees[1]


def test_a_brief_scores_its_region_once(spark, monkeypatch):
    monkeypatch.setattr(models, "REQUEST", model.TrainRequest(trees=3, depth=3))
    brief = models.region_brief(spark, SF)
    plan = brief._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan and '"region_name":"Asia"' in brief.first().report

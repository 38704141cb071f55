"""Trained models, their explanation and the reports that need them. No SQL says what a model learns: tests check those queries' properties."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.catalog import query
from gridloom.operators import features, feedback, model, report
from gridloom.plans.shared import materialize, workdir
from gridloom.sources import binding, schema, tables
from gridloom.sources.binding import CELLS, cells

_FOUND = """found AS (SELECT {by} AS region, printf('Highest risk cell at (%.2f, %.2f) with %.0f%% probability', arg_max(lat, p6 * 1000000 - cell_id) FILTER (predicted = 1), arg_max(lon, p6 * 1000000 - cell_id) FILTER (predicted = 1), arg_max(p, p6 * 1000000 - cell_id) FILTER (predicted = 1) * 100) AS finding FROM cells GROUP BY 1 HAVING count(*) FILTER (predicted = 1) > 0
UNION ALL SELECT {by}, printf('Region has elevated risk: %.0f%% of cells are high-risk', 100.0::DOUBLE * CAST(sum(predicted) AS BIGINT) / count(*)) FROM cells GROUP BY 1 HAVING sum(predicted) > 0.3 * count(*))"""

FEATURES = ["tree_cover_2000_pct", "elevation_m", "annual_loss_rate_pct"]
REQUEST = model.TrainRequest()


def grid_table(spark, d) -> DataFrame:
    """Cells with three features by the names that the manifest knows, without joins."""
    c = cells(spark, d).drop("p", "p6", "predicted")
    rate = (F.col("pre_period_loss") * 2 + F.col("loss_year") % 5 + 0.5).cast("double")
    return c.withColumn("tree_cover_2000_pct", F.col("tc10") / 10.0).withColumn("elevation_m", F.col("elev10") / 10.0).withColumn("annual_loss_rate_pct", rate).withColumn("high_risk", F.col("high_risk").cast("int"))


#: Feature tables that this application has written, by the state of the tables that they come from.
_WRITTEN: dict[tuple[str, str], DataFrame] = {}
_FROM = ("customer", "orders", "nation", "region", "supplier")


def feature_table(spark, d) -> DataFrame:
    """Cells with all of the manifest's features that the tables give, written once for all queries of an application. Tables whose files change are read anew."""
    key = (spark.sparkContext.applicationId, tables.state(spark, *(f"{d}/{t}.parquet" for t in _FROM)))
    if key not in _WRITTEN or not tables.exists(spark, _WRITTEN[key]._written_at):
        c = materialize(cells(spark, d).drop("p", "p6", "predicted"), "cells")
        full = features.screening_features(c, binding.roads(spark, d), binding.areas(spark, d))
        _WRITTEN[key] = materialize(full.withColumn("high_risk", F.col("high_risk").cast("int")), "features")
    return _WRITTEN[key]


@query()
def train(spark, d):
    return model.train(feature_table(spark, d), REQUEST)["metrics"]


@query()
def train_boosted(spark, d):
    return model.train(feature_table(spark, d), model.TrainRequest(model_type="boosted", spatial_split=False, trees=20))["metrics"]


@query()
def train_run(spark, d):
    """Train, keep the run, and tell the outcomes of the rows that it was tested on."""
    table, root = feature_table(spark, d), workdir(spark, "runs")
    return model.calibrate_run(table, root, model.train_run(table, replace(REQUEST, trees=20, depth=6), root)["run_id"])


@query()
def feature_importance(spark, d):
    return model.train(feature_table(spark, d), REQUEST)["importances"]


@query()
def retrain(spark, d):
    c = feature_table(spark, d)
    labelled = feedback.override_labels(c, binding.verdicts(spark, d)).withColumn("high_risk", F.col("label").cast("int")).drop("label", "changes")
    return model.retrain(c, labelled, REQUEST)


@query()
def cross_region(spark, d):
    return model.hold_out_region(feature_table(spark, d), "ASIA", REQUEST)


@query()
def shap_explanation(spark, d):
    run = model.train(feature_table(spark, d), REQUEST)
    return model.explain(run["model"], run["tested"], run["features"])


@query()
def driver_text(spark, d):
    run = model.train(feature_table(spark, d), REQUEST)
    label = F.when(F.col("predicted") == 1, "High risk").otherwise("Low risk")
    return model.explain(run["model"], run["tested"], run["features"]).select("cell_id", report.driver_sentence(label, F.col("drivers")).alias("text"))


@query()
def site_driver(spark, d):
    from gridloom.operators.spatial import join_boxes

    run = model.train(feature_table(spark, d), REQUEST)
    sites = join_boxes(binding.boxes(spark), run["tested"]).where("cell_id IS NOT NULL").select("name", "cell_id")
    return model.site_drivers(model.explain(run["model"], run["tested"], run["features"]), sites)


@query("""SELECT count(*) AS cells, CAST(sum(predicted) AS BIGINT) AS high, CAST(count(*) - sum(predicted) AS BIGINT) AS low, 100.0::DOUBLE * CAST(sum(predicted) AS BIGINT) / count(*) AS high_pct, min(lat) AS lat_min, max(lon) AS lon_max,
(SELECT string_agg(cell_id, ',' ORDER BY p6 DESC, cell_id) FROM (SELECT cell_id, p6 FROM cells WHERE region = 'ASIA' AND predicted = 1 ORDER BY p6 DESC, cell_id LIMIT 5)) AS hotspots,
(SELECT string_agg(finding, '|' ORDER BY finding) FROM found WHERE region = 'ASIA') AS notable FROM cells WHERE region = 'ASIA'""", CELLS, _FOUND.format(by="region"))
def region_report(spark, d):
    """The parts of a region's report, of fixed scores."""
    r = report.report_parts(cells(spark, d).where("region = 'ASIA'"))
    dist, bounds = (F.col(c) for c in ("risk_distribution", "bounds"))
    told = F.array_join(F.transform("hotspots", lambda h: h["cell_id"].cast("string")), ",")
    return r.select(*(dist[c].alias(c) for c in ("cells", "high", "low", "high_pct")), bounds["lat_min"].alias("lat_min"), bounds["lon_max"].alias("lon_max"), told.alias("hotspots"), F.array_join(F.array_sort("notable"), "|").alias("notable"))


@query()
def region_brief(spark, d):
    """The report as one document, with a model's drivers and a cached narrative."""
    table = feature_table(spark, d)
    run = model.train(table, REQUEST)
    scored = materialize(model.score(run["model"], table.where("region = 'ASIA'")).drop(*run["features"]), "scored")  # read four times
    return report.region_report(scored, "ASIA", run["importances"], {"narrative": "A cached brief."})


@query("""SELECT cell_id, feature, CASE feature WHEN 'tree_cover_2000_pct' THEN tc10 / 10.0::DOUBLE WHEN 'elevation_m' THEN elev10 / 10.0::DOUBLE ELSE pre_period_loss * 2 + loss_year % 5 + 0.5::DOUBLE END AS value, source, CASE WHEN loss_year > 0 THEN 2000 + loss_year END AS year
FROM (SELECT * FROM cells ORDER BY (lat - 9.123) ** 2 + (lon - 117.456) ** 2, cell_id LIMIT 1), (VALUES ('tree_cover_2000_pct', 'Hansen/UMD GFW v1.7'), ('elevation_m', 'SRTM 30m'), ('annual_loss_rate_pct', 'Hansen GFW (pre-2020 loss)')) t(feature, source)""", CELLS)
def cell_detail(spark, d):
    from gridloom.operators.spatial import nearest_cell

    return report.cell_detail(nearest_cell(grid_table(spark, d), 9.123, 117.456), schema.manifest(spark), FEATURES)


@query()
def cell_explanation(spark, d):
    """A cell's features with what each adds to the class that the model predicts."""
    from gridloom.operators.spatial import nearest_cell

    table = feature_table(spark, d)
    run = model.train(table, REQUEST)
    cell = nearest_cell(table, 9.123, 117.456)
    return report.cell_detail(cell, schema.manifest(spark), run["features"], model.explain(run["model"], cell, run["features"]))


@query("SELECT finding FROM found", CELLS, _FOUND.format(by="'all'"))
def notable_findings(spark, d):
    return report.notable(cells(spark, d))
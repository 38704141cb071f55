"""Metrics of scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import query
from gridloom.functions.scores import ratio
from gridloom.operators import evaluate, model, report
from gridloom.sources.binding import CELLS, cells

_COUNTS = "counts AS (SELECT count(*) FILTER (high_risk = 1 AND predicted = 1) AS tp, count(*) FILTER (high_risk = 0 AND predicted = 1) AS fp, count(*) FILTER (high_risk = 1 AND predicted = 0) AS fn, count(*) FILTER (high_risk = 0 AND predicted = 0) AS tn FROM cells)"


@query("SELECT tp, fp, fn, tn, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS accuracy, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM counts", CELLS, _COUNTS)
def classification_metrics(spark, d):
    return evaluate.metrics(cells(spark, d))


@query("SELECT cell_id, CASE WHEN predicted = 1 THEN CASE WHEN high_risk = 1 THEN 'tp' ELSE 'fp' END ELSE CASE WHEN high_risk = 1 THEN 'fn' ELSE 'tn' END END AS outcome FROM cells", CELLS)
def calibration(spark, d):
    return cells(spark, d).select("cell_id", evaluate.outcome(F.col("high_risk"), F.col("predicted")).alias("outcome"))


_SWEEP = """steps AS (SELECT i * 5 + 10 AS threshold FROM range(0, 16) t(i)),
swept AS (SELECT threshold, count(*) FILTER (high_risk = 1 AND p6 >= threshold * 10000) AS tp, count(*) FILTER (high_risk = 0 AND p6 >= threshold * 10000) AS fp, count(*) FILTER (high_risk = 1 AND p6 < threshold * 10000) AS fn FROM cells, steps GROUP BY 1),
rated AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM swept)"""


@query("SELECT *, f1 > 0 AND row_number() OVER (ORDER BY f1 DESC, threshold) = 1 AS best FROM rated", CELLS, _SWEEP)
def threshold_sweep(spark, d):
    return evaluate.threshold_sweep(cells(spark, d))


@query("SELECT feature, CAST(floor(r * 1e6 + 0.5) AS BIGINT) AS r6, varies FROM (SELECT 'tc10' AS feature, corr(tc10, high_risk) AS r, stddev_pop(tc10) > 1e-10 AS varies FROM cells UNION ALL SELECT 'elev10', corr(elev10, high_risk), stddev_pop(elev10) > 1e-10 FROM cells UNION ALL SELECT 'pre_period_loss', corr(pre_period_loss, high_risk), stddev_pop(pre_period_loss) > 1e-10 FROM cells UNION ALL SELECT 'flat', 0.0, false)", CELLS)
def leakage_scan(spark, d):
    c = cells(spark, d).withColumn("flat", F.lit(1.0))
    return evaluate.leakage_scan(c, ["tc10", "elev10", "pre_period_loss", "flat"]).select("feature", F.floor(F.col("r") * 1e6 + 0.5).alias("r6"), "varies")


@query("""SELECT n, valid, CASE WHEN NOT valid THEN 'Only ' || n || ' valid land points found' END AS reason, tp, fp, fn, tn, CAST(floor(r * 1e6 + 0.5) AS BIGINT) AS r6, CAST(floor((2 * p * q / greatest(p + q, 0.001)) * 1e6 + 0.5) AS BIGINT) AS f16 FROM (SELECT *, tp::DOUBLE / greatest(tp + fp, 1) AS p, tp::DOUBLE / greatest(tp + fn, 1) AS q FROM
(SELECT count(*) AS n, count(*) >= 10 AS valid, corr(e, high_risk) AS r, count(*) FILTER (high_risk = 1 AND e < -0.05) AS tp, count(*) FILTER (high_risk = 0 AND e < -0.05) AS fp, count(*) FILTER (high_risk = 1 AND e >= -0.05) AS fn, count(*) FILTER (high_risk = 0 AND e >= -0.05) AS tn FROM (SELECT high_risk, (elev10 % 400 - 200) / 1000.0::DOUBLE AS e FROM cells WHERE cell_id % 7 > 0)))""", CELLS)
def exg_validation(spark, d):
    c = cells(spark, d).withColumn("e", F.when(F.col("cell_id") % 7 > 0, (F.col("elev10") % 400 - 200) / 1000.0))
    six = lambda x: F.floor(F.col(x) * 1e6 + 0.5).alias(f"{x}6")
    return evaluate.change_validation(c, "e").select("n", "valid", "reason", "tp", "fp", "fn", "tn", six("r"), six("f1"))


@query("SELECT high_risk AS label, n, (SELECT count(*) FROM cells)::DOUBLE / (2.0::DOUBLE * n) AS weight, (SELECT count(*) FROM cells WHERE high_risk = 0)::DOUBLE / greatest((SELECT count(*) FROM cells WHERE high_risk = 1), 1) AS boost FROM (SELECT high_risk, count(*) AS n FROM cells GROUP BY 1)", CELLS)
def class_weights(spark, d):
    return evaluate.class_weights(cells(spark, d))


_TWO = "two AS (SELECT (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS accuracy, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM counts), other AS (SELECT count(*) FILTER (high_risk = 1 AND p6 > 300000) AS tp, count(*) FILTER (high_risk = 0 AND p6 > 300000) AS fp, count(*) FILTER (high_risk = 1 AND p6 <= 300000) AS fn, count(*) FILTER (high_risk = 0 AND p6 <= 300000) AS tn FROM cells), new AS (SELECT (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS accuracy, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM other)"


@query("SELECT n.accuracy - o.accuracy AS accuracy_delta, n.precision - o.precision AS precision_delta, n.recall - o.recall AS recall_delta, n.f1 - o.f1 AS f1_delta FROM new n, two o", CELLS, _COUNTS, _TWO)
def retrain_delta(spark, d):
    c = cells(spark, d)
    return model.metric_delta(evaluate.metrics(c.withColumn("predicted", (F.col("p6") > 300000).cast("int"))), evaluate.metrics(c))


@query("SELECT n.f1 AS primary_f1, o.f1 AS other_f1, CASE WHEN n.f1 >= o.f1 THEN 'primary' ELSE 'alternative' END AS recommended FROM new n, two o", CELLS, _COUNTS, _TWO)
def model_comparison(spark, d):
    c = cells(spark, d)
    new = evaluate.metrics(c.withColumn("predicted", (F.col("p6") > 300000).cast("int"))).select(F.col("f1").alias("primary_f1"))
    both = new.crossJoin(evaluate.metrics(c).select(F.col("f1").alias("other_f1")))  # one row
    return both.withColumn("recommended", report.better_model(F.col("primary_f1"), F.col("other_f1")))


@query("SELECT region, CASE WHEN sum(p6) > 700000 * count(*) THEN 'critical' WHEN sum(p6) > 400000 * count(*) THEN 'elevated' ELSE 'moderate' END AS severity, coalesce(CAST(sum(high_risk) AS BIGINT)::DOUBLE / nullif(CAST(sum(predicted) AS BIGINT), 0), 0) AS share FROM cells GROUP BY 1", CELLS)
def region_severity(spark, d):
    from gridloom.functions.scores import severity

    rows = cells(spark, d).groupBy("region").agg(F.sum("p6").alias("s"), F.count("*").alias("n"), F.sum("high_risk").alias("h"), F.sum("predicted").alias("k"))
    return rows.select("region", severity(F.col("s") / F.col("n") / 1e6).alias("severity"), ratio(F.col("h"), F.col("k")).alias("share"))

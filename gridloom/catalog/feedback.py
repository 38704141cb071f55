"""Verdicts and the labels they change; the manifest's joins; runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import query
from gridloom.catalog.evaluation import _COUNTS, _TWO
from gridloom.operators import evaluate, feedback, registry, report
from gridloom.plans.shared import workdir
from gridloom.sources import binding, schema
from gridloom.sources.binding import CELLS, VERDICTS, cells, verdicts
from gridloom.sources.versions import VersionedLog
from gridloom.streaming import events

_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_id, run_id ORDER BY updated_at DESC, event_id DESC) AS k, min(updated_at) OVER (PARTITION BY cell_id, run_id) AS created_at FROM verdicts) WHERE k = 1)"


@query("SELECT cell_id, run_id, event_id, verdict, updated_at, created_at FROM latest", VERDICTS, _LATEST)
def annotation_upsert(spark, d):
    return feedback.latest(verdicts(spark, d)).select("cell_id", "run_id", "event_id", "verdict", "updated_at", "created_at")


@query("SELECT cell_id, run_id, event_id, verdict, updated_at, created_at FROM latest", VERDICTS, _LATEST)
def annotation_compacted(spark, d):
    """The state of a log with versions: rejects come after accepts, a compaction between them and one at the end."""
    log, v = VersionedLog(spark, workdir(spark, "verdict-log"), buckets=8), verdicts(spark, d)
    for verdict in ("accept", "reject"):
        log.append(v.where(F.col("verdict") == verdict))
        log.compact()
    return log.read().select("cell_id", "run_id", "event_id", "verdict", "updated_at", "created_at")


@query("SELECT run_id, count(*) FILTER (verdict = 'accept') AS accepted, count(*) FILTER (verdict = 'reject') AS rejected, count(*) AS total FROM latest GROUP BY 1", VERDICTS, _LATEST)
def annotation_stats(spark, d):
    return feedback.stats(feedback.latest(verdicts(spark, d)))


@query("SELECT event_id, cell_id, verdict FROM latest WHERE run_id = 'r1' ORDER BY updated_at DESC, event_id DESC LIMIT 50", VERDICTS, _LATEST)
def annotation_list(spark, d):
    return feedback.latest(verdicts(spark, d)).where("run_id = 'r1'").orderBy(F.desc("updated_at"), F.desc("event_id")).limit(50).select("event_id", "cell_id", "verdict")


@query("SELECT cell_id, verdict FROM latest WHERE run_id = 'r1' AND cell_id = (SELECT min(cell_id) FROM latest WHERE run_id = 'r1')", VERDICTS, _LATEST)
def annotation_cell(spark, d):
    current = feedback.latest(verdicts(spark, d)).join(cells(spark, d).select("cell_id", "lat", "lon"), "cell_id", "left")
    first = current.where("run_id = 'r1'").orderBy("cell_id").select("cell_id", "lat", "lon").first()
    return feedback.cell_verdict(current, first.lat, first.lon, "r1").select("cell_id", "verdict")


@query("SELECT event_id, verdict FROM verdicts WHERE verdict IN ('accept', 'reject')", VERDICTS)
def verdict_domain(spark, d):
    return feedback.check_verdicts(verdicts(spark, d)).select("event_id", "verdict")


@query("SELECT cell_id, abs(p6 - 500000) AS uncertainty FROM cells WHERE cell_id NOT IN (SELECT cell_id FROM latest WHERE run_id = 'r1') ORDER BY 2, 1 LIMIT 10", CELLS, VERDICTS, _LATEST)
def suggest_annotations(spark, d):
    return feedback.suggest(cells(spark, d), feedback.latest(verdicts(spark, d)).where("run_id = 'r1'")).select("cell_id", "uncertainty")


@query("SELECT count(*) AS open_cells FROM cells WHERE cell_id NOT IN (SELECT cell_id FROM latest)", CELLS, VERDICTS, _LATEST)
def unannotated_total(spark, d):
    return cells(spark, d).join(feedback.latest(verdicts(spark, d)).select("cell_id").distinct(), "cell_id", "left_anti").agg(F.count("*").alias("open_cells"))


def _override(order: str) -> str:
    return f"""SELECT c.cell_id, coalesce(CASE last WHEN 'accept' THEN 1::BIGINT WHEN 'reject' THEN 0 END, c.high_risk) AS label, coalesce(changes, 0) AS changes FROM cells c LEFT JOIN
(SELECT cell_id, arg_max(verdict, place) AS last, count(*) FILTER (verdict = 'reject' OR (before IS NULL AND high_risk = 0) OR before = 'reject') AS changes FROM
(SELECT v.*, c.high_risk, lag(verdict) OVER w AS before, row_number() OVER w AS place FROM verdicts v JOIN cells c USING (cell_id) WINDOW w AS (PARTITION BY cell_id ORDER BY updated_at {order}, event_id {order})) GROUP BY 1) USING (cell_id)"""


@query(_override("ASC"), CELLS, VERDICTS)
def apply_annotations(spark, d):
    return feedback.override_labels(cells(spark, d), verdicts(spark, d)).select("cell_id", F.col("label").cast("long").alias("label"), "changes")


@query(_override("DESC"), CELLS, VERDICTS)
def apply_annotations_oldest(spark, d):
    """The order of processing that lets the oldest verdict win."""
    return feedback.override_labels(cells(spark, d), verdicts(spark, d), newest_wins=False).select("cell_id", F.col("label").cast("long").alias("label"), "changes")


@query("SELECT event_id, cell_id FROM verdicts WHERE cell_id IN (SELECT cell_id FROM cells)", CELLS, VERDICTS)
def match_annotations(spark, d):
    """Entries matched to cells by place: each stands a little off its cell."""
    c = cells(spark, d)
    marks = verdicts(spark, d).join(c.select("cell_id", "lat", "lon"), "cell_id").select("event_id", (F.col("lat") + 0.0004).alias("lat"), (F.col("lon") - 0.0004).alias("lon"))
    return feedback.match_cells(c, marks).select("event_id", "cell_id")


@query("SELECT event_id FROM verdicts WHERE cell_id IN (SELECT cell_id FROM cells WHERE region = 'ASIA')", CELLS, VERDICTS)
def annotation_region(spark, d):
    c = cells(spark, d)
    marks = verdicts(spark, d).join(c.select("cell_id", "lat", "lon"), "cell_id")
    return feedback.in_region(marks, c.where("region = 'ASIA'")).select("event_id")


@query("SELECT cell_id, f AS feature, CASE f WHEN 'tree_cover_2000_pct' THEN tc10 / 10.0::DOUBLE WHEN 'high_risk' THEN high_risk ELSE rw END AS value, s AS source, CASE WHEN loss_year > 0 THEN 2000 + loss_year END AS year FROM cells, (VALUES ('tree_cover_2000_pct', 'Hansen/UMD GFW v1.7'), ('high_risk', 'Target variable'), ('rw', '')) t(f, s)", CELLS)
def feature_provenance(spark, d):
    """Every cell's features with their sources, an empty one where the manifest has none."""
    c = cells(spark, d).withColumn("tree_cover_2000_pct", F.col("tc10") / 10.0)
    return report.cell_detail(c, schema.manifest(spark), ["tree_cover_2000_pct", "high_risk", "rw"])


@query("SELECT metric, a, b, b - a AS delta FROM (SELECT 'f1' AS metric, o.f1 AS a, n.f1 AS b FROM new n, two o UNION ALL SELECT 'recall', o.recall, n.recall FROM new n, two o)", CELLS, _COUNTS, _TWO)
def run_compare(spark, d):
    """Two thresholds' metrics saved as runs, listed and compared."""
    root, c, ids = workdir(spark, "runs"), cells(spark, d), []
    for least in (500_000, 300_000):
        m = evaluate.metrics(c.withColumn("predicted", (F.col("p6") > least).cast("int"))).first()
        ids.append(registry.save_run(spark, root, {"least": least}, {"f1": m.f1, "recall": m.recall}, ["p6"]))
    return registry.compare_runs(registry.list_runs(spark, root), *ids)


@query("SELECT p_partkey AS run_id, name, value FROM (SELECT p_partkey, CAST(p_size AS VARCHAR) AS depth, p_brand AS model FROM part) UNPIVOT (value FOR name IN (depth, model))")
def run_parameters(spark, d):
    """The parameters of runs, kept as JSON, as rows: a run for each part."""
    runs = binding.table(spark, d, "part").select(F.col("p_partkey").alias("run_id"), F.to_json(F.struct(F.col("p_size").alias("depth"), F.col("p_brand").alias("model"))).alias("params"))
    return registry.run_params(runs)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext_window_counts(spark, d):
    """Extension: tumbling counts, here over the table; the stream gives the same (tests)."""
    e = binding.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.windowed_counts(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def ext_sessions(spark, d):
    """Extension: a user's sessions."""
    e = binding.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.sessions(e).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")

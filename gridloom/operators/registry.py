"""Training runs as an append-only table."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "run_id string, created_at timestamp, params string, metrics map<string,double>, features array<string>, model_path string, test_ids array<bigint>, dataset_hash string"


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """(rows, hash): the same for the same rows in any order; sums and exclusive ors of row hashes, so no sort."""
    h = F.xxhash64(*(columns or df.columns))
    return df.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).cast("binary"), 256).alias("h")).select("rows", F.substring("h", 1, 16).alias("hash"))


def save_run(spark: SparkSession, root: str, params: dict, metrics: dict[str, float], features: list[str], model_path: str = "", test_ids: list[int] | DataFrame | None = None, dataset_hash: str = "") -> str:
    """Append a run. Test rows are a short list, kept in the run's row, or a table of cell_id of any size, written beside the runs before the row that
    makes the run known."""
    run_id = uuid.uuid4().hex[:8]
    if isinstance(test_ids, DataFrame):
        test_ids.select(F.col("cell_id").cast("long")).write.parquet(_test_table(root, run_id))
        test_ids = None
    row = (run_id, datetime.now(timezone.utc), json.dumps(params), metrics, features, model_path, test_ids, dataset_hash)
    spark.createDataFrame([row], RUN).write.mode("append").parquet(root)
    return run_id


def _test_table(root: str, run_id: str) -> str:
    return f"{root.rstrip('/')}-test-rows/run_id={run_id}"


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """Newest first; runs written before a column existed have null there."""
    return spark.read.option("mergeSchema", True).schema(RUN).parquet(root).orderBy(F.desc("created_at"), "run_id")


def get_run(spark: SparkSession, root: str, run_id: str):
    row = list_runs(spark, root).where(F.col("run_id") == run_id).first()
    if row is None:
        raise KeyError(run_id)
    return row


def compare_runs(runs: DataFrame, a: str, b: str) -> DataFrame:
    """(metric, a, b, delta) of two runs."""
    of = lambda run, name: runs.where(F.col("run_id") == run).select(F.explode("metrics").alias("metric", name))
    return of(a, "a").join(of(b, "b"), "metric", "full").withColumn("delta", F.col("b") - F.col("a"))


def run_params(runs: DataFrame) -> DataFrame:
    """(run_id, name, value): the parameters of runs, as text, from their JSON."""
    return runs.select("run_id", F.explode(F.from_json("params", "map<string,string>")).alias("name", "value"))


def test_rows(cells: DataFrame, root: str, run_id: str) -> DataFrame:
    """The rows of ``cells`` that a run of the run table at ``root`` was tested on."""
    spark = cells.sparkSession
    kept = get_run(spark, root, run_id).test_ids
    ids = spark.read.parquet(_test_table(root, run_id)).select("cell_id") if kept is None else spark.createDataFrame([(i,) for i in kept], "cell_id long")
    return cells.join(ids, "cell_id", "left_semi")

"""Landing of chunks with a ledger: what is done stays done, what fails is named and tried again, lines that don't parse are kept apart.

A pass fetches the chunks that aren't done, writes their rows, and at last its ledger (chunk, status, error, counts). Rows count only if the ledger names their pass, so
a pass that dies before its end leaves nothing behind that is read, and the next one takes its chunks up again. A chunk that two passes landed at once counts from the first.

Defined results: a null chunk name is the empty name; null and blank lines are no rows; a chunk without lines is done with none; repeated lines are rows of their own;
if any of a chunk's rows holds an error the chunk has failed and none of its lines count; a line that doesn't fit the schema is a dead letter, whole, whatever its length; an empty table
of chunks lands nothing; other columns of ``chunks`` reach ``fetch`` under their own names, and those of the rows are kept in one struct, so none can clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.plans.shared import materialize, release, small_side

LEDGER = "chunk string, status string, error string, rows long, dead long, at timestamp, pass string"
_BAD = "__unparsed"


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """(chunk, status, attempts, error, rows, dead, pass) of every chunk that was tried: done or failed, the last error of what failed, and the pass whose rows count."""
    tried = _table(spark, f"{root}/ledger", T._parse_datatype_string(LEDGER))
    done = F.col("status") == "done"
    first = F.min_by(F.struct("rows", "dead", "pass"), F.when(done, F.struct("at", "pass")))
    state = tried.groupBy("chunk").agg(F.count("*").alias("attempts"), first.alias("kept"), F.max(done).alias("done"), F.max_by("error", F.struct("at", "pass")).alias("error"))
    status = F.when(F.col("done"), "done").otherwise("failed").alias("status")
    return state.select("chunk", status, "attempts", F.when(~F.col("done"), F.col("error")).alias("error"), "kept.rows", "kept.dead", "kept.pass")


def pending(chunks: DataFrame, root: str, attempts: int = 3) -> DataFrame:
    """The rows of ``chunks`` (chunk, ...) that aren't done and were tried less than ``attempts`` times."""
    settled = ledger(chunks.sparkSession, root).where((F.col("status") == "done") | (F.col("attempts") >= attempts)).select(F.col("chunk").alias("__settled"))
    return chunks.join(settled, F.coalesce("chunk", F.lit("")) == F.col("__settled"), "left_anti")


def fetch_lines(chunks: DataFrame, fetch: Callable[[dict], Iterable[str]]) -> DataFrame:
    """(chunk, line, error): what ``fetch`` gives for each row of ``chunks``; an exception is its chunk's error, and the others go on."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                lines, error = [None], None  # the null line tells that the chunk was looked at
                try:
                    lines += list(fetch(row))
                except Exception as problem:  # noqa: BLE001  whatever a service does, it is named in the ledger
                    lines, error = [None], f"{type(problem).__name__}: {problem}"
                columns = [pa.array([row["chunk"]] * len(lines), pa.string()), pa.array(lines, pa.string()), pa.array([error] * len(lines), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "line", "error"])

    return chunks.mapInArrow(run, "chunk string, line string, error string")


def land(lines: DataFrame, schema: str, root: str, fmt: str = "json", options: dict[str, str] | None = None) -> None:
    """One pass over ``lines`` (chunk, line, error), JSON or CSV of ``schema``: rows and dead letters first, then the ledger."""
    parse = {"json": F.from_json, "csv": F.from_csv}[fmt]
    run = uuid.uuid4().hex
    held = materialize(lines.select(F.coalesce("chunk", F.lit("")).alias("chunk"), "line", "error"), "landing")  # fetched once
    chunks = materialize(held.groupBy("chunk").agg(F.max("error").alias("error")), "landing-chunks")
    good = held.where("trim(line) <> ''").join(small_side(chunks.where("error IS NULL").select("chunk")), "chunk")
    record = parse("line", f"{schema}, {_BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD, **(options or {})})
    bad = F.col("record").isNull() | F.col(f"record.{_BAD}").isNotNull()
    parsed = good.withColumn("record", record).select("chunk", F.when(~bad, F.col("record").dropFields(_BAD)).alias("record"), F.when(bad, F.col("line")).alias("dead"))
    parsed.write.parquet(f"{root}/rows/pass={run}")
    written = lines.sparkSession.read.schema("chunk string, dead string").parquet(f"{root}/rows/pass={run}")
    counts = written.groupBy("chunk").agg(F.count(F.when(F.col("dead").isNull(), 1)).alias("rows"), F.count("dead").alias("dead"))
    _record(chunks.join(counts, "chunk", "left"), f"{root}/ledger/pass={run}")
    release(held, chunks)


def _record(counted: DataFrame, path: str) -> None:
    status = F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status")
    counts = (F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("rows", "dead"))
    counted.select("chunk", status, "error", *counts, F.current_timestamp().alias("at")).write.parquet(path)


def _counted(spark: SparkSession, schema: str, root: str) -> DataFrame:
    fields = [T.StructField("chunk", T.StringType()), T.StructField("record", T._parse_datatype_string(schema)), T.StructField("dead", T.StringType()), T.StructField("pass", T.StringType())]
    done = ledger(spark, root).where("status = 'done'").select("chunk", "pass")
    return _table(spark, f"{root}/rows", T.StructType(fields)).join(done, ["chunk", "pass"])


def landed(spark: SparkSession, schema: str, root: str) -> DataFrame:
    """(chunk, record) of all chunks that are done."""
    return _counted(spark, schema, root).where("dead IS NULL").select("chunk", "record")


def dead_letters(spark: SparkSession, schema: str, root: str) -> DataFrame:
    """(chunk, line) of the lines that didn't parse."""
    return _counted(spark, schema, root).where("dead IS NOT NULL").select("chunk", F.col("dead").alias("line"))

"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """URI of the cluster's shared folder: ``spark.checkpoint.dir``. Only where that is unset and all tasks run in the driver's process
    (tests, a laptop) does the library set a folder of its own; on a cluster it refuses to, as executors wouldn't share it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = jvm_dir.get() if jvm_dir.isDefined() else None
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir isn't set; it must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(root)
        atexit.register(_remove, root)
    return root.rstrip("/") if "://" in root or root.startswith("file:/") else "file://" + root.rstrip("/")


def _remove(root: str) -> None:
    import shutil

    shutil.rmtree(root.removeprefix("file://"), ignore_errors=True)


def workdir(spark: SparkSession, name: str) -> str:
    """A fresh folder URI under the shared root; nobody else writes to it."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Short rows that a file should have at least, where their number is known.
FILE_ROWS = 100_000


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends at files that
    every executor sees, so a lost executor costs a re-read and never a recomputation.
    With ``rows``, a bound on its rows, a small table is written as few files."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, rows // FILE_ROWS))
    path = workdir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


#: Bytes that one side of a join may have, as ``small_side`` reckons them, to be sent to every executor.
BROADCAST_BYTES = 32 << 20


def small_side(df: DataFrame, more: Column | None = None) -> DataFrame:
    """``df``, a written table, with a broadcast hint if its rows, 64 bytes each and ``more`` (a column of bytes) besides, come to BROADCAST_BYTES at most; else
    both sides of the join are shuffled."""
    size = df.agg(F.count("*") * 64 + F.coalesce(F.sum(F.lit(0) if more is None else more), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


#: Rows that a task should have at most on average where it keeps them in memory, to sort or to add up.
TASK_ROWS = 150_000


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` in parts by ``by`` of TASK_ROWS each, of the ``rows`` that count, so that what a task keeps doesn't grow with them; as it is if they are few for the cores that there are."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *by) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing will read again."""
    for table in tables:
        if path := getattr(table, "_written_at", None):
            drop_path(table.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared root, on whatever file system it is."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)

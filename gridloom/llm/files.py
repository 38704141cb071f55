"""File access from tasks: any URI that pyarrow resolves (file, hdfs, s3, gs)."""

from __future__ import annotations

from gridloom.plans.shared import small_side  # noqa: F401


def open_fs(uri: str):
    """(file system, path) of a URI."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    system, path = open_fs(uri)
    system.create_dir(path, recursive=True)


#: Rows of whole text that Spark hands a Python worker at once; its own default would hold tens of MB in each of several buffers.
TEXT_ROWS = 500


def tidied(f):
    """The batch function ``f``, which gives memory back at its task's end: workers live on, and their allocators would keep what the task once held."""

    def run(batches):
        import ctypes
        import gc

        import pyarrow as pa

        yield from f(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return run


def limit_batches(spark) -> None:
    """Lower the session's Arrow batches to TEXT_ROWS rows, where they are larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def text_batches(df, f, schema):
    """``df.mapInArrow(f, schema)`` for rows of whole texts."""
    limit_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


#: Tasks for rows that each stand for much work; beyond it, a task has several.
MOST_TASKS = 20_000
#: Bytes of files that a task reads, where it can choose.
TASK_BYTES = 16 << 20


def one_task_each(df, tasks: int):
    """``df``, short rows that stand for ``tasks`` tasks' work, dealt evenly. A number is given, as adaptive execution would join partitions by their bytes."""
    return df.repartition(max(1, min(tasks, MOST_TASKS)))

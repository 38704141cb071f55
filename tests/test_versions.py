"""The versioned log: the state equals that of the whole log, whatever the order of appends, compactions and races."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from gridloom.operators import feedback
from gridloom.sources.versions import Conflict, VersionedLog

SCHEMA = "event_id long, cell_id long, run_id string, verdict string, updated_at timestamp"


def entries(spark, first, n, seed=0, cells=40):
    rng = random.Random(seed)
    rows = [(first + i, rng.choice([None, *range(cells)]), rng.choice(["a", "b", None]), rng.choice(["accept", "reject"]), rng.randrange(1000)) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA.replace("updated_at timestamp", "t long")).withColumn("updated_at", F.timestamp_seconds("t")).drop("t")


def state(df):
    return sorted(map(repr, df.select("cell_id", "run_id", "event_id", "verdict", "updated_at", "created_at").collect()))


def test_state_is_that_of_the_whole_log(spark, tmp_path):
    log, whole = VersionedLog(spark, f"{tmp_path}/log", buckets=4), None
    assert log.read() is None and log.compact() == 0
    for k in range(5):
        more = entries(spark, 1000 - 100 * k, 60, k).cache()
        whole = more if whole is None else whole.union(more)
        log.append(more)
        if k in (1, 3):
            before = log.manifest()
            log.compact()
            assert before["deltas"] and not log.manifest()["deltas"]
        assert state(log.read()) == state(feedback.latest(whole))
    assert state(log.read(2)) == state(feedback.latest(entries(spark, 1000, 60, 0).union(entries(spark, 900, 60, 1))))
    assert log.append(entries(spark, 0, 0)) == 7 and log.vacuum(2) == 5
    assert state(log.read()) == state(feedback.latest(whole)) and log.versions() == [6, 7]
    with pytest.raises(KeyError):
        log.manifest(2)


def test_compaction_rewrites_only_what_changed(spark, tmp_path):
    log = VersionedLog(spark, f"{tmp_path}/log", buckets=16)
    log.append(entries(spark, 0, 200))
    log.compact()
    base = log.manifest()["base"]
    log.append(entries(spark, 500, 1))
    log.compact()
    now = log.manifest()["base"]
    assert sum(base[b] != now[b] for b in base) == 1 and len(base) == len(now)


def test_racing_writers_lose_nothing(spark, tmp_path):
    root = f"{tmp_path}/log"
    parts = [entries(spark, 100 * k, 20, k).cache() for k in range(8)]
    with ThreadPoolExecutor(8) as pool:
        versions = list(pool.map(lambda p: VersionedLog(spark, root, buckets=2).append(p), parts))
    assert sorted(versions) == list(range(1, 9))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    assert state(VersionedLog(spark, root).read()) == state(feedback.latest(whole))


def test_appends_during_a_compaction_stay(spark, tmp_path):
    log, a, b = VersionedLog(spark, f"{tmp_path}/log", buckets=2), entries(spark, 0, 30, 1).cache(), entries(spark, 100, 30, 2).cache()
    log.append(a)
    write = log._write

    def meanwhile(rows):
        log._write = write
        log.append(b)
        return write(rows)

    log._write = meanwhile
    log.compact()
    assert len(log.manifest()["deltas"]) == 1 and state(log.read()) == state(feedback.latest(a.union(b)))

    def second(rows):
        log._write = write
        log.compact()
        return write(rows)

    log._write = second
    with pytest.raises(Conflict):
        log.compact()
    assert state(log.read()) == state(feedback.latest(a.union(b)))


def test_an_append_that_fails_leaves_no_trace(spark, tmp_path):
    log = VersionedLog(spark, f"{tmp_path}/log", buckets=2)
    log.append(entries(spark, 0, 10))
    with pytest.raises(Exception):
        log.append(entries(spark, 50, 10).withColumn("verdict", F.raise_error(F.lit("lost")).cast("string")))
    assert log.versions() == [1] and state(log.read()) == state(feedback.latest(entries(spark, 0, 10)))


def test_new_columns_are_null_in_old_rows(spark, tmp_path):
    log = VersionedLog(spark, f"{tmp_path}/log", buckets=1)
    log.append(entries(spark, 0, 10, cells=3))
    log.append(entries(spark, 100, 3, cells=1).withColumn("note", F.lit("seen")))
    assert {r.note for r in log.read().collect()} == {None, "seen"}

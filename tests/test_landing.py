import pytest

from gridloom.sources import landing

SCHEMA = "id long, name string"


def service():
    def fetched(row):  # nested, so that workers needn't import this file
        if row["fails"]:
            raise OSError("no answer")
        return row["lines"]

    return fetched


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk string, lines array<string>, fails boolean")


def state(spark, root):
    return {r.chunk: (r.status, r.attempts, r.error, r.rows, r.dead) for r in landing.ledger(spark, root).collect()}


def values(spark, root):
    return sorted(((r.chunk, r.record.id, r.record.name) for r in landing.landed(spark, SCHEMA, root).collect()), key=lambda v: v[:2])


def a_pass(spark, rows, root, **kw):
    landing.land(landing.fetch_lines(landing.pending(chunks(spark, rows), root, **kw), service()), SCHEMA, root)


GOOD = ("a", ['{"id": 1, "name": "x"}', '{"id": 1, "name": "x"}', "", None, '{"id": 2}'], False)


def test_failed_chunks_are_named_and_tried_again(spark, tmp_path):
    root = str(tmp_path)
    first = [GOOD, ("b", ['{"id": 3}', "{broken", '{"id": "no number"}'], False), ("c", ['{"id": 4}'], True), ("d", [], False), (None, ['{"id": 5}'], False)]
    a_pass(spark, first, root)
    assert state(spark, root) == {"a": ("done", 1, None, 3, 0), "b": ("done", 1, None, 1, 2), "c": ("failed", 1, "OSError: no answer", None, None), "d": ("done", 1, None, 0, 0), "": ("done", 1, None, 1, 0)}
    assert values(spark, root) == [("", 5, None), ("a", 1, "x"), ("a", 1, "x"), ("a", 2, None), ("b", 3, None)]
    assert sorted(tuple(r) for r in landing.dead_letters(spark, SCHEMA, root).collect()) == [("b", "{\"id\": \"no number\"}"), ("b", "{broken")]
    assert [r.chunk for r in landing.pending(chunks(spark, first), root).collect()] == ["c"]
    a_pass(spark, [*first[:2], ("c", ['{"id": 4}'], False)], root)
    assert state(spark, root)["c"] == ("done", 2, None, 1, 0) and state(spark, root)["a"] == ("done", 1, None, 3, 0)


def test_a_killed_pass_leaves_nothing_and_is_taken_up_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(landing, "_record", dies)
        with pytest.raises(KeyboardInterrupt):
            a_pass(spark, [GOOD], root)
    assert (tmp_path / "rows").exists() and state(spark, root) == {} and values(spark, root) == []
    for _ in range(2):  # the second finds nothing to do
        a_pass(spark, [GOOD], root)
    assert len(values(spark, root)) == 3 and state(spark, root)["a"] == ("done", 1, None, 3, 0)


def test_attempts_end_and_two_passes_at_once_count_once(spark, tmp_path):
    root = str(tmp_path)
    bad = ("c", [], True)
    for _ in range(3):
        a_pass(spark, [bad], root, attempts=2)
    assert state(spark, root)["c"][:2] == ("failed", 2)
    for _ in range(2):  # neither knows of the other
        landing.land(landing.fetch_lines(chunks(spark, [GOOD]), service()), SCHEMA, root)
    assert len(values(spark, root)) == 3


def test_empty_and_csv(spark, tmp_path):
    root = str(tmp_path)
    a_pass(spark, [], root)
    assert state(spark, root) == {} and values(spark, root) == []
    lines = spark.createDataFrame([("a", "1,x", None), ("a", "x,1", None), ("a", "2,", None)], "chunk string, line string, error string")
    landing.land(lines, SCHEMA, root, "csv")
    assert values(spark, root) == [("a", 1, "x"), ("a", 2, None)]
    assert [tuple(r) for r in landing.dead_letters(spark, SCHEMA, root).collect()] == [("a", "x,1")]

import random
import re
import zlib
from functools import cache
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.llm import turn_repair

BARE = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def repaired_by_search(rows):
    """(cost, audit, lines) by trying, turn by turn, every edit; ``rows`` of (role, text, fault)."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    @cache
    def go(i, q, inserted):
        found = []
        if i == len(rows):
            if q in ("", "a"):
                found.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            cost, audit, lines = go(i + 1, q, 0)
            found.append((cost + 3, "D" + audit, lines))
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                if role[:1] == after[q] or role[:1] == "s" and q == "":
                    cost, audit, lines = go(i + 1, role[:1], 0)
                    found.append((cost + extra, "K" + audit, ((role, text), *lines)))
                cost, audit, lines = go(i + 1, after[q], 0)
                found.append((cost + 2 + extra, "R" + audit, ((names[after[q]], text), *lines)))
        if inserted < 3:
            cost, audit, lines = go(i, after[q], inserted + 1)
            found.append((cost + 2, "I" + audit, ((names[after[q]], ""), *lines)))
        return min(found, default=(10**9, "", ()))

    return go(0, "", 0)


def brute(ids, rows):
    out = {}
    for conv in ids:
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, marked = set(), [], []
        for _, role, text in mine:
            bare = BARE.findall(text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append(fault)
            marked.append((role, text, fault))
        turns = {r[0] for r in mine} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, lines = repaired_by_search(tuple(marked))
        out[conv] = (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(), lines)
    return out


def conversations(seed, n=60, longest=12):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "scribe", "User"]
    texts = ["yes.", "no", "", " \n", None, "what?", "é!", "a\x0b", "x. ", "中"]
    rows = [(conv or None, None if rng.random() < 0.1 else turn // rng.choice([1, 1, 2]), rng.choice(roles), rng.choice(texts)) for conv in range(n) for turn in range(rng.randint(1, longest))]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def cases(spark):
    rows = conversations(1)
    return rows, spark.createDataFrame(rows, SCHEMA).withColumn("seg", F.lit("clash")).withColumn("conv", F.lit("clash"))


@pytest.mark.parametrize("long_turns", [20_000, 4])
def test_brute_force(cases, long_turns):
    """Whole conversations, and the same cut into segments."""
    rows, df = cases
    want = brute({r[0] for r in rows}, damaged(rows))
    got = turn_repair.repair(turn_repair.damage(df), long_turns=long_turns).collect()
    assert {r.conv_id: tuple(r) for r in got} == {c: w[:-1] for c, w in want.items() if any(r[0] == c for r in damaged(rows))}
    assert len(got) > 50


@pytest.mark.parametrize("long_turns", [20_000, 6])
def test_turns(cases, long_turns):
    rows, df = cases
    want = brute({r[0] for r in rows}, damaged(rows))
    got = {}
    for r in turn_repair.repaired_turns(turn_repair.damage(df), long_turns=long_turns).orderBy("conv_id", "place").collect():
        assert r.place == len(got.setdefault(r.conv_id, []))
        got[r.conv_id].append((r.role, r.text))
    assert got == {c: list(w[-1]) for c, w in want.items() if w[-1]}


def test_long_by_bytes(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "x" * 5000 + f"{i}.") for i in range(40)]
    (a,) = turn_repair.repair(spark.createDataFrame(rows, SCHEMA), long_bytes=20_000).collect()
    (b,) = turn_repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert a == b and a.cost == 0 and a.audit == "K" * 40


def test_many_equal_rows(spark):
    rows = [(1, 0, "user", "hi.")] * 500 + [(1, 1, "user", "hi.")] * 300 + [(1, 2, "assistant", "")] * 200
    (a,) = turn_repair.repair(spark.createDataFrame(rows, SCHEMA), long_turns=100).collect()
    assert (a.blank, a.duplicate, a.truncated, a.illegal) == (200, 799, 0, 998)
    assert a.audit == "D" * 1000 or a.audit == "K" + "D" * 999 + "I"
    (b,) = turn_repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert a == b


def test_query(spark, tmp_path):
    rows = conversations(2, n=60, longest=3) + [(c, None, None, None) for c in range(1000, 1040)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = turn_repair.op11_turn_repair(spark, str(tmp_path)).collect()
    want = brute({r[0] for r in rows}, damaged(rows))
    assert {r.conv_id: tuple(r) for r in got} == {c: w[:-1] for c, w in want.items()}
    assert any(not r.audit for r in got)


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.sql(turn_repair.OP11_SQL)
    got = turn_repair.op11_turn_repair(spark, sf)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_sql_on_edge_cases(spark, tmp_path):
    """The SQL orders equal turns as the operator does, and knows nulls and odd roles."""
    rows = conversations(3, n=40, longest=6)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(turn_repair.OP11_SQL).fetchall()
    assert sorted(map(repr, map(tuple, turn_repair.op11_turn_repair(spark, str(tmp_path)).collect()))) == sorted(map(repr, want))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert turn_repair.op11_turn_repair(spark, str(tmp_path)).count() == 0

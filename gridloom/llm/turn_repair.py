"""Conversation structure repair: the cheapest edits that give a conversation the shape of one optional system turn, then user and assistant turns by turns.

A subsequence of a conversation's turns is retained, each as it is or with another role; everything else follows. Between two retained turns lie deletions, which a prefix sum prices,
and insertions, which the pair of roles determines. Going backwards, a running minimum for each role of the next retained turn holds what its choice costs from there on, so that a turn looks at
three numbers and not at all turns behind it. Of equal costs the one whose audit comes first in ASCII is kept, which is a rule on places: the later next turn (more D), then more inserts (I),
then keeping (K) before reroling (R).

A task repairs a conversation at a time. One of more than ``LONG_TURNS`` turns or ``LONG_BYTES`` bytes is cut into segments by ranges of its order, however many tasks that takes: each segment is priced for
every role that it can be entered and left with, the prices are chained back to front and the choices front to back over the segments' few numbers, and the segments then write their repaired turns
as parts of one text, whose hash is read off the parts in order.

Defined results: a null role or text is one space; a null turn comes first; turns that share a number go by role, then text; equal rows are repeats, the first of which counts; rows of null id are one conversation;
an empty table gives none; a conversation that is deleted whole has no repaired turns and the hash of nothing; other columns, whatever their names, aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.files import make_dir, open_fs, text_batches, tidied
from gridloom.plans.shared import materialize, small_side, workdir

LONG_TURNS, LONG_BYTES = 20_000, 64 << 20
RENAME, DELETE, INSERT, UNDELETED = 2, 3, 2, 1
NEVER = 1 << 60

#: Roles by initial; also the state behind the last retained turn, START before any.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
#: The role that must follow.
AFTER = (USER, USER, ASSISTANT, USER)
#: Insertions between two retained roles, and before the end.
BETWEEN = {(START, SYSTEM): 0} | {(a, b): int(AFTER[a] != b) for a in range(4) for b in (USER, ASSISTANT)}
TO_END = (0, 2, 1, 0)
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


class Priced:
    """Choices for turns of (initial's role, or 0; first fault; how many such turns), priced back to front. ``beyond[q]`` is what follows them costs
    if ``q`` is the last role that they leave."""

    def __init__(self, turns: list[tuple[int, int, int]], beyond: list[int]):
        n = len(turns)
        self.turns, self.beyond, self.n = turns, beyond, n
        deleted = [0]
        for _, _, copies in turns:
            deleted.append(deleted[-1] + DELETE * copies)
        #: role -> (cost of deleting all turns before the next retained one, counted from the first turn, and all that follows; its place)
        best: list = [None, (NEVER, n), (NEVER, n), (NEVER, n)]
        self.choice: list = [None] * n
        self.deleted, self.best = deleted, best
        for j in range(n - 1, -1, -1):
            role, fault, _ = turns[j]
            if fault in (BLANK, DUPLICATE):
                continue
            extra = UNDELETED if fault == TRUNCATED else 0
            here = {}
            for r in {role, USER, ASSISTANT} - {0}:
                value, k, to = self._go(r)
                here[r] = (value - deleted[j + 1] + extra + (0 if r == role else RENAME), k, to)
            self.choice[j] = here
            for r, (value, _, _) in here.items():
                if deleted[j] + value < best[r][0]:
                    best[r] = (deleted[j] + value, j)
        self.first = [self._go(q) for q in range(4)]
        self.costs = [x[0] for x in self.first]

    def _go(self, q: int) -> tuple[int, int, int]:
        """The best next retained turn behind role ``q``: (value, its place, its role); the place n is beyond the last turn."""
        found = (self.deleted[self.n] + self.beyond[q], -self.n, 0, 0, 0)
        for r in (SYSTEM, USER, ASSISTANT):
            inserts = BETWEEN.get((q, r))
            if inserts is not None and self.best[r][0] < NEVER:
                value, k = self.best[r]
                found = min(found, (value + INSERT * inserts, -k, -inserts, int(self.turns[k][0] != r), r))
        return found[0], -found[1], found[4]

    def walk(self, q: int) -> Iterator[tuple[str, int, int | None]]:
        """The edits from role ``q`` on: (audit initials, role or 0, place of the turn or None)."""
        _, k, to = self.first[q]
        at = 0
        while True:
            gap = sum(copies for _, _, copies in self.turns[at:k])
            if gap:
                yield "D" * gap, 0, None
            if k == self.n:
                return
            if BETWEEN[q, to]:
                q = AFTER[q]
                yield "I", q, None
            yield "K" if self.turns[k][0] == to else "R", to, k
            at, q = k + 1, to
            _, k, to = self.choice[k][to]


def closing(q: int) -> Iterator[tuple[str, int, None]]:
    """The insertions behind the last retained role."""
    for _ in range(TO_END[q]):
        q = AFTER[q]
        yield "I", q, None


def _illegal(roles: list[int]) -> int:
    return sum(x not in LEGAL for x in zip(roles, roles[1:]))


def _groups(batches: Iterator, keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted Arrow batches by their first ``keys`` columns."""
    from itertools import groupby

    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for key, found in groupby(rows, lambda r: r[:keys]):
        yield key, [r[keys:] for r in found]


TURNS = "conv long, seg int, place long, role string, text string"
REPORT = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, sha string"
SUMMARY = "conv long, seg int, first int, last int, blank long, duplicate long, truncated long, illegal long, prices array<long>"
BEYOND = "conv long, seg int, beyond array<long>, is_last boolean"
CHOICES = "conv long, seg int, ends array<int>, audits array<string>"
STARTS = "conv long, seg int, start int, before long, cost long, illegal long, audit string"
PARTS = "conv long, seg int, path string"


def _map(df: DataFrame, f, schema: str) -> DataFrame:
    """``df.mapInArrow`` by a function from batches to tuples."""

    def run(batches: Iterator) -> Iterator:
        from itertools import islice

        import pyarrow as pa

        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
        target = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, schema.split(", "))])
        rows = f(batches)
        while part := list(islice(rows, 500)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), target.types)], schema=target)

    return text_batches(df, tidied(run), schema)


def damage(rows: DataFrame) -> DataFrame:
    """The damage that the check asks for, told by a row's id and turn: some rows dropped, emptied, without their stops, repeated, or made a user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    rows = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("n"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("n")))).drop("col")


def _prepared(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, kind, fault): the role that the initial tells, and the fault that a turn has by itself."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    bare = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    kind = F.position(F.substring("role", 1, 1), F.lit("sua"))
    fault = F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), OK).otherwise(TRUNCATED)
    return rows.withColumns({"kind": F.when(F.col("role") == "", 0).otherwise(kind).cast("int"), "fault": fault})


ORDER = ["turn", "role", "text"]


def _whole(conv, rows: list[tuple]) -> tuple[tuple, list[tuple[str, str]]]:
    """The report of a conversation and its repaired turns."""
    from hashlib import sha256

    seen, turns, faults = set(), [], [0] * 4
    for _, role, text, kind, fault in rows:
        if fault != BLANK and (role, text) in seen:
            fault = DUPLICATE
        seen.add((role, text))
        faults[fault] += 1
        turns.append((kind, fault, 1))
    numbers = {r[0] for r in rows} - {None}
    priced = Priced(turns, [INSERT * n for n in TO_END])
    audit, lines = _edits(priced, [r[1:3] for r in rows], START, True)[:2]
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    sha = sha256("\n".join(f"{role}:{text}" for role, text in lines).encode()).hexdigest()
    return (conv, gaps, *faults[1:], _illegal([r[3] for r in rows]), priced.costs[START], audit, sha), lines


def _edits(priced: Priced, own: list[tuple[str, str]], q: int, is_last: bool) -> tuple[str, list[tuple[str, str]], int]:
    """(audit, repaired turns, last role) from role ``q`` on."""
    audit, lines = [], []
    for initials, role, k in priced.walk(q):
        audit.append(initials)
        if role:
            lines.append((own[k][0] if initials == "K" else NAMES[role], own[k][1]) if k is not None else (NAMES[role], ""))
            q = role
    for initials, role, _ in closing(q) if is_last else ():
        audit.append(initials)
        lines.append((NAMES[role], ""))
    return "".join(audit), lines, q


def _laid_out(rows: list[tuple]) -> tuple[list[tuple[int, int, int]], list[tuple[str, str]]]:
    """Turns and (role, text) of a segment's rows (turn, role, text, kind, fault, n, again): equal rows are one, and behind its first copy stand the others."""
    turns, own = [], []
    for _, role, text, kind, fault, n, again in rows:
        fault = DUPLICATE if again and fault != BLANK else fault
        alike = n if fault in (BLANK, DUPLICATE) else 1
        for entry in ((kind, fault, alike), (kind, DUPLICATE, n - alike)):
            if entry[2]:
                turns.append(entry)
                own.append((role, text))
    return turns, own


def _repair_long(rows: DataFrame, total, long_turns: int, long_bytes: int, as_turns: bool) -> DataFrame:
    """Conversations that no task should hold whole; ``rows`` as ``_prepared`` gives them, ``total`` their number and bytes."""
    spark = rows.sparkSession
    entries = rows.groupBy("conv", *ORDER, "kind", "fault").agg(F.count("*").alias("n")).withColumn("digest", F.sha2("text", 256))
    number = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"))
    firsts = entries.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(number).alias("first"))
    entries = entries.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    entries = entries.select("conv", *ORDER, "kind", "fault", "n", (number > F.col("first")).alias("again"))
    tasks = int(max(total.n // long_turns, total.bytes // long_bytes)) + 1
    entries = materialize(entries.repartitionByRange(tasks, "conv", *ORDER).withColumn("seg", F.spark_partition_id()), "turn-entries")

    def sorted_segments(more: DataFrame | None = None, names: tuple[str, ...] = ()) -> DataFrame:
        held = entries
        if more is not None:
            more = small_side(more.select(F.col("conv").alias("c"), F.col("seg").alias("s"), *names))
            held = entries.join(more, F.col("conv").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("s")))
        held = held.select("seg", "conv", *names, *ORDER, "kind", "fault", "n", "again")
        return held.repartition(tasks, "seg").sortWithinPartitions("seg", "conv", *ORDER)

    def summarise(batches: Iterator) -> Iterator:
        for (seg, conv), found in _groups(batches, 2):
            turns, _ = _laid_out(found)
            faults = [sum(n for _, f, n in turns if f == fault) for fault in (BLANK, DUPLICATE, TRUNCATED)]
            illegal = _illegal([t[0] for t in turns]) + sum(n - 1 for _, _, n in turns)
            # one pricing for each role that the segment may leave last
            priced = [Priced(turns, [0 if q == to else NEVER for q in range(4)]).costs for to in range(4)]
            yield conv, seg, turns[0][0], turns[-1][0], *faults, illegal, [min(NEVER, priced[to][q]) for q in range(4) for to in range(4)]

    def back(batches: Iterator) -> Iterator:
        for (conv,), found in _groups(batches, 1):
            beyond = [INSERT * n for n in TO_END]
            for i, (seg, prices) in enumerate(found):
                yield conv, seg, beyond, i == 0
                beyond = [min(prices[4 * q + to] + beyond[to] for to in range(4)) for q in range(4)]

    def choose(batches: Iterator) -> Iterator:
        for (seg, conv, beyond, is_last), found in ((k[:2] + (f[0][0], f[0][1]), [r[2:] for r in f]) for k, f in _groups(batches, 2)):
            turns, own = _laid_out(found)
            priced = Priced(turns, beyond)
            ways = [_edits(priced, own, q, is_last) for q in range(4)]
            yield conv, seg, [w[2] for w in ways], [w[0] for w in ways]

    def front(batches: Iterator) -> Iterator:
        for (conv,), found in _groups(batches, 1):
            start, before, last = START, 0, None
            for seg, ends, audits, prices, beyond, first, final, illegal in found:
                cost = min(prices[4 * START + to] + beyond[to] for to in range(4)) if last is None else 0
                across = last is not None and (last, first) not in LEGAL
                yield conv, seg, start, before, cost, illegal + across, audits[start]
                before += len(audits[start]) - audits[start].count("D")
                start, last = ends[start], final

    summary = materialize(_map(sorted_segments(), summarise, SUMMARY), "turn-summary")
    beyond = materialize(_map(summary.select("conv", "seg", "prices").repartition("conv").sortWithinPartitions("conv", F.desc("seg")), back, BEYOND), "turn-beyond")
    choices = materialize(_map(sorted_segments(beyond, ("beyond", "is_last")), choose, CHOICES), "turn-choices")
    named = lambda df, *names: df.select(F.col("conv").alias("c"), F.col("seg").alias("s"), *names)
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("s"))
    chain = choices.join(named(summary, "prices", "first", "last", "illegal"), same).drop("c", "s").join(named(beyond, "beyond"), same)
    chain = chain.select("conv", "seg", "ends", "audits", "prices", "beyond", "first", "last", "illegal").repartition("conv").sortWithinPartitions("conv", "seg")
    starts = materialize(_map(chain, front, STARTS), "turn-starts")
    facts = starts.join(named(beyond, "beyond", "is_last"), same).drop("c", "s")
    final = sorted_segments(facts, ("beyond", "is_last", "start", "before"))

    def repaired(batches: Iterator) -> Iterator:
        for (seg, conv), found in _groups(batches, 2):
            beyond, is_last, start, before = found[0][:4]
            turns, own = _laid_out([r[4:] for r in found])
            yield seg, conv, before, _edits(Priced(turns, beyond), own, start, is_last)[1]

    if as_turns:
        return _map(final, lambda batches: ((conv, seg, before + i, *line) for seg, conv, before, lines in repaired(batches) for i, line in enumerate(lines)), TURNS)
    out = workdir(spark, "turn-parts")
    make_dir(out)

    def write(batches: Iterator) -> Iterator:
        import uuid

        for seg, conv, _, lines in repaired(batches):
            system, path = open_fs(name := f"{out}/{seg}-{uuid.uuid4().hex}")
            with system.open_output_stream(path) as sink:
                for role, text in lines:
                    sink.write(f"\n{role}:{text}".encode())
            yield conv, seg, name

    def read(batches: Iterator) -> Iterator:
        from hashlib import sha256

        for (conv,), found in _groups(batches, 1):
            digest, skip = sha256(), 1  # the first line has no line end before it
            for _, name in found:
                system, path = open_fs(name)
                with system.open_input_stream(path) as source:
                    while data := source.read(1 << 20):
                        digest.update(data[skip:])
                        skip = 0
            yield conv, digest.hexdigest()

    parts = materialize(_map(final, write, PARTS), "turn-manifest")
    hashes = _map(parts.repartition("conv").sortWithinPartitions("conv", "seg"), read, "c long, sha string")
    faults = summary.groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    pieces = F.array_sort(F.collect_list(F.struct("seg", "audit")))
    edits = starts.groupBy(F.col("conv").alias("c")).agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"))
    gaps = entries.groupBy(F.col("conv").alias("c")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    report = faults
    for more in (edits, gaps, hashes):
        report = report.join(more, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    return report.select(*(f.split()[0] for f in REPORT.split(", ")))


def _repair(rows: DataFrame, long_turns: int, long_bytes: int, as_turns: bool) -> DataFrame:
    rows = _prepared(rows)
    sizes = rows.groupBy(F.col("conv").alias("c")).agg(F.count("*").alias("n"), F.sum(F.octet_length("role") + F.octet_length("text")).alias("bytes"))
    long_ = materialize(sizes.where((F.col("n") > long_turns) | (F.col("bytes") > long_bytes)), "turn-long")
    total = long_.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    short = rows
    if total.n:
        long_ids = small_side(long_.select("c"))
        same = F.col("conv").eqNullSafe(F.col("c"))
        short = rows.join(long_ids, same, "left_anti")

    def run(batches: Iterator) -> Iterator:
        for (conv,), found in _groups(batches, 1):
            report, lines = _whole(conv, found)
            if as_turns:
                yield from ((conv, 0, i, *line) for i, line in enumerate(lines))
            else:
                yield report

    out = _map(short.repartition("conv").sortWithinPartitions("conv", *ORDER), run, TURNS if as_turns else REPORT)
    if total.n:
        out = out.unionByName(_repair_long(rows.join(long_ids, same, "left_semi"), total, long_turns, long_bytes, as_turns))
    return out


def repair(rows: DataFrame, long_turns: int = LONG_TURNS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """A row for each conversation of ``rows`` (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    return _repair(rows, long_turns, long_bytes, False).withColumnsRenamed({"conv": "conv_id", "sha": "repaired_sha256"})


def repaired_turns(rows: DataFrame, long_turns: int = LONG_TURNS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text."""
    return _repair(rows, long_turns, long_bytes, True).select(F.col("conv").alias("conv_id"), "place", "role", "text")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = repair(damage(rows)).withColumnRenamed("conv_id", "c")
    ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    none = F.sha2(F.lit(""), 256)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"))


#: The cheapest edits by going backwards over all turns, with what each role that may stand before costs from there on and its audit.
OP11_SQL = r"""
WITH RECURSIVE
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
raw AS (SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hit AS (SELECT raw.*, xor(list_reduce(list_transform(range(1, len(key) + 1), lambda i: ascii(key[i])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS kind FROM raw, crc),
dmg AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit),
ids AS (SELECT row_number() OVER () AS c, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i, turn, role, text FROM dmg JOIN ids ON dmg.conv_id IS NOT DISTINCT FROM ids.conv_id),
e AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS seen, regexp_extract(text, '[^\x20\x09-\x0D][\x20\x09-\x0D]*$')[1] AS last, role[1] AS ini, lag(role[1]) OVER (PARTITION BY c ORDER BY i) AS prev FROM o),
f AS (SELECT *, CASE WHEN last = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM e),
n AS (SELECT ids.c, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (i > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM ids LEFT JOIN f USING (c) GROUP BY ids.c),
dp AS (
  SELECT c, n AS i, {'k': 0, 'x': ''} AS g0, {'k': 4, 'x': 'II'} AS gs, {'k': 2, 'x': 'I'} AS gu, {'k': 0, 'x': ''} AS ga FROM n
  UNION ALL
  SELECT c, i, least(h0, {'k': hu.k + 2, 'x': 'I' || hu.x}, {'k': ha.k + 4, 'x': 'II' || ha.x}) AS g0, least(hs, {'k': hu.k + 2, 'x': 'I' || hu.x}, {'k': ha.k + 4, 'x': 'II' || ha.x}) AS gs,
    least(hu, {'k': ha.k + 2, 'x': 'I' || ha.x}) AS gu, least(ha, {'k': hu.k + 2, 'x': 'I' || hu.x}) AS ga
  FROM (SELECT c, i,
      least({'k': g0.k + 3, 'x': 'D' || g0.x}, CASE WHEN ok AND ini = 's' THEN {'k': gs.k + t, 'x': 'K' || gs.x} WHEN ok AND ini = 'u' THEN {'k': gu.k + t, 'x': 'K' || gu.x} END, CASE WHEN ok THEN {'k': gu.k + 2 + t, 'x': 'R' || gu.x} END) AS h0,
      least({'k': gs.k + 3, 'x': 'D' || gs.x}, CASE WHEN ok AND ini = 'u' THEN {'k': gu.k + t, 'x': 'K' || gu.x} END, CASE WHEN ok THEN {'k': gu.k + 2 + t, 'x': 'R' || gu.x} END) AS hs,
      least({'k': gu.k + 3, 'x': 'D' || gu.x}, CASE WHEN ok AND ini = 'a' THEN {'k': ga.k + t, 'x': 'K' || ga.x} END, CASE WHEN ok THEN {'k': ga.k + 2 + t, 'x': 'R' || ga.x} END) AS hu,
      least({'k': ga.k + 3, 'x': 'D' || ga.x}, CASE WHEN ok AND ini = 'u' THEN {'k': gu.k + t, 'x': 'K' || gu.x} END, CASE WHEN ok THEN {'k': gu.k + 2 + t, 'x': 'R' || gu.x} END) AS ha
    FROM (SELECT dp.c, dp.i - 1 AS i, g0, gs, gu, ga, f.ini, f.fault IN ('', 't') AS ok, (f.fault = 't')::INTEGER AS t FROM dp JOIN f ON f.c = dp.c AND f.i = dp.i))
),
best AS (SELECT c, g0.k AS cost, g0.x AS audit FROM dp WHERE i = 0),
step AS (SELECT c, p, audit[p] AS x, p - len(replace(audit[1:p], 'I', '')) AS inserts, len(replace(audit[1:p], 'D', '')) AS place FROM (SELECT c, audit, unnest(range(1, len(audit) + 1)) AS p FROM best)),
kept AS (SELECT s.c, s.p, s.x, s.place, f.role, f.ini, f.text FROM step s LEFT JOIN f ON f.c = s.c AND s.x <> 'I' AND f.i = s.p - s.inserts WHERE s.x <> 'D'),
led AS (SELECT *, coalesce(bool_or(place = 1 AND x = 'K' AND ini = 's') OVER (PARTITION BY c), false)::INTEGER AS lead FROM kept),
line AS (SELECT c, string_agg(CASE WHEN x = 'K' THEN role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS all_ FROM led GROUP BY c)
SELECT ids.conv_id, gaps::BIGINT AS gaps, blank, duplicate, truncated, illegal, cost::BIGINT AS cost, audit, sha256(coalesce(all_, '')) AS repaired_sha256
FROM ids JOIN n USING (c) JOIN best USING (c) LEFT JOIN line USING (c)"""

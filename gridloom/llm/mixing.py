"""Mixing sources to target weights.

A source's documents, in a fixed order, are one stream of words, packed into blocks of ``BLOCK`` words; the last may be shorter.
A source's target asks for a number of block slots: whole passes over its blocks, and a part of one more whose last slot is cut so that
the words come to the target exactly. Output shards draw how many slots of each source they hold from a multinomial over what
the sources have left. The slots of a source are numbered through the shards, and slot j of a pass maps to a block by a pseudorandom
permutation of the source's block indexes; slots and blocks join by index. No block occurs twice in a pass, so that no document is
taken more often than the cap says.

Scale: documents move as (id, size) only; a source's stream is numbered in buckets of about ``BUCKET`` rows, and a bucket that many equal rows
crowd is cut further, so a source that holds most rows spreads over many tasks; the driver sees one row for each source. A shard's task draws its own counts: halving
the shards, each half's counts are drawn from a multinomial over what its parent has of each source, so a task follows one path of halvings.

Defined results: null text or source are a text of no words and the source that sorts last; documents of no words are taken 0 times; a
source of no words has target 0; every row, repeated or not, comes back as a row of its own; null ids sort first; a very long text spans as many blocks as
it needs; an empty table gives none; columns beside doc_id, source and text are not looked at. More than ``MAX_SOURCES`` sources are refused with a ValueError, as the driver fills
up the targets. Everything is drawn from ``seed`` and the sources' names: reruns agree.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.files import limit_batches, one_task_each, small_side, tidied
from gridloom.plans.shared import materialize

BLOCK, BUCKET, MAX_SOURCES = 64, 4096, 100_000
#: Slots of a shard, and the largest numbers of shards and of tasks that draw them; beyond, shards and tasks grow.
SHARD_SLOTS, MAX_SHARDS, MAX_TASKS = 1 << 16, 4096, 64
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """share * sum(sizes) split by weight; who would pass cap * own size stops there and the others share the rest."""
    out, open_ = [0.0] * len(sizes), [i for i in range(len(sizes))]
    left = share * sum(sizes)
    while open_:
        total = math.fsum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = cap * sizes[i]
        left -= math.fsum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


@dataclass(frozen=True)
class Source:
    name: str | None
    rows: int
    size: int
    target: float
    block: int

    @property
    def full(self) -> int:
        return self.size // self.block

    @property
    def a_pass(self) -> int:
        """Slots of a pass."""
        return -(-self.size // self.block)

    @property
    def words(self) -> int:
        return round(self.target)

    @property
    def slots(self) -> int:
        if not self.size:
            return 0
        passes, rest = divmod(self.words, self.size)
        return passes * self.a_pass + -(-rest // self.block)

    @property
    def last_take(self) -> int:
        """Words of the last slot."""
        rest = self.words % self.size if self.size else 0
        if not rest:
            return self.block
        return rest - (-(-rest // self.block) - 1) * self.block


def read_sources(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float, block: int) -> list[Source]:
    rows = sizes.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    goal = targets([r["size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], share, cap)
    return [Source(r.source, r["rows"], r["size"], t, block) for r, t in zip(rows, goal)]


def number_words(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``src`` and ``start``, a document's first word in its source's stream."""
    rows = sizes.join(F.broadcast(sources), sizes["source"].eqNullSafe(sources["name"])).drop("name")
    # rows of no words take no place, so they are dealt out freely
    spread = F.when(F.col("size") > 0, F.xxhash64("doc_id", "size", "tie")).otherwise(F.xxhash64("row"))
    rows = rows.withColumns({"spread": spread, "bucket": F.pmod(spread, F.col("buckets"))})
    # what crowds a bucket is rows that are equal in all that counts; which buckets and rows those are doesn't depend on how rows are numbered
    filled = rows.where("size > 0")
    crowded = materialize(filled.groupBy("src", "bucket").agg(F.count("*").alias("rows")).where(F.col("rows") > 8 * BUCKET).select("src", "bucket"), "mix-crowded", 1)
    key = ["src", "bucket", "spread", "doc_id", "size", "tie"]
    heavy = filled.join(small_side(crowded), ["src", "bucket"], "left_semi").groupBy(*key).agg(F.count("*").alias("copies")).where(F.col("copies") > BUCKET)
    heavy = materialize(heavy.select(*(F.col(c).alias(f"h_{c}") for c in key), F.ceil(F.col("copies") / BUCKET).alias("parts")), "mix-heavy", 1)
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"h_{c}"))
    # a heavy row's copies have a run of their own, cut into parts; they are alike, so it doesn't matter which copy stands in which part
    rows = rows.join(small_side(heavy), same, "left")
    rows = rows.withColumns({"run": F.when(F.col("parts").isNotNull(), F.col("spread")).otherwise(0), "part": F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")) + 1, F.lit(0))})
    rows = rows.drop("parts", "spread", *(f"h_{c}" for c in key))
    place = ["src", "bucket", "run", "part"]
    sums = rows.groupBy(*place).agg(F.sum("size").alias("sum"))
    base = sums.withColumn("base", F.coalesce(F.sum("sum").over(Window.partitionBy("src").orderBy(*place[1:]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("sum")
    own = Window.partitionBy(*place).orderBy("doc_id", "size", "tie", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(own), F.lit(0))).join(base, place).withColumn("start", F.col("start") + F.col("base"))
    return rows.drop(*place[1:], "base", "buckets")


def draw_shard(slots: list[int], shards: int, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first slot, slots) of each source in shard ``k``. The shards are halved down to it; the left half's counts are drawn from a multinomial over what both have."""
    left = np.array(slots, np.int64)
    total, first, lo, hi = int(left.sum()), np.zeros_like(left), 0, shards
    while hi - lo > 1:
        mid, rng = (lo + hi) // 2, np.random.default_rng([seed, lo, hi])
        want, drawn = total * mid // shards - total * lo // shards, np.zeros_like(left)
        while missing := want - int(drawn.sum()):
            rest = left - drawn
            drawn += np.minimum(rest, rng.multinomial(missing, rest / rest.sum()))
        if k < mid:
            left, hi = drawn, mid
        else:
            first, left, lo = first + drawn, left - drawn, mid
    return first, left


def _round_key(name: str | None, a_pass: int, seed: int) -> np.ndarray:
    raw = hashlib.blake2b(f"{seed}/{a_pass}/{'' if name is None else 's' + name}".encode("utf-8", "surrogatepass"), digest_size=48).digest()
    return np.frombuffer(raw, "<u8")


def permute(x: np.ndarray, n: int, key: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of range(n) takes x: alternate rounds on the digits (l, r) of x in base b shift one by a
    hash of the other; what leaves range(n), less than b of a * b values, goes round again."""
    b = max(1, math.isqrt(n))
    a = -(-n // b)

    def mixed(v: np.ndarray, k: np.uint64) -> np.ndarray:
        v = (v.astype(np.uint64) ^ k) * np.uint64(0xFF51AFD7ED558CCD)
        v = (v ^ v >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
        return (v ^ v >> np.uint64(33)) >> np.uint64(1)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v // b, v % b
        for i, k in enumerate(key):
            if i % 2:
                left = ((left.astype(np.uint64) + mixed(right, k) % np.uint64(a)) % np.uint64(a)).astype(np.int64)
            else:
                right = ((right.astype(np.uint64) + mixed(left, k) % np.uint64(b)) % np.uint64(b)).astype(np.int64)
        return left * b + right

    x = once(x)
    while len(out := np.flatnonzero(x >= n)):
        x[out] = once(x[out])
    return x


def map_slots(spark: SparkSession, sources: list[Source], seed: int, chunk: int = 1 << 16) -> DataFrame:
    """(shard, src, slot, pass, block, take): every slot of every shard with its block index."""
    total = sum(s.slots for s in sources)
    shards = min(MAX_SHARDS, -(-total // SHARD_SLOTS))
    shared = spark.sparkContext.broadcast(sources)

    def draw(batches: Iterator) -> Iterator:
        import pyarrow as pa

        slots = [s.slots for s in shared.value]
        for batch in batches:
            for k in batch.column(0).to_pylist():
                first, n = draw_shard(slots, shards, k, seed)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array(first[some]), pa.array(n[some])], names=["shard", "src", "first", "n"])

    rows = spark.range(0, shards, 1, max(1, min(shards, MAX_TASKS))).mapInArrow(tidied(draw), "shard int, src int, first long, n long")
    rows = rows.select("shard", "src", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1, F.lit(chunk).cast("long"))).alias("lo"), (F.col("first") + F.col("n")).alias("end"))
    rows = rows.withColumn("hi", F.least("end", F.col("lo") + chunk)).drop("end")
    rows = one_task_each(rows, max(total // chunk, spark.sparkContext.defaultParallelism) if total else 0)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                s: Source = shared.value[r["src"]]
                slot = np.arange(r["lo"], r["hi"], dtype=np.int64)
                a_pass, at = slot // s.a_pass, slot % s.a_pass
                block = at.copy()  # the short last block keeps its place
                for p in np.unique(a_pass).tolist():
                    if len(mine := np.flatnonzero((a_pass == p) & (at < s.full))):
                        block[mine] = permute(at[mine], s.full, _round_key(s.name, p, seed))
                take = np.minimum(s.block, s.size - block * s.block)
                take[slot == s.slots - 1] = np.minimum(take[slot == s.slots - 1], s.last_take)
                n = len(slot)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["shard"], np.int32)), pa.array(np.full(n, r["src"], np.int32)), pa.array(slot), pa.array(a_pass.astype(np.int32)), pa.array(block), pa.array(take)], names=["shard", "src", "slot", "pass", "block", "take"])

    return rows.mapInArrow(tidied(run), "shard int, src int, slot long, pass int, block long, take long")


def cut_blocks(numbered: DataFrame, block: int, *more: str) -> DataFrame:
    """A row for each block that a document has words in: ``at``, its first word's place in the block, ``n`` words from word ``first`` of the document."""
    covers = F.when(F.col("size") > 0, F.sequence((F.col("start") / block).cast("long"), ((F.col("start") + F.col("size") - 1) / block).cast("long")))
    rows = numbered.select("row", "doc_id", "src", "start", "size", *more, F.explode_outer(covers).alias("block"))
    lo = F.greatest("start", F.col("block") * block)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return rows.withColumn("at", lo - F.col("block") * block).withColumn("n", hi - lo).withColumn("first", lo - F.col("start"))


@dataclass
class Mix:
    sources: list[Source]
    numbered: DataFrame
    slots: DataFrame
    block: int
    rows: DataFrame | None


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = BLOCK, seed: int = 42, sizes_only: bool = False) -> Mix:
    """Plan the mix of ``docs`` (doc_id, source, text). The rows are written with their numbers, for ``mixed_documents``; with ``sizes_only`` their sizes alone are."""
    spark, rows = docs.sparkSession, None
    number = F.monotonically_increasing_id()
    if not sizes_only:
        rows = materialize(docs.select(F.struct("*").alias("whole"), number.alias("number")), "mix-rows")
        docs, number = rows.select(*(F.col("whole")[c].alias(c) for c in ("doc_id", "source", "text")), "number"), F.col("number")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), F.xxhash64("text").alias("tie"), number.alias("row"))
    sizes = materialize(sizes, "mix-sizes")  # written: a row keeps its number
    sources = read_sources(sizes, weights, share, cap, block)
    table = spark.createDataFrame([(i, s.name, s.size, s.target, -(-s.rows // BUCKET)) for i, s in enumerate(sources)], "src int, name string, source_size long, target double, buckets long")
    return Mix(sources, number_words(sizes, table), map_slots(spark, sources, seed), block, rows)


def mixture(mix: Mix) -> DataFrame:
    """The mix itself: (shard, place, doc_id, first, n, source, pass): shard's pieces in order of place are ``n`` words of a document from word ``first``."""
    pieces = cut_blocks(mix.numbered.where("size > 0"), mix.block, "source")
    joined = mix.slots.join(pieces, ["src", "block"])
    n = F.least("n", F.col("take") - F.col("at"))
    return joined.where(n > 0).select("shard", F.xxhash64("shard", "src", "slot").alias("place"), "at", "doc_id", "first", n.alias("n"), "source", "pass")


def taken_words(mix: Mix) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken): the words that the mix takes of each document."""
    short = F.least(F.lit(mix.block).cast("long"), F.col("source_size") - F.col("block") * mix.block)
    sizes = mix.numbered.sparkSession.createDataFrame([(i, s.size) for i, s in enumerate(mix.sources)], "src int, source_size long")
    whole = F.col("take") >= short
    uses = mix.slots.join(F.broadcast(sizes), "src").groupBy("src", "block").agg(F.sum(whole.cast("long")).alias("wholes"), F.max(F.when(~whole, F.col("take"))).alias("cut"))
    pieces = cut_blocks(mix.numbered, mix.block, "source", "source_size", "target")
    joined = pieces.join(uses, ["src", "block"], "left")
    part = F.greatest(F.lit(0), F.least("n", F.col("cut") - F.col("at")))
    words = F.coalesce(F.col("wholes") * F.col("n"), F.lit(0)) + F.coalesce(F.when(F.col("cut").isNotNull(), part), F.lit(0))
    return joined.groupBy("row", "doc_id", "size", "source", "source_size", "target").agg(F.sum(words).alias("taken")).drop("row")


def mixed_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    """Rows of ``docs``, which ``mix`` was planned for, one for each pass over a document: a whole pass keeps the text as it is, a partial pass keeps the words that it takes,
    each run of words as it stands in the text, runs joined by a line end. Rows that repeat have cuts of their own."""
    if mix.rows is None:
        raise ValueError("the mix was planned for sizes only")
    passes = [s.words // s.size if s.size else 0 for s in mix.sources]
    table = docs.sparkSession.createDataFrame([(i, s.name, p) for i, (s, p) in enumerate(zip(mix.sources, passes))], "src int, name string, passes int")
    rows = mix.rows.join(F.broadcast(table), F.col("whole.source").eqNullSafe(F.col("name"))).select(F.col("whole").alias("row"), "number", F.col("passes").alias("__passes"))
    partial = mix.slots.join(F.broadcast(table.select("src", "passes")), "src").where(F.col("pass") >= F.col("passes")).select("src", "block", "take")
    pieces = cut_blocks(mix.numbered.where("size > 0"), mix.block).join(partial, ["src", "block"])
    n = F.least("n", F.col("take") - F.col("at"))
    cuts = pieces.where(n > 0).groupBy(F.col("row").alias("of")).agg(F.sort_array(F.collect_list(F.struct("first", n.alias("n")))).alias("__cuts"))
    joined = rows.join(cuts, F.col("number") == F.col("of"), "left")

    def run(batches: Iterator) -> Iterator:
        import re

        import pyarrow as pa

        word = re.compile(WORD.encode())  # white space and words' ends are ASCII, so bytes do
        for batch in batches:
            rows, passes, cuts_ = batch.columns
            fields = list(rows.type)
            at = [f.name for f in fields].index("text")
            whole = np.repeat(np.arange(batch.num_rows), passes.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([rows.take(pa.array(whole, pa.int64()))], names=["row"])
            texts, mine = [], []
            for i, (text, cut) in enumerate(zip(rows.field(at), cuts_)):
                if (cut := cut.as_py()) and (text := text.as_py()):
                    raw = text.encode()
                    spans = [m.span() for m in word.finditer(raw)]
                    runs: list[list[int]] = []
                    for c in cut:
                        if runs and runs[-1][1] == c["first"]:
                            runs[-1][1] += c["n"]
                        else:
                            runs.append([c["first"], c["first"] + c["n"]])
                    texts.append("\n".join(raw[spans[a][0] : spans[b - 1][1]].decode() for a, b in runs))
                    mine.append(i)
            parts = rows.take(pa.array(mine, pa.int64())).flatten()
            parts[at] = pa.array(texts, fields[at].type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(parts, fields=fields)], names=["row"])

    from pyspark.sql import types as T

    limit_batches(docs.sparkSession)
    return joined.select("row", "__passes", "__cuts").mapInArrow(tidied(run), T.StructType([T.StructField("row", docs.schema)])).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return taken_words(plan_mix(docs, sizes_only=True)).select("doc_id", "size", "source_size", "target", "taken", "source")

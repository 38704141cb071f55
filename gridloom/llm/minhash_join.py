"""MinHash near-dedup by chosen-path set similarity join (Christiani, Pagh and Sivertsen, 2018).

A document is the set of its distinct word shingles; equal sets are one class. Every class walks independent trees: a node picks one
coordinate of the 128-fold minwise signature by its own hash, and the classes in it branch by the token there. A node of
``SMALL`` classes or fewer stops: all its pairs are compared by signature. What is still larger after ``DEPTH``
tokens in common goes on as one group. This gives loose groups, wide enough that a pair over the threshold is missed in one tree at
most with probability 1 - threshold ** depth, and in all trees with that to the power of their number. ``trees_for`` takes as many trees as keep this at
1 - ``RECALL`` or less at ``DEPTH``: 15 at threshold 0.85, 23 at 0.8.

Inside a loose group links are confirmed on full sets: by blocks of ``CHUNK`` classes, or ``CHUNK_SHINGLES`` shingles, which all get the group's pivots. Where
a group has more than one block, what isn't joined to its largest component goes by prefixes: shingles are ordered by how many of the group's sets hold them, and
of a linked pair the smaller set's first ``size - least overlap + 1`` shingles meet the larger one's (exact, for the least overlap that any set of its size or more
leaves). Only rows that meet so, by sizes and places that allow the link, go to the blocks where it is confirmed. Linked pairs leave as spanning forests, never
as all pairs; components of them are exact.

Defined results: null and empty texts have the empty set, linked with nothing; fewer words than a shingle are one shingle; a row of null id
has a null component and isn't kept; rows that share an id are one node; ties go to the smallest id; a very long text is one set of all its shingles; an
empty table gives none; other columns, whatever their names, aren't looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.files import small_side, text_batches, tidied
from gridloom.plans.components import connected_components
from gridloom.plans.shared import materialize, release

COORDINATES, DEPTH, SMALL, CHUNK, PIVOTS = 128, 6, 64, 256, 4
#: Shingles of a block, on average, where its sets are long.
CHUNK_SHINGLES = 1 << 20
#: Bytes of text that are hashed at once, and of a word that is hashed with the others.
PIECE, LONG_WORD = 1 << 17, 64
#: Rows of small nodes that are compared at once.
COMPARED = 1 << 14
#: Share of the pairs at the threshold that the trees bring together, if all of a pair's nodes are crowded down to DEPTH.
RECALL = 0.999
_MIX = np.uint64(0x9E3779B97F4A7C15)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, powers of an odd number modulo 2^64, and their inverses."""
    base = 0x9E3779B97F4A7C15
    whole = np.random.default_rng(77).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    powers, inverse = np.full(PIECE, np.uint64(base)), np.full(PIECE, np.uint64(pow(base, -1, 1 << 64)))
    powers[0] = inverse[0] = 1
    return whole, np.cumprod(powers), np.cumprod(inverse)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, A-Z in lower case. A word's bytes are the digits of a number that is read off running sums over the whole text; words that are
    longer than LONG_WORD are hashed one by one."""
    from xxhash import xxh3_64_intdigest

    raw = (text or "").encode().lower()  # of bytes: A-Z alone
    whole, powers, inverse = _tables()
    data, found, lo = np.frombuffer(raw, np.uint8), [], 0
    while lo < len(data):  # a piece of bounded size at a time, cut at a blank or, if need be, behind its word
        hi = min(len(data), lo + PIECE)
        if hi < len(data):
            blanks = np.flatnonzero(_SPACE[data[lo:hi]])
            if not len(blanks):
                later = np.flatnonzero(_SPACE[data[hi:]])
                end = hi + int(later[0]) if len(later) else len(data)
                found.append(np.array([xxh3_64_intdigest(raw[lo:end])], np.uint64))
                lo = end
                continue
            hi = lo + int(blanks[-1]) + 1
        piece = data[lo:hi]
        edge = np.diff(np.concatenate(([True], _SPACE[piece], [True])).astype(np.int8))
        starts, ends = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(whole[piece] * powers[: len(piece)])))
        h = (sums[ends] - sums[starts]) * inverse[starts] ^ (ends - starts).astype(np.uint64) * _MIX
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            h[i] = xxh3_64_intdigest(raw[lo + starts[i] : lo + ends[i]])
        found.append(h)
        lo = hi
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def shingles(text: str | None, k: int) -> np.ndarray:
    """A text's set as sorted 64-bit hashes of runs of ``k`` words, or of all words if there are fewer."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(k, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k))
    for i in range(k):
        h = (h ^ w[i : len(w) - k + 1 + i]) * _MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


@cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_231)
    return rng.integers(0, 1 << 31, COORDINATES, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, COORDINATES, np.uint64).astype(np.uint32)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least of COORDINATES functions over a set."""
    a, b = _functions()
    x, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for lo in range(0, len(x), 512):
        least = np.minimum(least, (x[lo : lo + 512, None] * a + b).min(axis=0))
    return least.astype("<u4")


def sketch(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, digest, sig, low): digest (null for the empty set) tells equal sets; low has the last eight bits of each of sig's coordinates."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sizes, digests, sigs, lows, ends = [], [], [], [], [0]
            for text in batch.column(1):
                s = shingles(text.as_py(), k)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig = signature(s) if len(s) else np.empty(0, "<u4")
                sigs.append(sig.view("<i4"))
                lows.append(sig.astype(np.uint8).tobytes() if len(s) else None)
                ends.append(ends[-1] + len(sig))
            sig_column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sigs) if sigs else np.empty(0, "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), sig_column, pa.array(lows, pa.binary())], names=["doc_id", "n_shingles", "digest", "sig", "low"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return text_batches(rows, tidied(run), "doc_id long, n_shingles long, digest binary, sig array<int>, low binary")


def child(node: Column, sig: Column) -> Column:
    """Where a class goes from a node: by the token at the coordinate that the node picks."""
    return F.xxhash64(node, F.element_at(sig, (F.pmod(F.xxhash64(node, F.lit(7)), F.lit(COORDINATES)) + 1).cast("int")))


def path(node: Column, sig: Column) -> Column:
    """The nodes from ``node``, at depth 1, down to DEPTH."""
    return F.aggregate(F.sequence(F.lit(2), F.lit(DEPTH)), F.array(node), lambda found, _: F.concat(found, F.array(child(F.element_at(found, -1), sig))))


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def _edges(pairs: list) -> object:
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["a", "b"])


def trees_for(threshold: float) -> int:
    """The least number of trees that miss a pair at the threshold with probability 1 - RECALL or less, however crowded its nodes are."""
    once = threshold**DEPTH
    return 1 if once >= RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - once))


def loose_edges(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): a spanning forest of the pairs that trees bring together and signatures don't rule out. Most classes are alone, or among few, after one token; the paths
    of the others are laid out to the end at once, and each stops at its first small node."""
    loose = threshold - 4 * math.sqrt(threshold * (1 - threshold) / COORDINATES)
    roots = F.explode(F.array(*(F.lit(r + 1).cast("long") for r in range(trees_for(threshold)))))
    top = classes.select("rep", "sig", roots.alias("root")).select("rep", child(F.col("root"), F.col("sig")).alias("node"))
    counts = materialize(top.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), "mh-nodes")
    top = materialize(top.join(small_side(counts), "node"), "mh-rows")  # large nodes aren't dealt out by their key only to be told apart
    stop, dense = top.where(F.col("n") <= SMALL).select("rep", "node"), None
    crowded = top.where(F.col("n") > SMALL)
    if not crowded.isEmpty():
        paths = crowded.join(classes.select("rep", "sig"), "rep").select("rep", "node", path(F.col("node"), F.col("sig")).alias("nodes"))
        paths = materialize(paths.select("rep", F.col("node").alias("first"), F.posexplode("nodes").alias("depth", "node")).where("depth > 0"), "mh-paths")
        many = materialize(paths.groupBy("depth", "node").agg(F.count("*").alias("n")).where("n > 1"), "mh-path-nodes")
        sized = paths.join(small_side(many), ["depth", "node"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
        at = F.struct("depth", "node", "n")
        ends = sized.groupBy("rep", "first").agg(F.min(F.when(F.col("n") <= SMALL, at)).alias("small"), F.max(at).alias("last"))
        ends = materialize(ends.select("rep", F.coalesce("small", "last").alias("at")).select("rep", "at.node", "at.n").where("n > 1"), "mh-ends")
        stop = stop.unionAll(ends.where(F.col("n") <= SMALL).select("rep", "node"))
        dense = ends.where(F.col("n") > SMALL).select("rep", "node")
        release(paths, many)
    found = _compare_small(stop.join(classes.select("rep", "low"), "rep"), loose)
    if dense is not None:
        least = materialize(dense.groupBy("node").agg(F.min("rep").alias("b")), "mh-dense")
        found = found.unionAll(dense.join(small_side(least), "node").select(F.col("rep").alias("a"), "b").where("a <> b"))
    return materialize(found, "mh-loose-edges")


def alike_neighbours(node: np.ndarray, low: np.ndarray, loose: float) -> Iterator[tuple[int, int]]:
    """Positions of a spanning forest of the alike pairs inside nodes, of rows in order of node: every row with the first, second, third ... behind it, all rows at once."""
    forest, at, lag = Forest(len(node)), np.arange(len(node)), 0
    while True:
        lag += 1
        at = at[: np.searchsorted(at, len(node) - lag)]
        at = at[node[at] == node[at + lag]]
        if not len(at):
            return
        for lo in range(0, len(at), 1 << 15):
            mine = at[lo : lo + (1 << 15)]
            same = (low[mine] == low[mine + lag]).mean(axis=1)
            for i in mine[(same - 1 / 256) / (1 - 1 / 256) >= loose].tolist():  # chance agreement is taken off
                if forest.join(i, i + lag):
                    yield i, i + lag


def _compare_small(rows: DataFrame, loose: float) -> DataFrame:
    """(a, b): the alike pairs of rows (rep, node, low) inside nodes, as spanning forests."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def edges(table):
            node, rep = (table.column(c).to_numpy() for c in ("node", "rep"))
            low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            return _edges([(rep[i], rep[j]) for i, j in alike_neighbours(node, low, loose)])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= COMPARED:  # the last node may go on
                table = pa.Table.from_batches(held)
                node = table.column("node").to_numpy()
                whole = int(np.searchsorted(node, node[-1]))
                yield edges(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                size -= whole
        if size:
            yield edges(pa.Table.from_batches(held))

    ordered = rows.select("node", "rep", "low").repartition("node").sortWithinPartitions("node")
    return ordered.mapInArrow(tidied(run), "a long, b long")


def _intersections(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each set, the sizes of its intersections with those before it, over a shared index of the shingles."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(place, kind="stable")
    posting, first = owner[order], np.searchsorted(place[order], np.arange(len(values) + 1))
    at = 0
    for i, s in enumerate(sets):
        mine = place[at : at + len(s)]
        at += len(s)
        lo, n = first[mine], first[mine + 1] - first[mine]
        rows = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        yield i, np.bincount(posting[rows], minlength=len(sets))[:i]


def _linked(inter: np.ndarray, size: int, sizes: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    num, den = threshold
    return np.flatnonzero(den * inter >= num * (size + sizes - inter))


def confirm_blocks(rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links within (component, chunk) on full sets, as a spanning forest."""

    def run(table):
        import pyarrow as pa

        reps = table.column("rep").to_pylist()
        sets = [np.frombuffer(x, "<u8") for x in table.column("shingles").to_pylist()]
        sizes, forest, pairs = np.array([len(s) for s in sets]), Forest(len(sets)), []
        for i, inter in _intersections(sets):
            for j in _linked(inter, sizes[i], sizes[:i], threshold).tolist():
                if forest.join(i, j):
                    pairs.append((reps[i], reps[j]))
        return pa.Table.from_batches([_edges(pairs)])

    return rows.select("component", "chunk", "rep", "shingles").groupBy("component", "chunk").applyInArrow(run, "a long, b long")


def confirm_rest(rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links between the ``rest`` rows of a (component, chunk, part) and its others, where their labels differ."""

    def run(table):
        import pyarrow as pa

        reps, labels, rest = (table.column(c).to_pylist() for c in ("rep", "label", "rest"))
        sets = [np.frombuffer(x, "<u8") for x in table.column("shingles").to_pylist()]
        sizes, pairs, seen = np.array([len(s) for s in sets]), [], set()
        for i, inter in _intersections(sets):
            for j in _linked(inter, sizes[i], sizes[:i], threshold).tolist():
                if rest[i] != rest[j] and labels[i] != labels[j] and (key := frozenset((labels[i], labels[j]))) not in seen:
                    seen.add(key)
                    pairs.append((reps[i], reps[j]))
        return pa.Table.from_batches([_edges(pairs)])

    return rows.groupBy("component", "chunk", "part").applyInArrow(run, "a long, b long")


def group_counts(sets: DataFrame) -> DataFrame:
    """(component, chunk, shingle, n): in how many sets of its whole group each shingle of a block stands, if in more than one; counted in blocks first."""

    def run(table):
        import pyarrow as pa

        values, counts = np.unique(np.concatenate([np.frombuffer(x, "<i8") for x in table.column("shingles").to_pylist()]), return_counts=True)
        same = [pa.array(np.full(len(values), table.column(c)[0].as_py())) for c in ("component", "chunk")]
        return pa.Table.from_arrays([same[0], same[1].cast(pa.int32()), pa.array(values), pa.array(counts)], names=["component", "chunk", "shingle", "n"])

    blocks = sets.select("component", "chunk", "shingles").groupBy("component", "chunk")
    partial = materialize(blocks.applyInArrow(run, "component long, chunk int, shingle long, n long"), "mh-partial")
    total = partial.groupBy("component", "shingle").agg(F.sum("n").alias("n")).where("n > 1")
    out = materialize(partial.drop("n").join(total, ["component", "shingle"]).select("component", "chunk", "shingle", "n"), "mh-counts")
    release(partial)
    return out


def prefixes(sets: DataFrame, counts: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(component, shingle, rep, size, at, first): the rarest shingles of each set, by the group's counts and then by value, that a link of the set with a smaller one needs;
    ``first`` are those that one with a larger set needs. Shingles of one set alone have places but no rows."""
    num, den = threshold

    def run(rows, ranked):
        import pyarrow as pa

        known, n = (ranked.column(c).to_numpy() for c in ("shingle", "n"))
        order = np.argsort(known)
        known, n = known[order], n[order]
        found: list[list[np.ndarray]] = [[], [], [], [], []]
        for rep, raw in zip(rows.column("rep").to_pylist(), rows.column("shingles").to_pylist()):
            s = np.frombuffer(raw, "<i8")
            often = np.ones(len(s), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                often = np.where(known[at] == s, n[at], 1)
            smaller = len(s) + (-num * len(s)) // den + 1  # size - ceil(size * threshold) + 1
            larger = len(s) + (-2 * num * len(s)) // (num + den) + 1
            place = np.lexsort((s, often))[:smaller]
            at = np.flatnonzero(often[place] > 1)
            for column, values in zip(found, (s[place[at]], np.full(len(at), rep), np.full(len(at), len(s)), at, at < larger)):
                column.append(values)
        columns = [np.concatenate(c) for c in found]
        component = np.full(len(columns[0]), rows.column("component")[0].as_py() if rows.num_rows else 0)
        return pa.Table.from_arrays([pa.array(component), *(pa.array(c) for c in columns)], names=["component", "shingle", "rep", "size", "at", "first"])

    key = ("component", "chunk")
    grouped = sets.select(*key, "rep", "shingles").groupBy(*key).cogroup(counts.groupBy(*key))
    return grouped.applyInArrow(run, "component long, shingle long, rep long, size long, at long, first boolean")


def meetings(entries: DataFrame, facts: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(component, chunk, part, rep, rest): the rows that a link across labels may have, and the blocks where it would be confirmed. ``facts`` (rep, label, rest, chunk, part)."""
    num, den = threshold
    rows = entries.join(facts, ["component", "rep"])
    side = lambda c: rows.select("component", "shingle", *(F.col(x).alias(f"{c}_{x}") for x in ("rep", "size", "at", "first", "label", "rest", "chunk", "part")))
    least = side("y").where("y_first")
    overlap = F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at"))  # at most, from the shingle they share on
    may = (F.col("y_label") != F.col("x_label")) & (F.struct("y_size", "y_rep") < F.struct("x_size", "x_rep")) & (F.col("y_size") * den >= F.col("x_size") * num)
    may &= overlap * (num + den) >= (F.col("x_size") + F.col("y_size")) * num
    on = ["component", "shingle"]
    met = []
    for ys, xs, own, other in ((least.where("y_rest"), side("x"), "y", "x"), (least.where("NOT y_rest"), side("x").where("x_rest"), "x", "y")):
        both = ys.join(xs, on).where(may)
        rested = F.struct(F.col(f"{own}_rep").alias("rep"), F.lit(True).alias("rest"))
        held = F.struct(F.col(f"{other}_rep").alias("rep"), F.lit(False).alias("rest"))
        met.append(both.select("component", F.col(f"{other}_chunk").alias("chunk"), F.col(f"{own}_part").alias("part"), F.explode(F.array(rested, held)).alias("row")))
    return met[0].unionAll(met[1]).select("component", "chunk", "part", "row.rep", "row.rest").distinct()


def full_sets(docs: DataFrame, members: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """``members`` (rep, ...), a written table, with their shingles from their texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([shingles(t.as_py(), k).tobytes() for t in batch.column(0)], pa.binary())], names=[*batch.schema.names[1:], "shingles"])

    from pyspark.sql import types as T

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("__text"))
    rows = texts.join(small_side(members), "rep").select("__text", *members.columns).where(F.length("__text") > 0)
    return text_batches(rows, tidied(run), T.StructType([*members.schema.fields, T.StructField("shingles", T.BinaryType())])).where(F.length("shingles") > 0)


def exact_links(docs: DataFrame, groups: DataFrame, k: int, threshold: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """(a, b): a spanning forest of the links inside ``groups`` (node, component, n_shingles)."""
    pivots = [F.min_by("node", F.xxhash64("node", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)]
    blocks_of = lambda n, size: F.ceil(F.greatest(n / CHUNK, size / CHUNK_SHINGLES)).cast("int")
    facts = materialize(groups.groupBy("component").agg(blocks_of(F.count("*"), F.sum("n_shingles")).alias("chunks"), *pivots), "mh-groups")
    is_pivot = F.array_contains(F.array(*(F.col(f"p{i}") for i in range(PIVOTS))), F.col("node"))
    members = groups.join(facts, "component").select("component", F.col("node").alias("rep"), "chunks", F.when(F.col("chunks") > 1, is_pivot).otherwise(F.lit(False)).alias("pivot"))
    members = materialize(members, "mh-members")
    sets = materialize(full_sets(docs, members, k, id_col, text_col), "mh-sets")
    release(facts)
    own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    to = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own))
    links = materialize(confirm_blocks(sets.withColumn("chunk", F.explode(to)), threshold), "mh-links")
    many = sets.where("chunks > 1")
    if many.isEmpty():
        release(members, sets)
        return links
    # what isn't joined to the largest component of its group meets others by prefixes
    labels = connected_components(links).withColumnRenamed("node", "rep").withColumnRenamed("component", "label")
    size = (F.length("shingles") / 8).cast("long").alias("size")
    placed = many.select("component", "rep", own.alias("chunk"), size).join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    placed = materialize(placed, "mh-labelled")
    parts = placed.groupBy("component", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    main = parts.groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("size").alias("size"), F.max_by("size", F.struct("n", "label")).alias("main_size"))
    n_parts = blocks_of(F.col("n") - F.col("most"), F.col("size") - F.col("main_size"))
    main = materialize(main.where("n > most").select("component", "main", n_parts.alias("parts")), "mh-main")
    if main.isEmpty():
        release(members, sets, placed, main)
        return links
    part = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("parts")).cast("int")
    rows = materialize(placed.join(main, "component").select("component", "rep", "chunk", "label", (F.col("label") != F.col("main")).alias("rest"), part.alias("part")), "mh-rows")
    split = many.join(small_side(main).select("component"), "component").select("component", own.alias("chunk"), "rep", "shingles")
    counts = group_counts(split)
    entries = materialize(prefixes(split, counts, threshold), "mh-prefixes")
    met = materialize(meetings(entries, rows, threshold), "mh-met")
    release(placed, main, counts, entries)
    candidates = met.join(rows.select("rep", "label"), "rep").join(many.select("rep", "shingles"), "rep").select("component", "chunk", "part", "rep", "rest", "label", "shingles")
    more = materialize(confirm_rest(candidates, threshold), "mh-links")
    release(members, sets, rows, met)
    return links.unionAll(more)


def near_duplicates(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``; links are similarities of threshold[0] / threshold[1] or more."""
    sketched = materialize(sketch(docs, k, id_col, text_col), "mh-sketch")
    some = sketched.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialize(some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("low").alias("low")), "mh-classes")
    edges = loose_edges(classes, threshold[0] / threshold[1])
    sizes = classes.select(F.col("rep").alias("node"), "n_shingles")
    groups = materialize(connected_components(edges).join(sizes, "node"), "mh-loose")
    release(edges)
    found = materialize(connected_components(exact_links(docs, groups, k, threshold, id_col, text_col)), "mh-components")
    release(groups)
    same = classes.where("n > 1").select(F.col("digest").alias("__digest"), "rep")
    rows = sketched.select("doc_id", "n_shingles", "digest").join(same, F.col("digest") == F.col("__digest"), "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    rows = rows.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, threshold=(85, 100))


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)] END) AS g FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 85 * (x.k + y.k - c)),
r(i, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.i WHERE r.c < l.b),
m AS (SELECT i, min(c) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM documents d JOIN m ON m.i = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

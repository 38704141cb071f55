"""Embedding near-dedup: subspace pigeonhole join.

Unit vectors u, v of cosine c or more lie within squared distance D = 2 - 2c. A fixed rotation spreads their energy evenly over the dimensions,
which are cut into ``BLOCKS`` blocks; each block gets a share of D in proportion to its dimensions. A linked pair must keep to the share
in at least one block, so that the union of the blocks' range joins holds every link, and all its pairs are verified by cosine.

A block's range join: a label of ``LEAF`` classes or fewer is one task's, for all blocks. A crowded label's block is parted into cells of about as many by a tree of
splits along its axes, learned from a bounded sample; a row that stands closer below a split than the radius goes over it too, as far as the squares of all that it lacks
keep to the budget. Every row is placed. Rows of a cell that no split parts (a dense cluster) are dealt to tiles that meet pairwise. A task verifies what it finds
and counts a pair only in the one cell that is the pair's, and only if no earlier block finds it, so that no pair leaves it: only each row's number of links and a
spanning forest.

Defined results: equal vectors of a label are one class, expanded at the end; rows of null label, or whose vector is null, empty, zero or
holds null or non-finite components, link with nothing and are components of their own; vectors of other length don't meet; rows
that share an id are one node of the components, each with its own links; an empty table gives none; other columns, whatever their names, aren't looked at; a vector may
have any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.files import small_side, tidied
from gridloom.plans.components import connected_components
from gridloom.plans.shared import materialize

BLOCKS, LEAF = 4, 1 << 14
#: Rows that a round of splits learns from, in all and at least for a split; rounds; right turns in a round's tree.
SAMPLE, FEW, ROUNDS, TURNS = 1 << 15, 16, 3, 20
#: Against rounding: what passes is verified exactly.
SLACK = 1e-7


@cache
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated; a row's result doesn't depend on the rows beside it."""
    unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
    return np.einsum("ij,jk->ik", unit, rotation(vectors.shape[1]))


def cuts(dim: int) -> list[tuple[int, int]]:
    n = min(BLOCKS, dim)
    return [(dim * b // n, dim * (b + 1) // n) for b in range(n)]


def usable(embedding: str = "embedding") -> F.Column:
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


# -- cells of a block -------------------------------------------------------------------------------------------


def grow(x: np.ndarray, rows: float, radius: float) -> list[tuple[int, float, int, int]]:
    """A tree over sampled rows of a block that stand for ``rows`` rows each: nodes (axis, at, left, right), or (-1, 0, right turns on the way, 0) for a cell. Left of a
    split are the rows below it, right of it the others and those below that may have a partner there. No split is made that hardly parts anything."""
    nodes: list[tuple[int, float, int, int]] = []

    def add(mine: np.ndarray, gaps: np.ndarray, turns: int) -> int:
        me = len(nodes)
        nodes.append((-1, 0.0, turns, 0))
        if len(mine) * rows <= LEAF or len(mine) < 2 * FEW or turns == TURNS:
            return me
        own, best = x[mine], (len(mine) ** 2, 0, 0.0)
        for q in (0.5, 0.4, 0.6, 0.3, 0.7):
            at = np.quantile(own, q, axis=0)
            size = (own < at).sum(axis=0) ** 2 + (own >= at - radius).sum(axis=0) ** 2  # pairs on both sides
            k = int(np.argmin(size))
            if size[k] < best[0]:
                best = (int(size[k]), k, float(at[k]))
        if best[0] > 0.92 * len(mine) ** 2:
            return me
        _, axis, at = best
        below, over, far = _split(own, gaps, axis, at, radius)
        nodes[me] = (axis, at, add(mine[below], gaps[below], turns), add(mine[over], far, turns + 1))
        return me

    add(np.arange(len(x)), np.zeros(x.shape), 0)
    return nodes


def _split(x: np.ndarray, gaps: np.ndarray, axis: int, at: float, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the rows below a split, of those that go over it, and the latter's gaps: what a row lacks to the splits it has gone over from below, by axis. A partner
    stands beyond all of them, so their squares must keep to the radius together."""
    below = x[:, axis] < at
    far = gaps.copy()
    far[:, axis] = np.maximum(far[:, axis], np.where(below, at - x[:, axis], 0.0))
    over = np.flatnonzero(~below | ((far**2).sum(axis=1) <= radius**2))
    return np.flatnonzero(below), over, far[over]


def route(nodes: list, x: np.ndarray, radius: float) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(cell, right turns, positions, homes) for each cell that rows reach: a bit of homes for each right turn tells whether the row stands on that side."""
    found = []

    def walk(node: int, mine: np.ndarray, gaps: np.ndarray, homes: np.ndarray, turns: int) -> None:
        axis, at, left, right = nodes[node]
        if not len(mine):
            return
        if axis < 0:
            found.append((node, turns, mine, homes))
            return
        below, over, far = _split(x[mine], gaps, axis, at, radius)
        walk(left, mine[below], gaps[below], homes[below], turns)
        stands = x[mine[over], axis] >= at
        walk(right, mine[over], far, homes[over] | stands.astype(np.int64) << turns, turns + 1)

    walk(0, np.arange(len(x)), np.zeros(x.shape), np.zeros(len(x), np.int64), 0)
    return found


def _radius(total: float, dim: int, block: int) -> float:
    lo, hi = cuts(dim)[block]
    return float(np.sqrt(total * (hi - lo) / dim) + SLACK)


PLACED = "dim int, block int, cell long, turns int, homes long, cls long, rep long, copies long, vector binary"


def place(classes: DataFrame, cosine: float, crowded: frozenset, rounds: list[dict]) -> DataFrame:
    """Each class in the cells of each block, through the trees of all rounds, by (label, dim, block, cell) that they split. Classes of a (label, dim) that isn't
    crowded stand once, with block -1: all blocks' joins fit in one task."""
    total = 2 - 2 * cosine
    shared = classes.sparkSession.sparkContext.broadcast((crowded, rounds))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        crowded, rounds = shared.value
        for batch in batches:
            label, cls, rep, copies, vectors = batch.columns
            lengths = np.array([len(v) for v in vectors])
            flat = vectors.values.to_numpy(zero_copy_only=False) if batch.num_rows else np.empty(0)
            flat = flat[vectors.offsets[0].as_py() :]
            starts = np.concatenate(([0], np.cumsum(lengths)))
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(label.to_pylist(), lengths.tolist())):
                groups.setdefault(key, []).append(i)
            for (name, dim), mine in groups.items():
                raw = np.stack([flat[starts[i] : starts[i] + dim] for i in mine]).astype("<f4" if vectors.type.value_type == pa.float32() else "<f8")
                data, mine = pa.array([r.tobytes() for r in raw], pa.binary()), np.array(mine)
                parts = [(-1, 0, 0, np.arange(len(mine)), np.zeros(len(mine), np.int64))]
                if (name, dim) in crowded:
                    u, parts = rotated(raw.astype(np.float64)), []
                    for b, (lo, hi) in enumerate(cuts(dim)):
                        level = [(b, 0, 0, np.arange(len(mine)), np.zeros(len(mine), np.int64))]
                        for trees in rounds:
                            level = [piece for part in level for piece in _through(trees.get((name, dim, b, part[1])), part, u[:, lo:hi], _radius(total, dim, b))]
                        parts += level
                for b, cell, turns, at, homes in parts:
                    take, n = pa.array(mine[at]), len(at)
                    yield pa.RecordBatch.from_arrays([label.take(take), pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, b, np.int32)), pa.array(np.full(n, cell)), pa.array(np.full(n, turns, np.int32)), pa.array(homes), cls.take(take), rep.take(take), copies.take(take), data.take(pa.array(at))], names=["label", "dim", "block", "cell", "turns", "homes", "cls", "rep", "copies", "vector"])

    kind = dict(classes.dtypes)["label"]
    return classes.select("label", "cls", "rep", "copies", "embedding").mapInArrow(tidied(run), f"label {kind}, {PLACED}")


def _through(tree: list | None, part: tuple, x: np.ndarray, radius: float) -> list[tuple]:
    if tree is None:
        return [part]
    b, cell, turns, at, homes = part
    return [(b, cell << 20 | node + 1, turns + more, at[own], homes[own] | bits << turns) for node, more, own, bits in route(tree, x[at], radius)]


def fit_cells(classes: DataFrame, cosine: float) -> tuple[frozenset, list[dict]]:
    """The (label, dim) of more than LEAF classes, and trees that part their blocks into cells of about LEAF rows, learned from SAMPLE rows a round at most. A round
    splits what is still crowded after the one before; what no split parts stays as it is."""
    total = 2 - 2 * cosine
    sizes = classes.groupBy("label", F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).where(F.col("n") > LEAF).collect()
    crowded = frozenset((r.label, r.dim) for r in sizes)
    open_ = {(r.label, r.dim, b, 0): r.n for r in sizes for b in range(len(cuts(r.dim)))}
    rounds: list[dict] = []
    key = ("label", "dim", "block", "cell")
    while open_ and len(rounds) < ROUNDS:
        # before the first round every block holds all classes of its label
        rows = place(classes, cosine, crowded, rounds).where("block >= 0")
        if rounds:
            known = classes.sparkSession.createDataFrame(list(open_), rows.select(*key).schema)
            rows = rows.join(F.broadcast(known), list(key), "left_semi")
        rate = min(1.0, SAMPLE / sum(open_.values()))
        some = rows.where(F.pmod(F.xxhash64("cls", F.lit(len(rounds))), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1).limit(2 * SAMPLE)
        samples: dict[tuple, list[bytes]] = {}
        for r in some.select(*key, "vector").toLocalIterator():
            samples.setdefault((r.label, r.dim, r.block, r.cell), []).append(bytes(r.vector))
        trees = {}
        for (label, dim, b, cell), found in samples.items():
            x = np.frombuffer(b"".join(sorted(found)), f"<f{len(found[0]) // dim}").reshape(-1, dim).astype(np.float64)
            lo, hi = cuts(dim)[b]
            tree = grow(rotated(x)[:, lo:hi], open_[label, dim, b, cell] / len(x), _radius(total, dim, b))
            if len(tree) > 1:
                trees[label, dim, b, cell] = tree
        if not trees:
            break
        rounds.append(trees)
        left = place(classes, cosine, crowded, rounds).where("block >= 0").groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > 2 * LEAF)
        tried = {(*k[:3], k[3] << 20 | node + 1) for k, t in trees.items() for node, n in enumerate(t) if n[0] < 0}
        open_ = {k: r.n for r in left.collect() if (k := (r.label, r.dim, r.block, r.cell)) in tried}
    return crowded, rounds


def cell_links(rows: DataFrame, cosine: float, wide: bool) -> DataFrame:
    """(a, b, n): the number of vectors linked to class a's, in other classes, where b is null, else an edge of two classes' smallest ids."""
    total = 2 - 2 * cosine

    def run(table):
        import pyarrow as pa

        from gridloom.llm.minhash_join import Forest

        dim, block, turns = (table.column(c)[0].as_py() for c in ("dim", "block", "turns"))
        i_tile, j_tile = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        cls, rep, copies, homes, tile = (table.column(c).to_numpy() for c in ("cls", "rep", "copies", "homes", "tile"))
        x = np.frombuffer(b"".join(table.column("vector").to_pylist()), "<f8" if wide else "<f4").reshape(-1, dim).astype(np.float64)
        u, norm = rotated(x), np.sqrt(np.einsum("ij,ij->i", x, x))
        bounds, everyone = cuts(dim), (1 << turns) - 1
        shares = [total * (hi - lo) / dim + SLACK for lo, hi in bounds]
        links, forest, edges = np.zeros(len(x), np.int64), Forest(len(x)), []
        for b in range(len(bounds)) if block < 0 else [block]:
            lo, hi = bounds[b]
            axis = lo + int(np.argmax(u[:, lo:hi].std(axis=0)))  # pairs are looked for along the block's widest axis
            order = np.argsort(u[:, axis], kind="stable")
            line, sub = u[order, axis], u[order, lo:hi]
            square = np.einsum("ij,ij->i", sub, sub)
            end = np.searchsorted(line, line + np.sqrt(shares[b]) + SLACK, "right")
            step = max(16, (1 << 20) // len(x))
            for s in range(0, len(x), step):
                e = min(len(x), s + step)
                t = int(end[e - 1])
                near = square[s:e, None] + square[None, s:t] - 2 * sub[s:e] @ sub[s:t].T <= shares[b] + SLACK
                p, q = np.nonzero(near)
                ok = q > p
                p, q = order[p[ok] + s], order[q[ok] + s]
                # once: in the cell where one of the two stands, at every turn, and in the pair of tiles that is theirs
                ok = homes[p] | homes[q] == everyone
                if i_tile != j_tile:
                    ok &= tile[p] != tile[q]
                p, q = p[ok], q[ok]
                for f in range(0, len(p), 1 << 16):
                    v, w = p[f : f + (1 << 16)], q[f : f + (1 << 16)]
                    apart = (u[v] - u[w]) ** 2
                    by_block = [np.einsum("ij->i", apart[:, l:h]) for l, h in bounds]
                    mine = by_block[b] <= shares[b]
                    for k in range(b):  # an earlier block has it
                        mine &= by_block[k] > shares[k]
                    mine &= np.einsum("ij,ij->i", x[v], x[w]) / (norm[v] * norm[w]) >= cosine
                    v, w = v[mine], w[mine]
                    links += np.bincount(v, copies[w], len(x)).astype(np.int64) + np.bincount(w, copies[v], len(x)).astype(np.int64)
                    edges += [(m, n) for m, n in zip(v.tolist(), w.tolist()) if forest.join(m, n)]
        some = np.flatnonzero(links)
        a = np.concatenate((cls[some], rep[[v for v, _ in edges]])) if edges else cls[some]
        b = [None] * len(some) + [int(rep[w]) for _, w in edges]
        n = [*links[some].tolist(), *[None] * len(edges)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return rows.groupBy("label", "dim", "block", "cell", "i", "j").applyInArrow(run, "a long, b long, n long")


def tiled_cells(classes: DataFrame, cosine: float) -> DataFrame:
    """``place``'s rows, those of a cell that no split parts dealt to tiles that meet pairwise: (i, j) is a pair of tiles, ``tile`` the row's own."""
    crowded, rounds = fit_cells(classes, cosine)
    placed = place(classes, cosine, crowded, rounds)
    key = ["label", "dim", "block", "cell"]
    if not crowded:
        return placed.withColumn("tile", F.lit(0)).withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    large = materialize(placed.groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") > 2 * LEAF), "vec-large")
    tiled = placed.join(small_side(large), key, "left").withColumn("tiles", F.ceil(F.coalesce("rows", F.lit(1)) / LEAF).cast("int"))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return tiled.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other")).drop("rows", "tiles", "other")


def near_vectors(rows: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row: links join vectors of equal label and a cosine of ``cosine`` or more."""
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    wide = "double" in dict(rows.dtypes)["embedding"]
    good = usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    key = F.when(good, F.sha2(F.array_join(F.transform("embedding", lambda v: (v + 0.0).cast("string")), ","), 256))
    keyed = materialize(rows.withColumn("vkey", key), "vec-keyed")
    classes = keyed.where("vkey IS NOT NULL").groupBy("label", "vkey").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = materialize(classes.withColumn("cls", F.xxhash64("label", "vkey")), "vec-classes")
    found = materialize(cell_links(tiled_cells(classes, cosine), cosine, wide), "vec-links")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    # copies of a class are one node: its smallest id
    components = connected_components(found.where("b IS NOT NULL")).withColumnRenamed("node", "rep")
    facts = classes.select("label", "vkey", "cls", "rep", "copies").join(links, "cls", "left").join(components, "rep", "left")
    facts = materialize(facts.where("copies > 1 OR n > 0").select(F.col("label").alias("__label"), F.col("vkey").alias("__key"), "rep", "copies", "n", "component"), "vec-facts")
    joined = keyed.select("vec_id", "label", "vkey").join(facts, (F.col("label") == F.col("__label")) & (F.col("vkey") == F.col("__key")), "left")
    component = F.coalesce("component", "rep", "vec_id")
    n_links = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("n", F.lit(0))
    return joined.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op6_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(n, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.n WHERE r.c < l.b),
m AS (SELECT n, min(c) AS c FROM r GROUP BY n)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept FROM embeddings e JOIN m ON m.n = e.vec_id
"""

"""Connected components of an edge table, by alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.shared import materialize, release


#: Edges that a round takes in one go, each node's minimum sent to all tasks; beyond, minima are written and joined.
FEW_EDGES = 500_000


def _written(edges: DataFrame, rows: int | None = None) -> tuple[DataFrame, tuple]:
    """``edges`` written, and a digest of them: their number and a sum of hashes."""
    table = materialize(edges, "cc-edges", rows)
    row = table.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
    return table, (row.n, row.s)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _round_at_once(edges: DataFrame) -> DataFrame:
    """A round in one job, for edges of a known, small number."""
    both = _both_ways(edges)
    least = F.broadcast(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    least = F.broadcast(large.groupBy("a").agg(F.min("b").alias("m")))
    small = large.join(least, "a").where("b >= m").select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))
    return small.distinct()


def _round_by_tables(edges: DataFrame, n: int) -> DataFrame:
    both = _both_ways(edges)
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least", n)
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    large = materialize(large.where("a > b").distinct(), "cc-large", n)
    release(edges, least)
    least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "cc-least", n)
    small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = small.unionAll(least.select("a", F.col("m").alias("b"))).distinct()
    out._read_from = (large, least)
    return out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of an edge, component the smallest node it reaches.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest node in sight; rounds grow with the logarithm of
    the longest path. Minima are aggregated map-side, and joined from a written table (sent to all tasks where edges are few), so that a node with very many
    edges can be split over tasks. A round ends at files, never at a long lineage. Edges with a null end are left out; a loop makes its node a component.
    """
    whole = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    whole = materialize(whole.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).distinct(), "cc-input")
    loops = whole.where("a = b").select("a")
    edges, state = _written(whole.where("a > b"))
    last = None
    for _ in range(max_rounds):
        if state == last or state[0] == 0:
            break
        last, before = state, edges
        new = _round_at_once(edges) if state[0] <= FEW_EDGES else _round_by_tables(edges, state[0])
        edges, state = _written(new, state[0])
        release(before, *getattr(new, "_read_from", ()))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node")).unionAll(loops.select(F.col("a").alias("node"))).distinct()
    return ends.unionAll(roots.join(ends.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))

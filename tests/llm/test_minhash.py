import random
from collections import defaultdict

import pytest

from gridloom.llm import minhash_join as M
from gridloom.plans.components import connected_components


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    """doc_id -> (sizes, component) for rows (doc_id, text)."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and i is not None and j is not None and den * len(x & y) >= num * len(x | y):
                lo, hi = sorted((root(i), root(j)))
                up[hi] = lo
    return [(i, len(s), None if i is None else root(i), i is not None and root(i) == i) for i, s in sets]


def near_rows(groups, size, seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        words = [f"w{rng.randint(0, 999)}" for _ in range(150)]
        for _ in range(size):
            mine = list(words)
            for _ in range(rng.randint(0, 9)):
                mine[rng.randrange(len(mine))] = f"v{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(mine)))
    return rows


def run(spark, tmp_path, rows, **kw):
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(str(tmp_path))
    return sorted(map(tuple, M.near_duplicates(spark.read.parquet(str(tmp_path)), **kw).collect()), key=repr)


@pytest.mark.parametrize("k, threshold", [(3, (85, 100)), (5, (80, 100))])
def test_links_by_brute_force(spark, tmp_path, k, threshold):
    rows = near_rows(12, 8)
    assert run(spark, tmp_path, rows, k=k, threshold=threshold) == sorted(brute(rows, k, *threshold), key=repr)


def test_large_group_is_cut_into_blocks(spark, tmp_path, monkeypatch):
    """Small limits drive a group through deep trees, several blocks with pivots, and the pass over what pivots don't reach."""
    for name, value in (("SMALL", 4), ("DEPTH", 2), ("CHUNK", 8), ("PIVOTS", 1), ("COMPARED", 3)):
        monkeypatch.setattr(M, name, value)
    rows = near_rows(3, 40, seed=2)
    bridge = [(len(rows) + i, t) for i, (_, t) in enumerate(rows[:40:9])]
    rows += bridge
    assert run(spark, tmp_path, rows, k=3, threshold=(85, 100)) == sorted(brute(rows, 3, 85, 100), key=repr)


def template_rows(n, shared, own, seed=3):
    """Pages of a template: ``shared`` words of all, ``own`` words of one."""
    rng = random.Random(seed)
    words = [f"t{rng.randint(0, 10**6)}" for _ in range(shared)]
    return [(i, " ".join(words + [f"o{i}x{j}" for j in range(own)])) for i in range(n)]


def test_template_pages_with_links_across_blocks(spark, tmp_path, monkeypatch):
    """Unlinked pages of a template, of sizes that differ, and some near copies of them that only prefixes bring together."""
    for name, value in (("SMALL", 4), ("DEPTH", 1), ("CHUNK", 8), ("PIVOTS", 1)):
        monkeypatch.setattr(M, name, value)
    rows = template_rows(60, 100, 24) + [(60 + i, t) for i, (_, t) in enumerate(template_rows(20, 100, 30, seed=3))]
    rows += [(80 + i, " ".join(t.split()[: -1 - i % 4])) for i, (_, t) in enumerate(rows[:40:3])]
    assert run(spark, tmp_path, rows, k=3, threshold=(85, 100)) == sorted(brute(rows, 3, 85, 100), key=repr)


def test_template_pages_ship_no_sets_to_each_other(spark, tmp_path, monkeypatch):
    """Pages of one loose group whose similarity is just below the threshold: what is shipped to confirm links doesn't grow with the square of the group."""
    monkeypatch.setattr(M, "CHUNK", 16)
    shipped = []
    monkeypatch.setattr(M, "confirm_rest", lambda rows, threshold, real=M.confirm_rest: shipped.append(rows.count()) or real(rows, threshold))
    spark.createDataFrame(template_rows(200, 200, 22), "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    sizes = {len(shingles(r.text, 3)) for r in docs.collect()}
    group = docs.select(docs.doc_id.alias("node")).selectExpr("node", "0L AS component", f"{max(sizes)}L AS n_shingles")
    assert M.exact_links(docs, M.materialize(group, "t"), 3, (85, 100), "doc_id", "text").count() == 0
    assert shipped == [0]
    links = connected_components(M.exact_links(docs, M.materialize(group, "t"), 3, (80, 100), "doc_id", "text"))
    assert {(r.node, r.component) for r in links.collect()} == {(i, 0) for i in range(200)}


def test_long_sets_are_cut_into_blocks_by_their_shingles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "CHUNK_SHINGLES", 400)
    for name, value in (("SMALL", 4), ("DEPTH", 1)):
        monkeypatch.setattr(M, name, value)
    rows = near_rows(2, 20, seed=5)
    assert run(spark, tmp_path, rows, k=3, threshold=(85, 100)) == sorted(brute(rows, 3, 85, 100), key=repr)


def test_contract_on_edge_cases(spark, edge_dir, edge_rows):
    got = sorted(map(tuple, M.op9_minhash(spark, edge_dir).collect()), key=repr)
    assert got == sorted(brute([(i, t) for i, t, *_ in edge_rows], 3, 85, 100), key=repr)


def test_empty(spark, empty_dir):
    assert M.op9_minhash(spark, empty_dir).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 300)] + [(None, 3), (7, 7)]
    up = defaultdict(lambda: None)

    def root(i):
        while up[i] is not None:
            i = up[i]
        return i

    nodes = set()
    for a, b in edges:
        if a is not None:
            nodes |= {a, b}
            lo, hi = sorted((root(a), root(b)))
            if lo != hi:
                up[hi] = lo
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in nodes}


@pytest.mark.parametrize("threshold, trees", [(0.85, 15), (0.8, 23)])
def test_trees_follow_from_threshold_and_recall(threshold, trees):
    assert M.trees_for(threshold) == trees
    assert (1 - threshold**M.DEPTH) ** trees <= 1 - M.RECALL < (1 - threshold**M.DEPTH) ** (trees - 1)
    assert M.trees_for(1.0) == 1


def test_recall_where_every_node_is_crowded(spark):
    """2,000 pairs of signatures at 0.8, with the constants in use; a pair meets only where it shares all DEPTH tokens of a tree."""
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    n, trees = 2000, M.trees_for(0.8)
    one = rng.integers(-(1 << 31), 1 << 31, (n, M.COORDINATES))
    two = np.where(rng.random(one.shape) < 0.8, one, rng.integers(-(1 << 31), 1 << 31, one.shape))
    rows = spark.createDataFrame([(i, side, sig) for side, sigs in enumerate((one, two)) for i, sig in enumerate(sigs.tolist())], "i int, side int, sig array<int>")
    roots = F.explode(F.array(*(F.lit(r + 1).cast("long") for r in range(trees))))
    ends = rows.select("i", "side", "sig", roots.alias("root")).select("i", "side", M.path(M.child(F.col("root"), F.col("sig")), F.col("sig")).alias("nodes"))
    assert ends.select(F.size("nodes")).distinct().collect() == [(M.DEPTH,)]
    met = ends.groupBy("i", F.element_at("nodes", -1)).agg(F.countDistinct("side").alias("sides")).where("sides = 2").select("i").distinct().count()
    assert met / n >= 0.995


def test_words_are_told_apart_as_strings_are(monkeypatch):
    """Equal hashes for equal words, others for others; pieces of any size, words that are longer than a piece."""
    rng = random.Random(6)
    texts = ["", None, " \t\n", "one", "a b\x0bc\x0cd\r\ne", "É é İ ı ẞ", "x" * 300 + " y " + "x" * 300, "\x1c\x85 a\u00a0b", "ab ba aab aba " * 50]
    texts += [" ".join("".join(rng.choice("abAB1é") for _ in range(rng.randint(1, 90))) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    whole = [M.word_hashes(t) for t in texts]
    seen, back = {}, {}
    for t, found in zip(texts, whole):
        words = (t or "").encode().lower().split()
        assert len(words) == len(found)
        for w, h in zip(words, found.tolist()):
            assert seen.setdefault(w, h) == h and back.setdefault(h, w) == w
    monkeypatch.setattr(M, "PIECE", 70)
    M._tables.cache_clear()
    try:
        assert all((M.word_hashes(t) == w).all() for t, w in zip(texts, whole))
    finally:
        M._tables.cache_clear()


def test_alike_neighbours_by_brute_force():
    import numpy as np

    rng = np.random.default_rng(3)
    node = np.sort(rng.integers(0, 40, 300))
    base = rng.integers(0, 256, (8, M.COORDINATES))
    low = np.where(rng.random((300, M.COORDINATES)) < 0.12, rng.integers(0, 256, (300, M.COORDINATES)), base[rng.integers(0, 8, 300)]).astype(np.uint8)

    def groups(pairs):
        forest = M.Forest(300)
        for i, j in pairs:
            forest.join(i, j)
        return [forest.root(i) for i in range(300)]

    every = [(i, j) for j in range(300) for i in range(j) if node[i] == node[j] and ((low[i] == low[j]).mean() - 1 / 256) / (1 - 1 / 256) >= 0.7]
    got = list(M.alike_neighbours(node, low, 0.7))
    assert every and len(got) < len(every) and groups(got) == groups(every)
    assert list(M.alike_neighbours(node[:0], low[:0], 0.7)) == []

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import vector_join as V


def brute(rows, cosine=0.98):
    good = [k for k, (i, v, l) in enumerate(rows) if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    up = {i: i for i, *_ in rows if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(rows)
    for a in good:
        for b in good:
            (i, v, l), (j, w, m) = rows[a], rows[b]
            if b < a and l == m and len(v) == len(w):
                x, y = np.float32(v).astype(float), np.float32(w).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    lo, hi = sorted((root(i), root(j)))
                    up[hi] = lo
    return sorted(((i, n, None if i is None else root(i), i is not None and root(i) == i) for (i, *_), n in zip(rows, links)), key=repr)


def vectors():
    rng = np.random.default_rng(1)
    rows = []
    for label in range(3):
        base = rng.standard_normal((8, 16))
        for b in base:
            for _ in range(6):
                rows.append([(b + rng.standard_normal(16) * 0.12).tolist(), label])
        rows += [[base[0].tolist(), label]] * 3 + [[(2 * base[0]).tolist(), label]]
    rows += [[None, 0], [[0.0] * 16, 0], [[float("nan")] * 16, 0], [[float("inf")] + [1.0] * 15, 0], [[None] + [1.0] * 15, 0], [[], 0], [rows[0][0], None], [rows[0][0][:8], 0], [rows[0][0][:8], 0], [[1.0], 1], [[3.0], 1], [[-1.0], 1], [[-0.0] * 16, 0]]
    out = [(i, v, l) for i, (v, l) in enumerate(rows)]
    return out + [(None, rows[0][0], 0), (0, rows[20][0], 1)]


@pytest.mark.parametrize("leaf", [4, 16, 4096])
def test_links_by_brute_force(spark, tmp_path, monkeypatch, leaf):
    monkeypatch.setattr(V, "LEAF", leaf)
    monkeypatch.setattr(V, "FEW", 2)
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int")
    for name in ("rep", "copies", "vkey", "block", "component", "n", "i", "j"):
        df = df.withColumn(name, F.lit("clash"))
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, V.op6_vector_join(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(vectors())


def test_empty(spark, empty_dir):
    assert V.op6_vector_join(spark, empty_dir).count() == 0


def test_a_pair_is_one_cells():
    """Every pair within the radius meets in just one cell where, at each turn, one of the two stands; through two rounds of trees."""
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.standard_normal((900, 6)) / 8, rng.standard_normal((100, 6)) / 200))
    radius, rows = 0.1, {}
    V_leaf, V.LEAF = V.LEAF, 40
    try:
        tree = V.grow(x[::2], 2.0, radius)
        again = {leaf + 1: V.grow(x, 0.2, radius) for leaf, *_ in V.route(tree, x, radius)[:5]}
    finally:
        V.LEAF = V_leaf
    first = V._through(tree, (0, 0, 0, np.arange(len(x)), np.zeros(len(x), np.int64)), x, radius)
    parts = [piece for part in first for piece in V._through(again.get(part[1]), part, x, radius)]
    assert len(parts) > 20
    met = np.zeros((len(x), len(x)), int)
    for _, _, turns, at, homes in parts:
        met[np.ix_(at, at)] += homes[:, None] | homes[None] == (1 << turns) - 1
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= radius**2
    off = ~np.eye(len(x), dtype=bool)
    assert (met[near & off] == 1).all() and met[off].max() == 1


def test_rows_placed_grow_slower_than_a_labels_rows(spark, monkeypatch):
    """Eight times the rows of one label: cells stay small, and a row is placed at most three times as often."""
    monkeypatch.setattr(V, "LEAF", 512)
    rng, times, largest = np.random.default_rng(9), [], []
    for n in (2_000, 16_000):
        x = rng.standard_normal((n, 64)).astype("<f4")
        rows = spark.createDataFrame([(0, i, i, 1, v) for i, v in enumerate(x.tolist())], "label int, cls long, rep long, copies long, embedding array<float>")
        sizes = [r["count"] for r in V.tiled_cells(rows, 0.98).groupBy("label", "dim", "block", "cell", "i", "j").count().collect()]
        times.append(sum(sizes) / n)
        largest.append(max(sizes))
    assert max(largest) <= 2 * 512 and times[1] <= 3 * times[0], (times, largest)

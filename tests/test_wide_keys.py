"""Queries against their SQL on tables whose keys or groups are larger than in the smallest scale."""

import duckdb
import pytest

from gridloom import catalog


@pytest.fixture
def duck():
    return duckdb.connect()


def test_ring_order_with_parts_of_over_a_million(spark, duck, tmp_path):
    """Part 1,150,000 on line 1 comes after part 60,000 on line 2."""
    lines = "(1, 1, 1150000), (1, 2, 60000), (1, 3, 7), (1, 4, 8), (2, 1, 5), (2, 1, 4), (2, 2, 1199999), (2, 3, 9), (3, 1, 7), (3, 2, 8), (3, 3, 9)"
    duck.sql(f"CREATE TABLE lineitem AS SELECT * FROM (VALUES {lines}) t(l_orderkey, l_linenumber, l_partkey)")
    duck.sql("CREATE TABLE part AS SELECT DISTINCT l_partkey AS p_partkey, 20 AS p_size FROM lineitem")
    for t in ("lineitem", "part"):
        duck.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT PARQUET)")
    want = {r[0]: r[1:] for r in duck.execute(catalog.oracle_sql()["ring_assembly"]).fetchall()}
    found = {r.way_id: (r.vertices, r.first_lon) for r in catalog.queries()["ring_assembly"](spark, str(tmp_path)).collect()}
    assert found == want == {1: (4, 60000.0), 2: (4, 4.0)}


def test_cluster_means_on_a_half_in_any_order(spark):
    """Means that end on a half, whose plain sums depend on the order of rows, and a mean on a severity's limit."""
    import math
    import random

    from pyspark.sql import functions as F

    from gridloom.operators import cluster

    draw, rows, want = random.Random(4), [], {}
    for c in range(60):
        k = [draw.randrange(50) for _ in range(63)]
        k.append(draw.choice([v for v in range(50) if (sum(k) + v) % 2]))  # of 64 cells, an odd sum
        cells = [(c, c * 64 + i, 8.5 + v * 0.02, 117.2 + v * 0.02, 0.7) for i, v in enumerate(k)]
        draw.shuffle(cells)
        rows += cells
        want[c] = tuple(math.fsum(r[j] for r in cells) / 64 for j in (2, 3))
    found = cluster.cluster_summary(spark.createDataFrame(rows, "cluster long, cell_id long, lat double, lon double, p double").repartition(3)).collect()
    assert {r.cluster: (r.lat, r.lon) for r in found} == want
    assert {r.severity for r in found} == {"elevated"} and {r.mean4 for r in found} == {7000}

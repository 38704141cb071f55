"""Density clusters of high-risk cells, and their summaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.rounding import exact_mean
from gridloom.functions.scores import severity
from gridloom.operators.spatial import with_km
from gridloom.plans.components import connected_components
from gridloom.plans.shared import materialize


def dbscan(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """(cell_id, cluster) of points with cell_id, x, y. Within ``eps`` at most; a core point has ``min_samples`` around it, itself included.
    Clusters are the components of core points, named by their smallest core; a border point goes to the smallest cluster in reach; the rest is null.

    Points lie in squares whose diagonal is ``eps``. All points of a full square, one of ``min_samples`` or more, are core and stand as one node, its smallest id. Only points of the
    other squares are paired with what is around them, so pairs grow with the points. Two full squares are joined if any of their outermost points are
    in reach of each other, which nearly always tells; only where that fails are the two paired point by point.
    """
    side = eps / math.sqrt(2) * (1 - 1e-12)
    spot = points.select("cell_id", "x", "y", F.floor(F.col("x") / side).alias("gx"), F.floor(F.col("y") / side).alias("gy"))
    outer = [F.struct((d * v).alias("d"), "cell_id", "x", "y") for v in (F.col("x"), F.col("y"), F.col("x") + F.col("y"), F.col("x") - F.col("y")) for d in (F.lit(1.0), F.lit(-1.0))]
    squares = spot.groupBy("gx", "gy").agg(F.count("*").alias("n"), F.min("cell_id").alias("node"), F.array_distinct(F.transform(F.array(*map(F.max, outer)), lambda o: F.struct(o["x"].alias("x"), o["y"].alias("y")))).alias("outer"))
    squares = materialize(squares.where(F.col("n") >= min_samples), "dbscan-squares")
    full = spot.join(squares.select("gx", "gy", "node"), ["gx", "gy"], "left")
    spot = materialize(full, "dbscan-points")  # node is null off full squares

    reach = F.array(*(F.lit(k) for k in range(-2, 3)))
    move = lambda df: df.withColumn("dx", F.explode(reach)).withColumn("dy", F.explode(reach))
    d2 = lambda a, b, c, d: (a - c) ** 2 + (b - d) ** 2
    close = lambda *at: F.sqrt(d2(*at)) <= eps
    other = spot.select("gx", "gy", F.col("cell_id").alias("r_cell_id"), F.col("x").alias("r_x"), F.col("y").alias("r_y"), F.col("node").alias("r_node"))
    sparse = move(spot.where("node IS NULL")).select("cell_id", "x", "y", (F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy"))
    pairs = sparse.join(other, ["gx", "gy"]).where(close(F.col("x"), F.col("y"), F.col("r_x"), F.col("r_y"))).select("cell_id", "r_cell_id", "r_node")
    pairs = materialize(pairs, "dbscan-pairs")
    cores = materialize(pairs.groupBy("cell_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select("cell_id"), "dbscan-cores")
    is_core = cores.select(F.col("cell_id").alias("r_cell_id"), F.lit(True).alias("r_core"))
    # pairs whose other end is core, that end's node in place of itself
    to_core = pairs.join(is_core, "r_cell_id", "left").where("r_node IS NOT NULL OR r_core").select("cell_id", F.coalesce("r_node", "r_cell_id").alias("node")).distinct()
    to_core = materialize(to_core, "dbscan-reach")
    between = to_core.join(cores, "cell_id").select(F.col("cell_id").alias("a"), F.col("node").alias("b"))

    ahead = move(squares).where("dx > 0 OR dx = 0 AND dy > 0").select("node", "outer", "gx", "gy", (F.col("gx") + F.col("dx")).alias("hx"), (F.col("gy") + F.col("dy")).alias("hy"))
    beside = squares.select(F.col("gx").alias("hx"), F.col("gy").alias("hy"), F.col("node").alias("r_node"), F.col("outer").alias("r_outer"))
    touch = F.exists("outer", lambda p: F.exists("r_outer", lambda q: close(p["x"], p["y"], q["x"], q["y"])))
    couples = materialize(ahead.join(beside, ["hx", "hy"]).select("node", "r_node", "gx", "gy", "hx", "hy", touch.alias("touch")), "dbscan-couples")
    open_ = couples.where("NOT touch").join(spot.select("gx", "gy", "x", "y"), ["gx", "gy"])
    theirs = spot.select(F.col("gx").alias("hx"), F.col("gy").alias("hy"), F.col("x").alias("r_x"), F.col("y").alias("r_y"))
    late = open_.join(theirs, ["hx", "hy"]).where(close(F.col("x"), F.col("y"), F.col("r_x"), F.col("r_y"))).select("node", "r_node").distinct()
    joined = couples.where("touch").select("node", "r_node").unionAll(late)
    loops = squares.select(F.col("node").alias("a"), F.col("node").alias("b")).unionAll(cores.select(F.col("cell_id").alias("a"), F.col("cell_id").alias("b")))
    names = materialize(connected_components(between.unionAll(joined).unionAll(loops)), "dbscan-names")

    border = to_core.join(names, "node").groupBy("cell_id").agg(F.min("component").alias("reached"))
    own = spot.select("cell_id", F.coalesce("node", "cell_id").alias("node")).join(names, "node", "left")
    return own.join(border, "cell_id", "left").select("cell_id", F.coalesce("component", "reached").alias("cluster"))


def risk_clusters(cells: DataFrame, threshold: float = 0.5, eps: float = 15.0, min_samples: int = 3) -> DataFrame:
    """High-risk cells (p >= threshold) with their cluster, null for noise. Km are taken around the high-risk cells' own mean latitude."""
    high = cells.where(F.col("p") >= threshold)
    return high.join(dbscan(with_km(high), eps, min_samples), "cell_id")


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """One row a cluster: cells, centre, bounds, mean and largest risk, area (1 km2 at least), severity by the unrounded mean; mean4, the mean in ten-thousandths, and
    place, from 1 by falling mean4, then by cluster. Means don't depend on the order of rows; a mean within 5e-13 of a severity's limit counts as that limit."""
    rows = clustered.where("cluster IS NOT NULL").groupBy("cluster").agg(
        F.count("*").alias("cells"), exact_mean(F.col("lat")).alias("lat"), exact_mean(F.col("lon")).alias("lon"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"),
        F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"), exact_mean(F.col("p")).alias("mean_risk"), F.max("p").alias("max_risk"),
    )
    area = (F.col("lat_max") - F.col("lat_min")) * 111.0 * (F.col("lon_max") - F.col("lon_min")) * 111.0 * F.cos(F.radians("lat"))
    rows = rows.withColumn("area_km2", F.greatest(area, F.lit(1.0))).withColumn("severity", severity(F.round("mean_risk", 12))).withColumn("mean4", F.round(F.col("mean_risk") * 10_000).cast("long"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean4"), "cluster"))).orderBy("place")  # a row for each cluster

"""Derived features of cells: labels by period, neighbourhoods, rates and proxies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scores import high_risk, pre_period_loss
from gridloom.operators.discs import disc_sums
from gridloom.operators.selection import exact_quantiles
from gridloom.operators.spatial import nearest, radius_pairs, with_km
from gridloom.plans.shared import dealt, materialize, small_side

NEIGHBOR_KM, FIRE_KM = 15.0, 10.0


def temporal_split(cells: DataFrame) -> DataFrame:
    """Target and predictor periods from ``loss_year``, over what the input says of them; without the column, ``cells``."""
    if "loss_year" not in cells.columns:
        return cells
    return cells.withColumn("high_risk", high_risk(F.col("loss_year"))).withColumn("pre_period_loss", pre_period_loss(F.col("loss_year")))


def neighbor_features(cells: DataFrame, radius: float = NEIGHBOR_KM) -> DataFrame:
    """cell_id with neighbours, their pre-period losses and tree cover (tenths, summed exactly), within ``radius`` and off the cell's own place."""
    flat = with_km(cells).select("cell_id", "x", "y", "pre_period_loss", "tc10")
    pairs = radius_pairs(flat.select("cell_id", "x", "y"), flat, radius, apart=True)
    sums = pairs.groupBy("cell_id").agg(F.count("*").alias("n"), F.sum("r_pre_period_loss").alias("loss"), F.sum("r_tc10").alias("tc10_sum"))
    filled = cells.select("cell_id").join(sums, "cell_id", "left")
    return filled.select("cell_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "loss", "tc10_sum")))


def exact_quantile(df: DataFrame, value: str, q: float, name: str = "quantile") -> DataFrame:
    """One row, the exact quantile of a column by linear interpolation, found by counting. Nulls don't count; of no values it is null."""
    return exact_quantiles(df, value, {name: q})


def high_neighbors(cells: DataFrame, value: str, quantile: float = 0.75, radius: float = NEIGHBOR_KM) -> DataFrame:
    """cell_id with the count of neighbours whose ``value`` is above the whole frame's exact quantile."""
    limit = exact_quantile(cells, value, quantile, "limit")
    flat = with_km(cells).select("cell_id", "x", "y", value)
    over = flat.join(F.broadcast(limit), F.col(value) > F.col("limit")).drop("limit")  # one row
    counts = radius_pairs(flat.select("cell_id", "x", "y"), over, radius, apart=True).groupBy("cell_id").agg(F.count("*").alias("fires"))
    return cells.select("cell_id").join(counts, "cell_id", "left").select("cell_id", F.coalesce("fires", F.lit(0)).alias("fires"))


def point_density(cells: DataFrame, points: DataFrame, radius: float = FIRE_KM) -> DataFrame:
    """cell_id with the count of points (lat, lon) within ``radius``, those at distance 0 included; both lie around the cells' mean latitude."""
    left, right = with_km(cells).select("cell_id", "x", "y"), with_km(points, cells).select("x", "y")
    counts = radius_pairs(left, right, radius).groupBy("cell_id").agg(F.count("*").alias("n"))
    return cells.select("cell_id").join(counts, "cell_id", "left").select("cell_id", F.coalesce("n", F.lit(0)).alias("n"))


def frontier_distance(cells: DataFrame, first: int | None = None) -> DataFrame:
    """cell_id with km to the nearest cell of pre-period loss; ``first`` takes only so many of them in order of id."""
    front = cells.where("pre_period_loss = 1")
    if first:
        front = front.orderBy("cell_id").limit(first)
    return nearest(cells, front, "cell_id")


def annual_loss_rate(cells: DataFrame) -> DataFrame:
    """Percent a year: the region's pre-period losses over 19 years, doubled where the cell lost and halved where it didn't. Regions are counted first; few go to
    the cells, which by themselves would be exchanged to as many tasks as there are regions."""
    base = materialize(cells.groupBy("region").agg(F.sum("pre_period_loss").alias("lost"), F.count("*").alias("rows")), "regions")
    rate = 100.0 * F.col("lost") / F.col("rows") / 19.0
    joined = cells.join(small_side(base, F.octet_length("region")), "region")
    return joined.withColumn("rate", rate * F.when(F.col("pre_period_loss") == 1, 2.0).otherwise(0.5)).drop("lost", "rows")


def loss_acceleration(cells: DataFrame, rate: str = "rate") -> DataFrame:
    """``rate`` over the frame's mean, less 1."""
    mean = cells.agg(F.avg(rate).alias("__mean"))
    return cells.crossJoin(F.broadcast(mean)).withColumn("acceleration", F.col(rate) / F.greatest("__mean", F.lit(0.001)) - 1.0).drop("__mean")  # one row


def loss_indicator(cells: DataFrame, rate: str) -> DataFrame:
    """1 where ``rate`` is above the frame's median: stands in where the period isn't known."""
    mid = exact_quantile(cells, rate, 0.5, "__mid")
    return cells.crossJoin(F.broadcast(mid)).withColumn("indicator", (F.col(rate) > F.col("__mid")).cast("int")).drop("__mid")  # one row


def screening_features(cells: DataFrame, roads: DataFrame, rings: DataFrame, elevation: str = "elev10", step: float = 0.02) -> DataFrame:
    """``cells`` (cell_id, region, rw, col, lat, lon, loss_year, pre_period_loss, tc10, ...), a written table, with the manifest's features."""
    from gridloom.functions.scores import population_estimate
    from gridloom.operators.build import stencil_slope
    from gridloom.operators.spatial import inside_any

    c = cells.withColumn("tree_cover_2000_pct", F.col("tc10") / 10.0).withColumn("elevation_m", F.col(elevation) / 10.0)
    rates = annual_loss_rate(c)
    out = loss_acceleration(rates.withColumnRenamed("rate", "annual_loss_rate_pct"), "annual_loss_rate_pct").withColumnRenamed("acceleration", "loss_acceleration")
    out = dealt(out, cells.count(), "cell_id")  # the joins below sort it and what they add
    over = rates.crossJoin(F.broadcast(exact_quantile(rates, "rate", 0.75, "__limit"))).withColumn("over", (F.col("rate") > F.col("__limit")).cast("long"))  # one row
    around = disc_sums(over, ["pre_period_loss", "tc10", "over"], NEIGHBOR_KM, step)
    per = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n")), F.lit(0.0))
    loss = F.col("pre_period_loss").alias("neighbor_loss_count")
    around = around.select("cell_id", loss, per("pre_period_loss").alias("neighbor_loss_density"), (per("tc10") / 10.0).alias("neighbor_mean_tree_cover"), F.col("over").alias("fire_hotspot_density"))
    for more in (
        around, stencil_slope(c, "elevation_m", step), inside_any(cells, rings).withColumnRenamed("protected", "protected_area"),
        nearest(cells, roads, "cell_id").withColumnRenamed("km", "dist_to_road_km"), frontier_distance(cells).withColumnRenamed("km", "dist_to_deforestation_frontier_km"),
    ):
        out = out.join(more, "cell_id")
    return out.withColumn("population_density_per_km2", population_estimate(F.lit(0.0), F.col("dist_to_road_km")))

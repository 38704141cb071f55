"""A region's cell table from landed inputs, and a synthetic one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.geo import portable_hash, slope_degrees
from gridloom.functions.scores import population_estimate
from gridloom.operators.features import annual_loss_rate, frontier_distance, temporal_split
from gridloom.operators.raster import decode_loss, exg_pixels, sample_points
from gridloom.operators.spatial import grid, inside_any, nearest
from gridloom.sources.tables import lookup_population, lookup_rounded

LOSS_YEARS = 19


def box_chunks(spark: SparkSession, lat_min: float, lat_max: float, lon_min: float, lon_max: float, size: float = 1.0) -> DataFrame:
    """Boxes of ``size`` degrees at most that cover a box: what is asked of a map service at once."""
    at = lambda lo, hi: F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.lit((hi - lo) / size)) - 1, F.lit(0)).cast("int")))
    rows = spark.range(1).select(at(lat_min, lat_max).alias("i")).select("i", at(lon_min, lon_max).alias("j"))
    lat, lon = F.lit(lat_min) + F.col("i") * size, F.lit(lon_min) + F.col("j") * size
    return rows.select(lat.alias("lat_min"), F.least(lat + size, F.lit(lat_max)).alias("lat_max"), lon.alias("lon_min"), F.least(lon + size, F.lit(lon_max)).alias("lon_max"))


def stencil_slope(cells: DataFrame, elevation: str, delta: float) -> DataFrame:
    """(cell_id, slope_deg) from the four neighbours on the grid; a missing one has the cell's own height."""
    out = cells.select("cell_id", "rw", "col", "lat", F.col(elevation).alias("own"))
    for name, dr, dc in (("east", 0, 1), ("west", 0, -1), ("north", 1, 0), ("south", -1, 0)):
        side = cells.select((F.col("rw") - dr).alias("rw"), (F.col("col") - dc).alias("col"), F.col(elevation).alias(name))
        out = out.join(side, ["rw", "col"], "left").withColumn(name, F.coalesce(name, "own"))
    return out.select("cell_id", slope_degrees(F.col("west"), F.col("east"), F.col("south"), F.col("north"), F.col("lat"), delta).alias("slope_deg"))


def build_region(spark: SparkSession, region: str, box: tuple[float, float, float, float, float], loss_tiles: DataFrame, elevations: DataFrame, roads: DataFrame, rings: DataFrame, population: DataFrame, before: DataFrame | None = None, after: DataFrame | None = None) -> DataFrame:
    """Grid, land mask, losses, height, slope, roads, areas, frontier, loss rate, population and vegetation change of a region; nothing is fetched.

    loss_tiles: z, x, y and arrays alpha, red, blue, cover; elevations and population: lat, lon, elevation_m / population a hectare; before, after: raster tiles."""
    cells = grid(spark, *box)
    for name in ("alpha", "red", "blue", "cover"):
        cells = sample_points(cells, loss_tiles, name).withColumn(name, F.coalesce("sample", F.lit(0)).cast("long")).drop("sample")
    pixel = decode_loss(F.col("alpha"), F.col("red"), F.col("blue"), F.col("cover"), portable_hash(F.col("cell_id")))
    land = cells.withColumn("px", pixel).where("px.land").select("cell_id", "rw", "col", "lat", "lon", F.col("px.loss_year").cast("int").alias("loss_year"), (F.col("px.tc10") / 10.0).alias("tree_cover_2000_pct"))
    land = temporal_split(lookup_rounded(land, elevations, "elevation_m", 3).withColumn("region", F.lit(region)))
    out = land.join(stencil_slope(land, "elevation_m", box[4]), "cell_id")
    out = out.join(nearest(land, roads, "cell_id").withColumnRenamed("km", "dist_to_road_km"), "cell_id")
    out = out.join(frontier_distance(land).withColumnRenamed("km", "dist_to_deforestation_frontier_km"), "cell_id")
    out = out.join(inside_any(land, rings).withColumnRenamed("protected", "protected_area"), "cell_id")
    out = lookup_population(out, population)
    out = out.withColumn("population_density_per_km2", population_estimate(F.col("population"), F.col("dist_to_road_km"))).drop("population")
    out = annual_loss_rate(out).withColumnRenamed("rate", "annual_loss_rate_pct")
    if before is None or after is None:
        return out.withColumn("exg_change_2018_2019", F.lit(0.0))
    for name, tiles in (("e0", before), ("e1", after)):
        out = sample_points(out, tiles.select("z", "x", "y", exg_pixels().alias("e")), "e").withColumnRenamed("sample", name)
    return out.withColumn("exg_change_2018_2019", F.coalesce(F.col("e1") - F.col("e0"), F.lit(0.0))).drop("e0", "e1")


def _uniform(salt: int) -> Column:
    """In (0, 1), the same for a cell each time."""
    return (F.pmod(F.xxhash64("cell_id", F.lit(salt)), F.lit(1 << 40)) + 0.5) / float(1 << 40)


# The logistic's weights, and its constant.
RISK_WEIGHTS = {"annual_loss_rate_pct": 0.3, "dist_to_road_km": -0.01, "population_density_per_km2": 0.005, "elevation_m": -0.003, "protected_area": -0.8, "dist_to_deforestation_frontier_km": -0.01, "slope_deg": 0.02}
RISK_CONSTANT = -2.0


def logistic_risk() -> Column:
    """The probability of high risk that a cell's features stand for."""
    logit = F.lit(RISK_CONSTANT)
    for name, weight in RISK_WEIGHTS.items():
        logit = logit + weight * F.col(name)
    return 1.0 / (1.0 + F.exp(-logit))


def synthetic_cells(spark: SparkSession, box: tuple[float, float, float, float, float]) -> DataFrame:
    """Cells of plausible features and a label drawn from a logistic of them, all from hashes of the cell."""
    exponential = lambda salt, mean: -mean * F.log(_uniform(salt))
    normal = F.sqrt(-2.0 * F.log(_uniform(1))) * F.cos(2.0 * F.pi() * _uniform(2))
    c = grid(spark, *box).withColumn("tree_cover_2000_pct", 100.0 * F.pow(_uniform(3), F.lit(0.25))).withColumn("elevation_m", F.greatest(F.lit(0.0), 250.0 + 80.0 * normal)).withColumn("slope_deg", exponential(4, 4.0))
    c = c.withColumn("dist_to_road_km", exponential(5, 12.0)).withColumn("dist_to_deforestation_frontier_km", exponential(6, 15.0)).withColumn("protected_area", (_uniform(7) < 0.2).cast("int")).withColumn("population_density_per_km2", exponential(8, 10.0))
    rate = exponential(9, 1.5) + 3.0 * F.exp(-F.col("dist_to_road_km") / 10.0) - 1.5 * F.col("protected_area")
    c = c.withColumn("annual_loss_rate_pct", F.greatest(F.lit(0.0), F.least(F.lit(15.0), rate)))
    return c.withColumn("high_risk", (_uniform(10) < logistic_risk()).cast("int"))

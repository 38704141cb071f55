"""Change between two raster dates, by tile and by point. Tiles are rows (z, x, y) with channel arrays r, g, b of 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.geo import TILE_PIXELS, pixel_of, portable_hash, tile_of
from gridloom.functions.scores import excess_green


def exg_pixels(r: str = "r", g: str = "g", b: str = "b") -> Column:
    """The index of every pixel of a row's channel arrays."""
    return F.transform(F.arrays_zip(F.col(r).alias("r"), F.col(g).alias("g"), F.col(b).alias("b")), lambda p: excess_green(p["r"], p["g"], p["b"]))


def tile_change(before: DataFrame, after: DataFrame, limit: float = 0.08) -> DataFrame:
    """(z, x, y, pixels, loss, gain, exg_before, exg_after, loss_pct) of the tiles that both dates have. All within a row, so a tile never leaves its task."""
    pair = before.select("z", "x", "y", exg_pixels().alias("e0")).join(after.select("z", "x", "y", exg_pixels().alias("e1")), ["z", "x", "y"])
    change = pair.withColumn("d", F.zip_with("e0", "e1", lambda a, b: b - a))
    count = lambda keep: F.size(F.filter("d", keep)).cast("long")
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / F.size(c)
    out = change.select("z", "x", "y", F.size("d").cast("long").alias("pixels"), count(lambda v: v < -limit).alias("loss"), count(lambda v: v > limit).alias("gain"), mean("e0").alias("exg_before"), mean("e1").alias("exg_after"))
    return out.withColumn("loss_pct", 100.0 * F.col("loss") / F.greatest(F.col("pixels"), F.lit(1)))


def change_between(tiles: DataFrame, before: int, after: int, limit: float = 0.08) -> DataFrame:
    """``tile_change`` of two years of one table of tiles (year, z, x, y, r, g, b)."""
    if after <= before:
        raise ValueError(f"{after} isn't after {before}")
    return tile_change(tiles.where(F.col("year") == before), tiles.where(F.col("year") == after), limit)


def predicted_loss(change: Column, limit: float = -0.05) -> Column:
    """Whether a change of vegetation counts as a loss."""
    return change < limit


def random_points(spark: SparkSession, lat_min: float, lat_max: float, lon_min: float, lon_max: float, n: int, seed: int = 42) -> DataFrame:
    """(point, lat, lon): ``n`` points spread over a box, the same for a seed on any engine."""
    at = lambda salt: portable_hash(F.col("id") * 2 + F.lit(2 * seed * n + salt)) / 4294967296.0
    return spark.range(n).select(F.col("id").alias("point"), (F.lit(lat_min) + at(0) * (F.lit(lat_max) - F.lit(lat_min))).alias("lat"), (F.lit(lon_min) + at(1) * (F.lit(lon_max) - F.lit(lon_min))).alias("lon"))


def total_change(tiles: DataFrame, pixel_hectares: float = 0.1444) -> DataFrame:
    sums = tiles.agg(F.count("*").alias("tiles"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pixels", "loss", "gain")))
    return sums.withColumn("loss_pct", 100.0 * F.col("loss") / F.greatest(F.col("pixels"), F.lit(1))).withColumn("hectares", F.col("loss") * pixel_hectares)


def worst_tiles(tiles: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` tiles of the largest loss percent, to a tenth; of equals by place."""
    return tiles.withColumn("tenths", F.floor(F.col("loss") * 1000 / F.greatest(F.col("pixels"), F.lit(1)) + F.lit(0.5))).orderBy(F.desc("tenths"), "x", "y").limit(n)


def sample_points(cells: DataFrame, tiles: DataFrame, values: str, zoom: int = 12, side: int = TILE_PIXELS) -> DataFrame:
    """``cells`` with ``sample``, the value of array column ``values`` of the tile under them, null where there is none. Cells are what is hashed: tiles pass by one at
    a time, so their arrays are never sorted or kept."""
    x, y = tile_of(F.col("lat"), F.col("lon"), zoom)
    px, py = pixel_of(F.col("lat"), F.col("lon"), zoom)
    at = cells.withColumn("x", x).withColumn("y", y).withColumn("__i", (py * side + px).cast("int"))
    return at.hint("shuffle_hash").join(tiles.where(F.col("z") == zoom).select("x", "y", F.col(values).alias("__v")), ["x", "y"], "left").withColumn("sample", F.get("__v", "__i")).drop("x", "y", "__v", "__i")


def decode_loss(loss_alpha: Column, red: Column, blue: Column, cover_alpha: Column, seed: Column) -> Column:
    """A loss tile's pixel as a struct: land, has_loss, loss_year, tree cover in tenths (45 to 95 % where the cover layer has data, 25 % where only losses are known, 0 elsewhere)."""
    has = (loss_alpha > 0) & (red > 0)
    cover = F.when(cover_alpha > 0, 450 + seed % 500).when(loss_alpha > 0, F.lit(250)).otherwise(F.lit(0))
    return F.struct(((loss_alpha > 0) | (cover_alpha > 0)).alias("land"), has.alias("has_loss"), F.when(has, blue).otherwise(F.lit(0)).alias("loss_year"), cover.alias("tc10"))

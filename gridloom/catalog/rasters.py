"""Vegetation change between two dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import query
from gridloom.functions.scores import change_class
from gridloom.operators import raster, report
from gridloom.plans.shared import workdir
from gridloom.sources.binding import CELLS, TILES, cells, table, tiles
from gridloom.sources.tile_source import scan_tiles, write_tiles


def _changed(spark, d):
    return raster.tile_change(tiles(spark, d, 0), tiles(spark, d, 1))


@query("SELECT k AS tile, CAST(i - 1 AS BIGINT) AS pixel, CAST(floor(e * 1e6 + 0.5) AS BIGINT) AS exg6 FROM exg WHERE odd = 0", TILES)
def exg_index(spark, d):
    t = tiles(spark, d, 0).select(((F.col("x") - 3000) + (F.col("y") - 1900) * 40).alias("tile"), F.posexplode(raster.exg_pixels()).alias("pixel", "e"))
    return t.select("tile", F.col("pixel").cast("long").alias("pixel"), F.floor(F.col("e") * 1e6 + 0.5).alias("exg6"))


@query("SELECT t.*, 100.0::DOUBLE * loss / pixels AS loss_pct, before6, after6 FROM tile_change t JOIN (SELECT 3000 + k % 40 AS x, 1900 + k // 40 AS y, CAST(floor(avg(e0) * 1e6 + 0.5) AS BIGINT) AS before6, CAST(floor(avg(e1) * 1e6 + 0.5) AS BIGINT) AS after6 FROM change GROUP BY k) m USING (x, y)", TILES)
def change_detection(spark, d):
    both = tiles(spark, d, 0).withColumn("year", F.lit(2018)).unionByName(tiles(spark, d, 1).withColumn("year", F.lit(2019)))
    six = lambda c: F.floor(F.col(f"exg_{c}") * 1e6 + 0.5).alias(f"{c}6")
    return raster.change_between(both, 2018, 2019).select("z", "x", "y", "pixels", "loss", "gain", "loss_pct", six("before"), six("after"))


@query("SELECT count(*) AS tiles, CAST(sum(pixels) AS BIGINT) AS pixels, CAST(sum(loss) AS BIGINT) AS loss, CAST(sum(gain) AS BIGINT) AS gain, 100.0::DOUBLE * CAST(sum(loss) AS BIGINT) / CAST(sum(pixels) AS BIGINT) AS loss_pct, CAST(sum(loss) AS BIGINT) * 0.1444::DOUBLE AS hectares FROM tile_change", TILES)
def change_totals(spark, d):
    return raster.total_change(_changed(spark, d))


@query("SELECT x, y, CAST(floor(loss * 1000 / pixels + 0.5) AS BIGINT) AS tenths FROM tile_change ORDER BY 3 DESC, 1, 2 LIMIT 10", TILES)
def worst_tiles(spark, d):
    return raster.worst_tiles(_changed(spark, d)).select("x", "y", "tenths")


@query("SELECT CASE WHEN d < -0.08::DOUBLE THEN 'loss' WHEN d > 0.08::DOUBLE THEN 'gain' ELSE 'stable' END AS kind, count(*) AS pixels FROM change GROUP BY 1", TILES)
def change_classes(spark, d):
    pair = tiles(spark, d, 0).select("z", "x", "y", raster.exg_pixels().alias("e0")).join(tiles(spark, d, 1).select("z", "x", "y", raster.exg_pixels().alias("e1")), ["z", "x", "y"])
    pixels = pair.select(F.explode(F.zip_with("e0", "e1", lambda a, b: b - a)).alias("d"))
    return pixels.groupBy(change_class(F.col("d")).alias("kind")).agg(F.count("*").alias("pixels"))


@query("SELECT cell_id, (elev10 % 400 - 200) / 1000.0::DOUBLE < -0.05 AS lost FROM cells", CELLS)
def predicted_loss(spark, d):
    return cells(spark, d).select("cell_id", raster.predicted_loss((F.col("elev10") % 400 - 200) / 1000.0).alias("lost"))


@query("SELECT i AS point, a + ((i * 2 + 16800) * 2654435761) % 4294967296 / 4294967296.0::DOUBLE * (b - a) AS lat, c + ((i * 2 + 16801) * 2654435761) % 4294967296 / 4294967296.0::DOUBLE * (d - c) AS lon FROM range(0, 200) t(i), (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM cells)", CELLS)
def random_points(spark, d):
    """Points in the box of the cells."""
    b = report.geo_bounds(cells(spark, d)).first()
    return raster.random_points(spark, b.lat_min, b.lat_max, b.lon_min, b.lon_max, 200)


@query("SELECT v.vec_id AS tile, 3000 + vec_id % 40 AS x, 1900 + vec_id // 40 AS y, CAST(sum(floor(abs(embedding[i]::DOUBLE) * 255.0::DOUBLE)) AS BIGINT) AS red, CAST(sum(floor(abs(embedding[i + 16]::DOUBLE) * 255.0::DOUBLE)) AS BIGINT) AS green FROM embeddings v, range(1, 17) t(i) WHERE 3000 + vec_id % 40 BETWEEN 3005 AND 3011 GROUP BY vec_id")
def tile_files(spark, d):
    """Tiles of four by four pixels, one for each vector, written as image files, and those of some columns read back through the tile source."""
    e = F.col("embedding")
    channel = lambda k: F.transform(F.slice(e, 1 + 16 * k, 16), lambda v: F.floor(F.abs(v.cast("double")) * 255.0).cast("double"))
    k = F.col("vec_id")
    made = table(spark, d, "embeddings").select(F.lit("made").alias("layer"), F.lit(12).alias("z"), (3000 + k % 40).alias("x"), (1900 + F.floor(k / 40)).alias("y"), channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))
    root = workdir(spark, "tiles")
    write_tiles(made, root).write.format("noop").mode("overwrite").save()
    found = scan_tiles(spark, root, damaged="fail").where("layer = 'made' AND z = 12 AND x BETWEEN 3005 AND 3011")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v).cast("long")
    return found.select((F.col("x") - 3000 + (F.col("y") - 1900) * 40).alias("tile"), "x", "y", total("r").alias("red"), total("g").alias("green"))

"""Tiles as a data source: what is opened, and what becomes of files that can't be read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.sources import jpeg, rasters, tile_source


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """Two layers; every file outside columns 5 to 7 of the layer "seen" is an error page."""
    rng, base, images = np.random.default_rng(4), tmp_path_factory.mktemp("tiles"), {}
    for layer in ("seen", "other"):
        for x in range(3, 12):
            folder = base / layer / "12" / str(x)
            folder.mkdir(parents=True)
            for y in range(4):
                if layer == "seen" and 5 <= x <= 7 and y < 3:
                    images[x, y] = pixels = np.kron(rng.integers(0, 256, (2, 2, 3)), np.ones((8, 8, 1))).astype(np.uint8)
                    kind, data = (("png", rasters.encode_png(pixels)), ("jpg", jpeg.encode_jpeg(pixels)), ("jpeg", jpeg.encode_jpeg(pixels)))[y]
                    (folder / f"{y}.{kind}").write_bytes(data)
                else:
                    (folder / f"{y}.png").write_bytes(b"an error page")
            (folder / "notes.txt").write_bytes(b"no tile")
    return f"file://{base}", images


def test_only_what_is_asked_for_is_opened(spark, root):
    path, images = root
    asked = tile_source.scan_tiles(spark, path, damaged="fail").where("layer = 'seen' AND z = 12 AND x >= 5 AND x < 8 AND y IN (0, 1, 2)")
    got = {(r.x, r.y): r for r in asked.collect()}
    assert set(got) == set(images)
    for (x, y), pixels in images.items():
        near = [np.abs(np.array(got[x, y][band]) - pixels[:, :, k].ravel()).max() for k, band in enumerate("rgb")]
        assert max(near) <= (0 if y == 0 else 3) and got[x, y].a is None and got[x, y].error is None
    with pytest.raises(Exception, match="not a JPEG"):
        tile_source.scan_tiles(spark, path, damaged="fail").where("layer = 'seen' AND x = 5").collect()


def test_damaged_files_are_dropped_or_kept(spark, root):
    path, images = root
    assert tile_source.scan_tiles(spark, path).count() == len(images)
    kept = tile_source.scan_tiles(spark, path, damaged="keep")
    assert kept.where("error IS NOT NULL").count() == 2 * 9 * 4 - len(images)
    assert kept.where("error IS NOT NULL AND r IS NOT NULL").count() == 0
    assert tile_source.scan_tiles(spark, path).where("layer = 'nowhere'").count() == 0


def test_sparks_own_reader_gives_the_same(spark, root):
    path, _ = root
    a, b = rasters.read_tiles(spark, path), tile_source.scan_tiles(spark, path).drop("error")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_write_and_read(spark, tmp_path):
    tiles = spark.range(6).select(F.lit("l").alias("layer"), F.lit(3).alias("z"), (F.col("id") % 2).alias("x"), F.col("id").alias("y"), *(F.expr(f"transform(sequence(0, 63), i -> cast((i * {k} + id) % 256 AS double))").alias(c) for k, c in ((1, "r"), (2, "g"), (3, "b"))))
    for kind in ("png", "jpg"):
        out = f"file://{tmp_path}/{kind}"
        assert tile_source.write_tiles(tiles, out, kind).count() == 6
        assert tile_source.scan_tiles(spark, out, damaged="fail").where("y = 5").count() == 1
        both = tile_source.scan_tiles(spark, out).join(tiles.select("y", F.col("r").alias("want")), "y").select(F.array_max(F.zip_with("r", "want", lambda a, b: F.abs(a - b))).alias("far"))
        assert both.count() == 6 and both.agg(F.max("far")).first()[0] <= (0 if kind == "png" else 4)

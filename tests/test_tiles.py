"""Image tiles: every filter of the format, and files that aren't what they should be."""

import struct
import zlib

import numpy as np
import pytest

from gridloom.operators import raster
from gridloom.sources import rasters


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(pixels, filters):
    """A PNG whose rows go by ``filters`` in turn."""
    height, width, n = pixels.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    raw, above = b"", np.zeros((width, n), int)
    for y in range(height):
        line, kind = pixels[y].astype(int), filters[y % len(filters)]
        left = np.vstack((np.zeros((1, n), int), line[:-1]))
        corner = np.vstack((np.zeros((1, n), int), above[:-1]))
        p = left + above - corner
        far = np.stack((abs(p - left), abs(p - above), abs(p - corner)))
        paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], above, corner))
        guess = (0 * line, left, above, (left + above) // 2, paeth)[kind]
        raw += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    return rasters.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)[:50]) + chunk(b"IDAT", zlib.compress(raw)[50:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("n", [1, 2, 3, 4])
@pytest.mark.parametrize("filters", [[0], [1], [2], [3], [4], [0, 1, 2, 3, 4]])
def test_png_round_trip(n, filters):
    pixels = np.random.default_rng(n).integers(0, 256, (9, 13, n)).astype(np.uint8)
    assert (rasters.decode_png(encode(pixels, filters)) == pixels).all()


def test_damaged_files_are_refused():
    good = encode(np.zeros((4, 4, 3), np.uint8), [0])
    for bad in (b"", b"GIF89a", good[:30], good[:40] + b"\x01" + good[41:], rasters.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 4, 16, 2, 0, 0, 0)) + chunk(b"IEND", b"")):
        with pytest.raises(ValueError):
            rasters.decode_png(bad)


def test_tiles_from_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    images = {("loss", 3, 5): rng.integers(0, 256, (256, 256, 4)), ("cover", 3, 5): rng.integers(0, 256, (256, 256, 4)), ("loss", 3, 6): rng.integers(0, 256, (256, 256, 4)), ("2018", 3, 5): rng.integers(0, 256, (256, 256, 3))}
    for (layer, x, y), pixels in images.items():
        place = tmp_path / layer / "12" / str(x)
        place.mkdir(parents=True, exist_ok=True)
        (place / f"{y}.png").write_bytes(encode(pixels.astype(np.uint8), [1, 2]))
    (tmp_path / "loss" / "12" / "3" / "7.png").write_bytes(b"an error page")
    tiles = rasters.read_tiles(spark, str(tmp_path))
    got = {(r.layer, r.x, r.y): r for r in tiles.collect()}
    assert set(got) == set(images)
    for key, pixels in images.items():
        assert all(np.array_equal(np.array(got[key][band]), pixels[:, :, k].ravel()) for k, band in enumerate("rgb"))
        assert (got[key].a is None) == (pixels.shape[2] == 3)
    joined = {(r.x, r.y): r for r in rasters.loss_tiles(tiles).collect()}
    assert set(joined) == {(3, 5), (3, 6)} and joined[3, 6].cover is None
    assert joined[3, 5].blue == got["loss", 3, 5].b and joined[3, 5].cover == got["cover", 3, 5].a
    before = tiles.where("layer = '2018'")
    assert raster.tile_change(before, before).first().loss == 0


def test_tiles_are_neither_exchanged_nor_sorted(spark):
    """Tiles of half a MB for each cell: one passes by at a time."""
    from gridloom import catalog

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = catalog.queries()["point_sampling"](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
        assert df.count() == 150
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    made = [k for k, line in enumerate(plan) if "array_repeat" in line]
    assert made and all(not any(step in plan[k - 1] for step in ("Exchange", "Sort ")) for k in made)
    assert any("ShuffledHashJoin" in line and "BuildLeft" in line for line in plan)

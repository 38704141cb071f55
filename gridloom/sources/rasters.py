"""Landed raster tiles: image files by layer, zoom and place, read with Spark's binary file reader and decoded in tasks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PNG = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the format: channels by colour type.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
TILE = "layer string, z int, x long, y long, r array<float>, g array<float>, b array<float>, a array<float>"


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, channels) of an eight-bit PNG without palette or interlacing; anything else is a ValueError."""
    if not data.startswith(PNG):
        raise ValueError("not a PNG")
    at, packed, head = len(PNG), [], None
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("this kind of PNG isn't read")
    width, height, n = head[0], head[1], CHANNELS[head[3]]
    try:
        rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * n)
    except (zlib.error, ValueError) as error:
        raise ValueError(f"the pixels are damaged: {error}") from error
    out, above = np.zeros((height, width, n), np.uint8), np.zeros((width, n), np.uint8)
    for y, row in enumerate(rows):
        above = out[y] = _unfilter(int(row[0]), row[1:].reshape(width, n), above)
    return out


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A row of pixels from its differences: to nothing, the left, above, the mean of both, or the nearest of left, above and above left."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line, axis=0, dtype=np.uint64).astype(np.uint8)
    if kind == 2:
        return line + above
    if kind not in (3, 4):
        raise ValueError("unknown filter")
    out = np.empty_like(line)
    for c in range(line.shape[1]):
        left, corner, done = 0, 0, []
        for d, up in zip(line[:, c].tolist(), above[:, c].tolist()):
            if kind == 3:
                guess = (left + up) // 2
            else:
                p = left + up - corner
                guess = min(((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner)))[2]
            left, corner = d + guess & 255, up
            done.append(left)
        out[:, c] = done
    return out


def encode_png(pixels: np.ndarray) -> bytes:
    """An eight-bit PNG of (height, width, channels), rows as they are."""
    height, width, n = pixels.shape
    colour = {channels: kind for kind, channels in CHANNELS.items()}[n]
    rows = np.concatenate((np.zeros((height, 1), np.uint8), pixels.astype(np.uint8).reshape(height, width * n)), 1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def decode_tile(data: bytes) -> np.ndarray:
    """(height, width, channels) of a PNG or JPEG image, told by its first bytes; anything else is a ValueError."""
    from gridloom.sources.jpeg import decode_jpeg

    return decode_png(data) if data.startswith(PNG) else decode_jpeg(data)


def bands_of(pixels: np.ndarray) -> list[np.ndarray | None]:
    """Red, green, blue and alpha, row by row; grey repeats its channel, and alpha may be none."""
    bands = np.moveaxis(pixels, 2, 0).reshape(pixels.shape[2], -1).astype(np.float32)
    colour, alpha = (bands[:-1], bands[-1]) if len(bands) in (2, 4) else (bands, None)
    return [colour[k % len(colour)] for k in range(3)] + [alpha]


def read_tiles(spark: SparkSession, root: str) -> DataFrame:
    """(layer, z, x, y, r, g, b, a) of the PNG and JPEG tiles at ``root``/layer/z/x/y.png (.jpg, .jpeg), channels row by row; a is null where an image has no alpha, and grey images repeat their one channel.
    A file that can't be read, or stands elsewhere, gives no row, as a tile that a server doesn't have."""
    place = r"/([^/]+)/(\d+)/(\d+)/(\d+)\.(?:png|jpe?g)$"
    part = lambda i: F.regexp_extract("path", place, i)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,jpg,jpeg}").load(root).where(F.col("path").rlike(place))
    files = files.select(part(1).alias("layer"), part(2).cast("int").alias("z"), part(3).cast("long").alias("x"), part(4).cast("long").alias("y"), "content")

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i, content in enumerate(batch.column(4)):  # a tile at a time: arrays are large
                try:
                    found = bands_of(decode_tile(content.as_py()))
                except ValueError:
                    continue
                arrays = [pa.array([None if v is None else v], pa.list_(pa.float32())) for v in found]
                yield pa.RecordBatch.from_arrays([c.slice(i, 1) for c in batch.columns[:4]] + arrays, names=["layer", "z", "x", "y", "r", "g", "b", "a"])

    return files.mapInArrow(decode, TILE)


def loss_tiles(tiles: DataFrame, loss: str = "loss", cover: str = "cover") -> DataFrame:
    """(z, x, y, alpha, red, blue, cover) as ``build_region`` takes them, from the tiles of a loss layer and of a tree cover layer; where one has no tile, its arrays are null."""
    of = lambda layer: tiles.where(F.col("layer") == layer)
    left = of(loss).select("z", "x", "y", F.col("a").alias("alpha"), F.col("r").alias("red"), F.col("b").alias("blue"))
    return left.join(of(cover).select("z", "x", "y", F.col("a").alias("cover")), ["z", "x", "y"], "full")

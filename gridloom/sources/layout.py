"""Tables laid out by place: rows in order of a Z-order key, so that a box or a point reads a few row groups and not the table.

The key interleaves the bits of latitude and longitude, ``BITS`` of each. A box is covered by ranges of keys, found on the driver by quartering the globe; the ranges become an ordinary
filter on the key column, which Spark pushes to the Parquet scan, and row groups whose least and largest keys lie outside all ranges aren't read. The exact filter on the coordinates stays beside it, so
the layout never decides what is returned.

Rows of null coordinates are kept, with a null key; no box holds them. Coordinates beyond the globe are keyed as its rim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 20
#: Rows of a row group and of a file; ranges of keys that a box is covered by at most.
GROUP_ROWS, FILE_ROWS, MOST_RANGES = 100_000, 5_000_000, 64
KEY = "z_key"


def _step(value: Column, least: float, extent: float) -> Column:
    steps = 1 << BITS
    return F.greatest(F.lit(0), F.least(F.lit(steps - 1), F.floor((value - least) / extent * steps))).cast("long")


def z_key(lat: Column, lon: Column) -> Column:
    """The bits of both coordinates, a latitude's above a longitude's; null if either is null."""
    pair = F.struct(_step(lat, -90.0, 180.0).alias("a"), _step(lon, -180.0, 360.0).alias("o"))
    bit = lambda c, i: F.call_function("shiftright", c, i).bitwiseAND(F.lit(1).cast("long"))
    add = lambda p: lambda s, i: s.bitwiseOR(F.call_function("shiftleft", bit(p["o"], i), 2 * i)).bitwiseOR(F.call_function("shiftleft", bit(p["a"], i), 2 * i + 1))
    key = F.element_at(F.transform(F.array(pair), lambda p: F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), add(p))), 1)
    return F.when(lat.isNotNull() & lon.isNotNull(), key)


def z_ranges(lat_min: float, lat_max: float, lon_min: float, lon_max: float, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges of keys, ends included, that hold every key of the box: quarters that lie in it are taken whole and those on its rim are quartered
    on, until there would be more than ``most``."""
    steps = 1 << BITS
    place = lambda v, least, extent: max(0, min(steps - 1, int((v - least) / extent * steps // 1)))
    a0, a1 = place(lat_min, -90.0, 180.0), place(lat_max, -90.0, 180.0)
    o0, o1 = place(lon_min, -180.0, 360.0), place(lon_max, -180.0, 360.0)
    if a0 > a1 or o0 > o1:
        return []
    whole: list[tuple[int, int]] = []
    rim = [(0, 0, BITS)]  # a square's least steps and the logarithm of its side
    while rim and len(whole) + len(rim) <= most:
        below = []
        for a, o, k in rim:
            half = 1 << (k - 1) if k else 0
            if not k:
                whole.append((a, o, 0))
                continue
            for da in (0, half):
                for do in (0, half):
                    x, y = a + da, o + do
                    if x > a1 or x + half - 1 < a0 or y > o1 or y + half - 1 < o0:
                        continue
                    inside = a0 <= x and x + half - 1 <= a1 and o0 <= y and y + half - 1 <= o1
                    (whole if inside else below).append((x, y, k - 1))
        rim = below
    spread = lambda v: int(f"{v:b}", 4)  # noqa: E731  binary digits as digits to the base 4: each bit in every second place
    found = sorted((first := spread(a) * 2 + spread(o), first + (1 << 2 * k) - 1) for a, o, k in whole + rim)
    out: list[tuple[int, int]] = []
    for lo, hi in found:
        if out and lo == out[-1][1] + 1:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def write_layout(df: DataFrame, path: str, rows: int | None = None, group_rows: int = GROUP_ROWS, file_rows: int = FILE_ROWS) -> None:
    """Write ``df`` (lat, lon, ...) with its key, in the key's order. ``rows`` is their number, counted if it isn't given."""
    n = df.count() if rows is None else rows
    keyed = df.withColumn(KEY, z_key(F.col("lat"), F.col("lon")))
    keyed.repartitionByRange(-(-n // file_rows) or 1, KEY).sortWithinPartitions(KEY).write.option("parquet.block.row.count.limit", group_rows).parquet(path)


def in_ranges(ranges: list[tuple[int, int]]) -> Column:
    any_ = F.lit(False)
    for lo, hi in ranges:
        any_ = any_ | F.col(KEY).between(lo, hi)
    return any_


def read_box(spark: SparkSession, path: str, lat_min: float, lat_max: float, lon_min: float, lon_max: float) -> DataFrame:
    """The rows of a layout in a box, ends included."""
    rows = spark.read.parquet(path).where(in_ranges(z_ranges(lat_min, lat_max, lon_min, lon_max)))
    return rows.where(F.col("lat").between(lat_min, lat_max) & F.col("lon").between(lon_min, lon_max)).drop(KEY)


def read_nearest(spark: SparkSession, path: str, lat: float, lon: float, key: str, reach: float = 0.05) -> DataFrame:
    """The row of a layout that is closest to a point in degrees, of equals that of the smallest ``key``; no row if none has coordinates. Boxes around the point
    grow until one has a row, and the last reaches as far as that row."""
    d2 = (F.col("lat") - lat) ** 2 + (F.col("lon") - lon) ** 2
    around = lambda r: read_box(spark, path, lat - r, lat + r, lon - r, lon + r)
    found = None
    while found is None and reach < 1000.0:
        found, reach = around(reach).agg(F.min(d2).alias("d2")).first().d2, reach * 4
    last = reach / 4 if found is None else max(found**0.5 * (1 + 1e-12), 1e-12)
    return around(last).orderBy(d2, key).limit(1)

"""Raster tiles as a data source of Spark: ``spark.read.format("gridloom_tiles").load(root)`` over ``root``/layer/z/x/y.png, .jpg or .jpeg.

Filters on layer, z, x and y reach the source: it lists only the folders that they leave, makes a partition of about ``tilesPerPartition`` folders' worth of one layer and zoom, and opens only the files
that they leave. Spark applies the filters again, so that what the source leaves out is only ever less work.

A tile has its channels row by row; ``a`` is null without alpha, and grey images repeat their channel. A file that can't be read is dropped, as a tile that a server doesn't have; with the option
``damaged`` as ``keep`` it is a row with null channels and the ``error``, with ``fail`` it ends the query. Files and folders of other names aren't looked at. Folders are reached through pyarrow's file systems (local, HDFS,
S3, GCS); where only Spark reaches them, ``rasters.read_tiles`` reads them with Spark's own reader.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from gridloom.sources.rasters import TILE, bands_of, decode_tile

FORMAT = "gridloom_tiles"
SCHEMA = f"{TILE}, error string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
FOLDERS = 16
_FILE = re.compile(r"(\d+)\.(?:png|jpe?g)")
_TESTS = {EqualTo: lambda v, w: v == w, EqualNullSafe: lambda v, w: v == w, In: lambda v, w: v in w, GreaterThan: lambda v, w: v > w, GreaterThanOrEqual: lambda v, w: v >= w, LessThan: lambda v, w: v < w, LessThanOrEqual: lambda v, w: v <= w}


def open_root(uri: str):
    """(file system, path) of a folder's URI or local path."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def _names(system, path: str, folders: bool) -> list[str]:
    from pyarrow import fs

    kind = fs.FileType.Directory if folders else fs.FileType.File
    return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(path)) if f.type == kind)


@dataclass
class TileFolders(InputPartition):
    layer: str
    z: int
    xs: list[int]


class TileReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.damaged = options["path"].rstrip("/"), options.get("damaged", "drop")
        if self.damaged not in ("drop", "keep", "fail"):
            raise ValueError("damaged is one of drop, keep and fail")
        self.folders = int(options.get("foldersPerPartition", FOLDERS))
        self.filters: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in ("layer", "z", "x", "y"):
                self.filters.append((f.attribute[0], type(f), f.value))
            yield f

    def _wanted(self, column: str, value) -> bool:
        return all(_TESTS[kind](value, to) for name, kind, to in self.filters if name == column)

    def partitions(self) -> list[InputPartition]:
        system, root = open_root(self.root)
        found: list[InputPartition] = []
        for layer in _names(system, root, True):
            if not self._wanted("layer", layer):
                continue
            for z in _names(system, f"{root}/{layer}", True):
                if not z.isdigit() or not self._wanted("z", int(z)):
                    continue
                xs = sorted(int(x) for x in _names(system, f"{root}/{layer}/{z}", True) if x.isdigit() and self._wanted("x", int(x)))
                found += [TileFolders(layer, int(z), xs[i : i + self.folders]) for i in range(0, len(xs), self.folders)]
        return found or [TileFolders("", 0, [])]

    def read(self, partition: TileFolders) -> Iterator:
        import pyarrow as pa

        system, root = open_root(self.root)
        for x in partition.xs:
            folder = f"{root}/{partition.layer}/{partition.z}/{x}"
            files = [(int(m[1]), name) for name in _names(system, folder, False) if (m := _FILE.fullmatch(name))]
            for y, name in sorted(files):
                if not self._wanted("y", y):
                    continue
                error, bands = None, [None] * 4
                try:
                    with system.open_input_stream(f"{folder}/{name}") as file:
                        bands = bands_of(decode_tile(file.read()))
                except ValueError as e:
                    if self.damaged == "fail":
                        raise ValueError(f"{folder}/{name}: {e}") from e
                    if self.damaged == "drop":
                        continue
                    error = str(e)
                place = [pa.array([partition.layer]), pa.array([partition.z], pa.int32()), pa.array([x]), pa.array([y])]
                arrays = place + [pa.array([b], pa.list_(pa.float32())) for b in bands] + [pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["layer", "z", "x", "y", "r", "g", "b", "a", "error"])


class TileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TileReader:
        return TileReader(self.options)


def register_tiles(spark: SparkSession) -> None:
    """Make the format known to a session, whose filters then reach Python sources: Spark asks for the setting where a source takes them."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(TileSource)


def scan_tiles(spark: SparkSession, root: str, damaged: str = "drop") -> DataFrame:
    """(layer, z, x, y, r, g, b, a, error) of the tiles below ``root``, a URI of a shared folder."""
    register_tiles(spark)
    return spark.read.format(FORMAT).option("damaged", damaged).load(root)


def write_tiles(tiles: DataFrame, root: str, kind: str = "png") -> DataFrame:
    """Write square ``tiles`` (layer, z, x, y, r, g, b), channels of 0 to 255, as image files; returns (layer, z, x, y, bytes), lazily: files are written as it is read. A file that a
    lost task left is written anew, whole, under its own name, so re-runs agree."""

    def write(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from gridloom.sources.jpeg import encode_jpeg
        from gridloom.sources.rasters import encode_png

        encode = {"png": encode_png, "jpg": encode_jpeg}[kind]
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                side = round(len(row["r"]) ** 0.5)
                data = encode(np.stack([np.array(row[c]) for c in "rgb"], 1).reshape(side, side, 3).astype(np.uint8))
                system, base = open_root(root)
                folder = f"{base}/{row['layer']}/{row['z']}/{row['x']}"
                system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{folder}/{row['y']}.{kind}") as sink:
                    sink.write(data)
                done.append({"layer": row["layer"], "z": row["z"], "x": row["x"], "y": row["y"], "bytes": len(data)})
            yield pa.RecordBatch.from_pylist(done, pa.schema([("layer", pa.string()), ("z", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("bytes", pa.int64())]))

    rows = tiles.selectExpr("layer", "cast(z AS int) AS z", "cast(x AS bigint) AS x", "cast(y AS bigint) AS y", "r", "g", "b")
    return rows.mapInArrow(write, "layer string, z int, x long, y long, bytes long")

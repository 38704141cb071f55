"""Readers and writers: regions of cells as CSV or Parquet, landed JSON of roads and areas, fires, documents of one object."""

from __future__ import annotations

import hashlib
import json
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.geo import portable_hash
from gridloom.sources.schema import CELLS

FIRE_BOX = {"lat": (5.0, 20.0), "lon": (117.0, 127.0)}


def read_cells(spark: SparkSession, root: str | None = None, region: str | None = None, path: str | None = None, fallback: str | None = None) -> DataFrame:
    """An explicit ``path`` wins over ``region``; without either, all regions below ``root`` (written by ``write_cells``) as one table, or the ``fallback`` where there
    are none. A region that is asked for must be there."""

    def read(place: str) -> DataFrame:
        reader = spark.read.schema(CELLS)
        return reader.option("header", True).csv(place) if place.endswith(".csv") else reader.parquet(place)

    if path:
        return read(path)
    found = read(root) if root and exists(spark, root) else None
    if region:
        mine = None if found is None else found.where(F.col("region") == region)
        if mine is None or mine.isEmpty():
            raise FileNotFoundError(f"no cells of {region} in {root}")
        return mine
    if found is not None and not (fallback and found.isEmpty()):
        return found
    if fallback:
        return read(fallback)
    raise FileNotFoundError("a path, a root with regions or a fallback is needed")


def union_regions(frames: dict[str, DataFrame]) -> DataFrame:
    """One table of several regions; a column that a region lacks is null there."""
    out = None
    for name, df in frames.items():
        df = df.withColumn("region", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def write_cells(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").partitionBy("region").format(kind).option("header", True).save(path)


def move_column(df: DataFrame, name: str, value, before: str) -> DataFrame:
    """``df`` with column ``name`` anew, in front of ``before``."""
    rest = [c for c in df.columns if c != name]
    at = rest.index(before)
    return df.withColumn(name, value).select(*rest[:at], name, *rest[at:])


def sample_rows(df: DataFrame, n: int, key: str = "cell_id") -> DataFrame:
    """Exactly min(n, rows) rows, the same each time."""
    return df.orderBy(portable_hash(F.col(key)), key).limit(n)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Landed map answers, one object with ``elements``: a row for each element."""
    kind = "elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>>"
    return spark.read.schema(kind).json(path, multiLine=True).select(F.inline("elements"))


#: The classes of roads that count.
ROAD_CLASSES = ("motorway", "trunk", "primary", "secondary", "tertiary", "residential", "track")


def road_nodes(elements: DataFrame, classes: tuple[str, ...] = ROAD_CLASSES) -> DataFrame:
    """(lat, lon) of the nodes of roads of ``classes``. Where an answer has ways, only nodes of such ways count; one of nodes alone was filtered by who asked."""
    nodes = elements.where((F.col("type") == "node") & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    ways = elements.where(F.col("type") == "way")
    if ways.isEmpty():
        return nodes.select("lat", "lon")
    used = ways.where(F.col("tags")["highway"].isin(*classes)).select(F.explode("nodes").alias("id")).distinct()
    return nodes.join(used, "id", "left_semi").select("lat", "lon")


def assemble_rings(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, ring): vertices in order, those of unknown nodes left out; rings of under four points go."""
    at = ways.select(F.col("id").alias("way_id"), F.posexplode("nodes").alias("pos", "node"))
    found = at.join(nodes.select(F.col("id").alias("node"), "lon", "lat"), "node")
    rings = found.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("r"))
    return rings.where(F.size("r") >= 4).select("way_id", F.transform("r", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("ring"))


def read_fires(spark: SparkSession, path: str) -> DataFrame:
    fires = spark.read.schema("latitude double, longitude double, confidence string, frp double").option("header", True).csv(path)
    return in_fire_box(fires)


def in_fire_box(fires: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return fires.where(F.col(lat).between(*FIRE_BOX["lat"]) & F.col(lon).between(*FIRE_BOX["lon"]))


def lookup_rounded(cells: DataFrame, table: DataFrame, value: str, digits: int, default: float = 0.0) -> DataFrame:
    """``cells`` with ``value`` of a table keyed by rounded coordinates (elevation, population), or the default."""
    key = lambda c: (F.round(F.col(c) * 10**digits)).cast("long")
    known = table.select(key("lat").alias("__a"), key("lon").alias("__o"), value).dropDuplicates(["__a", "__o"])
    joined = cells.withColumn("__a", key("lat")).withColumn("__o", key("lon")).join(known, ["__a", "__o"], "left").drop("__a", "__o")
    return joined.withColumn(value, F.coalesce(value, F.lit(default)))


def lookup_population(cells: DataFrame, table: DataFrame, value: str = "population") -> DataFrame:
    """``cells`` with people a square kilometre, from a table of people a hectare by coordinates to two decimals; 0 where it has none."""
    return lookup_rounded(cells, table, value, 2).withColumn(value, F.round(F.col(value) * 100, 1))


def geocode(gazetteer: DataFrame, name: str) -> DataFrame:
    """(lat, lon, display_name) of a place by name, whatever its case; no row if unknown."""
    return gazetteer.where(F.lower("name") == name.lower()).orderBy("name").limit(1).select("lat", "lon", "display_name")


def _hadoop(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _hadoop(spark, path)
    return system.exists(place)


def state(spark: SparkSession, *paths: str) -> str:
    """A digest of the files below ``paths``: their names, lengths and times. Tables that change have another."""
    found = []
    for path in paths:
        system, place = _hadoop(spark, path)
        files = system.listFiles(place, True)
        while files.hasNext():
            file = files.next()
            found.append(f"{file.getPath()} {file.getLen()} {file.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def read_brief(spark: SparkSession, path: str) -> dict | None:
    """A document of one object from any file system, None if there is none."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if exists(spark, path) else None


def write_brief(spark: SparkSession, path: str, brief: dict) -> None:
    system, place = _hadoop(spark, path)
    out = system.create(place, True)
    out.write(bytearray(json.dumps(brief).encode()))
    out.close()

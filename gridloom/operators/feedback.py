"""Verdicts of reviewers: the latest for each cell and run, statistics, suggestions, and labels overridden by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def place_key(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Coordinates to three decimals, as integers."""
    return F.round(lat * 1000).cast("long"), F.round(lon * 1000).cast("long")


def check_verdicts(log: DataFrame) -> DataFrame:
    """Fails the job at a verdict other than accept or reject."""
    ok = F.when(F.col("verdict").isin("accept", "reject"), F.col("verdict"))
    return log.withColumn("verdict", F.coalesce(ok, F.raise_error(F.concat(F.lit("unknown verdict: "), F.coalesce("verdict", F.lit("null")))).cast("string")))


def latest(log: DataFrame, keys: tuple[str, ...] = ("cell_id", "run_id")) -> DataFrame:
    """The log as it stands: the last entry of each key, with the time of its first. Aggregated map-side."""
    last = F.max_by(F.struct(*(c for c in log.columns if c not in keys)), F.struct("updated_at", "event_id"))
    rows = log.groupBy(*keys).agg(last.alias("last"), F.min("updated_at").alias("created_at"))
    return rows.select(*keys, "last.*", "created_at")


def stats(current: DataFrame, by: str = "run_id") -> DataFrame:
    return current.groupBy(by).agg(F.count_if(F.col("verdict") == "accept").alias("accepted"), F.count_if(F.col("verdict") == "reject").alias("rejected"), F.count("*").alias("total"))


def suggest(cells: DataFrame, current: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` least certain cells that nobody has judged."""
    return cells.join(current.select("cell_id").distinct(), "cell_id", "left_anti").withColumn("uncertainty", F.abs(F.col("p6") - 500000)).orderBy("uncertainty", "cell_id").limit(n)


def override_labels(cells: DataFrame, log: DataFrame, newest_wins: bool = True) -> DataFrame:
    """``cells`` with the label that the verdicts give. In order of processing (newest first unless ``newest_wins``), the last word stays; ``changes``
    counts rejects, and accepts that find the label at 0."""
    order = [F.asc("updated_at"), F.asc("event_id")] if newest_wins else [F.desc("updated_at"), F.desc("event_id")]
    w = Window.partitionBy("cell_id").orderBy(*order)
    seen = log.join(cells.select("cell_id", "high_risk"), "cell_id").withColumn("before", F.lag("verdict").over(w)).withColumn("place", F.row_number().over(w))
    found_zero = F.when(F.col("before").isNull(), F.col("high_risk") == 0).otherwise(F.col("before") == "reject")
    changed = (F.col("verdict") == "reject") | found_zero
    folded = seen.groupBy("cell_id").agg(F.max_by("verdict", "place").alias("last"), F.count_if(changed).alias("changes"))
    joined = cells.join(folded, "cell_id", "left")
    label = F.when(F.col("last") == "accept", 1).when(F.col("last") == "reject", 0).otherwise(F.col("high_risk"))
    return joined.withColumn("label", label).withColumn("changes", F.coalesce("changes", F.lit(0))).drop("last")


def match_cells(cells: DataFrame, log: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(event_id, cell_id): each entry's first cell within ``tolerance`` degrees, by bins of a thousandth and their neighbours."""
    near = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    a, o = F.floor(F.col("lat") / tolerance), F.floor(F.col("lon") / tolerance)
    spots = cells.select("cell_id", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), a.alias("a"), o.alias("o"))
    marks = log.select("event_id", "lat", "lon", a.alias("a0"), o.alias("o0")).withColumn("da", F.explode(near)).withColumn("do", F.explode(near)).withColumn("a", F.col("a0") + F.col("da")).withColumn("o", F.col("o0") + F.col("do"))
    hits = marks.join(spots, ["a", "o"]).where((F.abs(F.col("lat") - F.col("c_lat")) < tolerance) & (F.abs(F.col("lon") - F.col("c_lon")) < tolerance))
    return hits.groupBy("event_id").agg(F.min("cell_id").alias("cell_id"))


def in_region(log: DataFrame, cells: DataFrame) -> DataFrame:
    """Entries at a cell of ``cells``, to three decimals of both coordinates together."""
    la, lo = place_key(F.col("lat"), F.col("lon"))
    keys = cells.select(la.alias("__a"), lo.alias("__o")).distinct()
    return log.withColumn("__a", la).withColumn("__o", lo).join(keys, ["__a", "__o"], "left_semi").drop("__a", "__o")


def cell_verdict(current: DataFrame, lat: float, lon: float, run_id: str, tolerance: float = 0.001) -> DataFrame:
    """The entry closest to a point for a run, no row if none is within ``tolerance``."""
    near = current.where((F.col("run_id") == run_id) & (F.abs(F.col("lat") - lat) < tolerance) & (F.abs(F.col("lon") - lon) < tolerance))
    return near.orderBy((F.col("lat") - lat) ** 2 + (F.col("lon") - lon) ** 2).limit(1)

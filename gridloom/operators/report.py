"""Reports: distributions, hotspots, histories and roll-ups of scored cells (p, p6 in millionths, predicted)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scores import calendar_year
from gridloom.operators.spatial import join_boxes


def region_catalog(cells: DataFrame) -> DataFrame:
    bounds = [f(c).alias(f"{c}_{n}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))]
    return cells.groupBy("region").agg(F.count("*").alias("cells"), *bounds)


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, min, max, mean, std): one pass, then a row for each column; std of a sample."""
    stat = lambda c: F.struct(F.lit(c).alias("feature"), F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"))
    return df.agg(*(stat(c).alias(c) for c in columns)).select(F.inline(F.array(*columns)))


def risk_distribution(cells: DataFrame, *by: str, cell_km: float = 2.2) -> DataFrame:
    """high, low, high_pct and hectares of high risk, overall or by columns."""
    agg = [F.count("*").alias("cells"), F.count_if(F.col("predicted") == 1).alias("high"), F.count_if(F.col("predicted") == 0).alias("low")]
    rows = cells.groupBy(*by).agg(*agg) if by else cells.agg(*agg)
    return rows.withColumn("high_pct", F.coalesce(F.try_divide(100.0 * F.col("high"), F.col("cells")), F.lit(0.0))).withColumn("hectares", F.col("high") * (cell_km * cell_km * 100.0))


def forest(cells: DataFrame, cover: str = "tree_cover_2000_pct", least: float = 10) -> DataFrame:
    """Cells of enough tree cover to count as forest."""
    return cells.where(F.col(cover) >= least)


def grid_predictions(cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(cell_id, p6, prediction): 1 from the threshold on, itself included."""
    return cells.select("cell_id", "p6", (F.col("p6") >= round(threshold * 1e6)).cast("long").alias("prediction"))


def class_distribution(cells: DataFrame, label: str = "high_risk") -> DataFrame:
    return cells.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def geo_bounds(cells: DataFrame) -> DataFrame:
    """One row: the corners of the cells, and the middle."""
    b = cells.agg(F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"))
    return b.withColumn("lat_mid", (F.col("lat_min") + F.col("lat_max")) / 2).withColumn("lon_mid", (F.col("lon_min") + F.col("lon_max")) / 2)


def cell_rectangle(cells: DataFrame, step: float = 0.02) -> DataFrame:
    """(cell_id, south, north, west, east) around each cell's middle."""
    h = F.lit(step) / 2
    return cells.select("cell_id", (F.col("lat") - h).alias("south"), (F.col("lat") + h).alias("north"), (F.col("lon") - h).alias("west"), (F.col("lon") + h).alias("east"))


def hotspots(cells: DataFrame, n: int = 5) -> DataFrame:
    return cells.where("predicted = 1").orderBy(F.desc("p6"), "cell_id").limit(n)


def yearly_losses(cells: DataFrame, last: int = 22) -> DataFrame:
    """(year, losses) for every year from 2001, those without losses too."""
    years = cells.sparkSession.range(1, last + 1).select(F.col("id").alias("loss_year"))
    counts = cells.groupBy(F.col("loss_year").cast("long").alias("loss_year")).agg(F.count("*").alias("losses"))
    return years.join(counts, "loss_year", "left").select((F.col("loss_year") + 2000).alias("year"), F.coalesce("losses", F.lit(0)).alias("losses"))


def loss_totals(cells: DataFrame, rate: str) -> DataFrame:
    """One row beside the yearly history: cells that lost, those at high risk, and the mean rate; zeros for no cells."""
    return cells.agg(F.count_if(F.col("loss_year") > 0).alias("total_losses"), F.coalesce(F.sum("high_risk"), F.lit(0)).alias("high_risk"), F.coalesce(F.avg(rate), F.lit(0.0)).alias("mean_rate"))


def estimated_losses(regions: DataFrame, last: int = 22) -> DataFrame:
    """(region, year, losses): what stands in for a history that isn't known of ``regions`` (region, rate_pct, cells): a rate that grows by 2 % of itself a year."""
    years = regions.withColumn("y", F.explode(F.sequence(F.lit(1), F.lit(last))))
    losses = (F.col("rate_pct") / 100.0 * F.col("cells") * (1.0 + 0.02 * (F.col("y") - 1))).cast("long")
    return years.select("region", (F.col("y") + 2000).cast("long").alias("year"), F.greatest(F.lit(0), losses).alias("losses"))


def site_rollup(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """(name, cells, high, high_pct, top_cell, top_p6): a row for each site, the empty ones too."""
    joined = join_boxes(boxes, cells)
    top = F.max_by("cell_id", F.when(F.col("predicted") == 1, F.struct(F.col("p6"), -F.col("cell_id"))))
    rows = joined.groupBy("name").agg(F.count("cell_id").alias("cells"), F.count_if(F.col("predicted") == 1).alias("high"), top.alias("top_cell"), F.max(F.when(F.col("predicted") == 1, F.col("p6"))).alias("top_p6"))
    return rows.withColumn("high_pct", F.coalesce(F.try_divide(100.0 * F.col("high"), F.col("cells")), F.lit(0.0)))


def review_summary(sites: DataFrame) -> DataFrame:
    """One row: totals over sites (a cell in two sites counts twice), all sites, and those of any high risk by falling percent. Sites are what a caller asks about, few."""
    site = F.struct("high_pct", "name", "cells", "high", "top_cell", "top_p6")
    total = sites.agg(F.count("*").alias("sites"), F.sum("cells").alias("cells"), F.sum("high").alias("high"), F.sort_array(F.collect_list(site), asc=False).alias("all_sites"))
    priority = F.filter("all_sites", lambda s: s["high"] > 0)
    return total.select("sites", "cells", "high", F.coalesce(F.try_divide(100.0 * F.col("high"), F.col("cells")), F.lit(0.0)).alias("high_pct"), F.size(priority).cast("long").alias("priority_sites"), F.to_json("all_sites").alias("site_json"), F.to_json(priority).alias("priority_json"))


# The sentences of a report.
HIGHEST = "Highest risk cell at (%.2f, %.2f) with %.0f%% probability"
ELEVATED = "Region has elevated risk: %.0f%% of cells are high-risk"


def notable(cells: DataFrame) -> DataFrame:
    """The sentences worth a reader's eye: the cell of highest risk, and a region of more than 30 % high risk."""
    best = F.max_by(F.struct("lat", "lon", "p"), F.when(F.col("predicted") == 1, F.struct("p6", -F.col("cell_id"))))
    row = cells.agg(best.alias("b"), F.count_if(F.col("predicted") == 1).alias("high"), F.count("*").alias("total"))
    first = F.when(F.col("b").isNotNull(), F.format_string(HIGHEST, F.col("b.lat"), F.col("b.lon"), F.col("b.p") * 100))
    second = F.when(F.col("high") > 0.3 * F.col("total"), F.format_string(ELEVATED, 100.0 * F.col("high") / F.col("total")))
    return row.select(F.explode(F.filter(F.array(first, second), lambda s: s.isNotNull())).alias("finding"))


def report_parts(cells: DataFrame, importances: DataFrame | None = None) -> DataFrame:
    """One row: risk_distribution, bounds, hotspots, notable and, with ``importances``, drivers, as structs and arrays of a few entries."""
    dist = risk_distribution(cells).select(F.struct("cells", "high", "low", "high_pct", "hectares").alias("risk_distribution"))
    bounds = geo_bounds(cells).select(F.struct("lat_min", "lat_max", "lon_min", "lon_max").alias("bounds"))
    hot = hotspots(cells).agg(F.sort_array(F.collect_list(F.struct("p6", (-F.col("cell_id")).alias("order"), "cell_id", "lat", "lon")), asc=False).alias("h"))
    hot = hot.select(F.transform("h", lambda x: x.dropFields("order")).alias("hotspots"))
    found = notable(cells).agg(F.collect_list("finding").alias("notable"))
    out = dist.crossJoin(bounds).crossJoin(hot).crossJoin(found)  # one row each
    if importances is not None:
        out = out.crossJoin(importances.agg(F.sort_array(F.collect_list(F.struct("importance", "feature")), asc=False).alias("drivers")))
    return out


def region_report(cells: DataFrame, name: str | None, importances: DataFrame | None = None, cached: dict | None = None) -> DataFrame:
    """One row of JSON: distribution, hotspots, findings, bounds, drivers, and the narrative of a cached brief if there is one."""
    out = report_parts(cells, importances)
    text = (cached or {}).get("narrative")
    title = name.replace("_", " ").title() if name else "Selected Region"
    return out.select(F.to_json(F.struct(F.lit(title).alias("region_name"), *out.columns, F.lit(text).alias("narrative"), F.lit(text is not None).alias("cached"))).alias("report"))


def cell_detail(cell: DataFrame, provenance: DataFrame, features: list[str], explanation: DataFrame | None = None) -> DataFrame:
    """(cell_id, feature, value, source, year) of one cell or several; a feature of unknown source has an empty one; year is the cell's loss year, null without a loss. With
    ``explanation`` (``model.explain``), shap is each feature's contribution."""
    year = calendar_year(F.col("loss_year")).cast("long") if "loss_year" in cell.columns else F.lit(None).cast("long")
    long = cell.select("cell_id", year.alias("year"), F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))).alias("f")).select("cell_id", "year", "f.*")
    out = long.join(provenance.select("feature", "source"), "feature", "left").select("cell_id", "feature", "value", F.coalesce("source", F.lit("")).alias("source"), "year")
    if explanation is None:
        return out
    told = explanation.select("cell_id", F.inline("drivers")).select("cell_id", "feature", "shap")
    return out.join(told, ["cell_id", "feature"], "left")


def driver_sentence(label: Column, drivers: Column) -> Column:
    """``label — driven by:`` and the three largest contributions, drivers being array<struct<feature, value, shap>> by falling size."""
    one = lambda d: F.format_string("%s (%s, %s%.4f)", d["feature"], d["value"].cast("string"), F.when(d["shap"] >= 0, "+").otherwise(""), d["shap"])
    return F.concat(label, F.lit(" — driven by: "), F.array_join(F.transform(F.slice(drivers, 1, 3), one), ", "))


def better_model(primary_f1: Column, other_f1: Column) -> Column:
    return F.when(primary_f1 >= other_f1, "primary").otherwise("alternative")

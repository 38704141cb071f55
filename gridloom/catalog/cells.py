"""Projections, filters and aggregations of cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import query
from gridloom.functions import geo, rounding, scores
from gridloom.operators import build, features, registry, report, spatial
from gridloom.plans.shared import materialize, workdir
from gridloom.sources import binding, schema, tables
from gridloom.sources.binding import AREAS, CELLS, cells


@query("SELECT n.region, count(*) AS cells, CAST(sum(c.predicted) AS BIGINT) AS high, CAST(sum(n.loss) AS BIGINT) AS neighbor_losses FROM (SELECT a.region, a.cell_id, CAST(coalesce(sum(b.pre_period_loss), 0) AS BIGINT) AS loss FROM km a LEFT JOIN km b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 15.0 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) > 0 GROUP BY 1, 2) n JOIN cells c USING (cell_id) GROUP BY 1", CELLS)
def region_risk(spark, d):
    c = materialize(cells(spark, d).select("cell_id", "region", "lat", "lon", "pre_period_loss", "tc10", "predicted"), "cells")  # read four times
    joined = c.join(features.neighbor_features(c), "cell_id")
    return joined.groupBy("region").agg(F.count("*").alias("cells"), F.sum("predicted").alias("high"), F.sum("loss").alias("neighbor_losses"))


@query("SELECT cell_id, loss_year, high_risk, pre_period_loss, CASE WHEN loss_year > 0 THEN loss_year + 2000 END AS year FROM cells", CELLS)
def temporal_split(spark, d):
    c = features.temporal_split(cells(spark, d).withColumn("high_risk", F.lit(9)))
    return c.select("cell_id", "loss_year", F.col("high_risk").cast("long"), F.col("pre_period_loss").cast("long"), scores.calendar_year(F.col("loss_year")).alias("year"))


@query("SELECT region, count(*) AS cells, min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max FROM cells GROUP BY 1", CELLS)
def region_catalog(spark, d):
    return report.region_catalog(cells(spark, d))


@query("SELECT region, lat, lon FROM cells WHERE region = 'ASIA'", CELLS)
def region_scan(spark, d):
    """One region of a table partitioned by region: the others' files aren't read."""
    path = workdir(spark, "regions")
    tables.write_cells(cells(spark, d).select("region", "lat", "lon"), path)
    return tables.read_cells(spark, path, "ASIA").select("region", "lat", "lon")


@query("SELECT region, cell_id, CASE WHEN region = 'ASIA' THEN tc10 END AS tc10 FROM cells WHERE region IN ('ASIA', 'EUROPE')", CELLS)
def region_union(spark, d):
    c = cells(spark, d)
    return tables.union_regions({"ASIA": c.where("region = 'ASIA'").select("cell_id", "tc10"), "EUROPE": c.where("region = 'EUROPE'").select("cell_id")}).select("region", "cell_id", "tc10")


@query("SELECT cell_id FROM cells ORDER BY (cell_id * 2654435761) % 4294967296, cell_id LIMIT 20", CELLS)
def dataset_sample(spark, d):
    return tables.sample_rows(cells(spark, d).select("cell_id"), 20)


@query("SELECT cell_id, CAST(round(6371000.0 * 2 * asin(sqrt(sin(radians(9.0 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(9.0)) * sin(radians(118.0 - lon) / 2) ** 2))) AS BIGINT) AS metres FROM cells", CELLS)
def haversine(spark, d):
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(9.0), F.lit(118.0))
    return cells(spark, d).select("cell_id", F.round(km * 1000).cast("long").alias("metres"))


_TILE = "t AS (SELECT cell_id, (lon + 180.0) / 360.0 * 4096.0 AS fx, (1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * 4096.0 AS fy FROM cells)"


@query("SELECT cell_id, CAST(trunc(fx) AS BIGINT) AS x, CAST(trunc(fy) AS BIGINT) AS y, least(CAST(trunc((fx - floor(fx)) * 256) AS BIGINT), 255) AS px, least(CAST(trunc((fy - floor(fy)) * 256) AS BIGINT), 255) AS py FROM t", CELLS, _TILE)
def tile_coords(spark, d):
    (x, y), (px, py) = geo.tile_of(F.col("lat"), F.col("lon")), geo.pixel_of(F.col("lat"), F.col("lon"))
    return cells(spark, d).select("cell_id", x.alias("x"), y.alias("y"), px.cast("long").alias("px"), py.cast("long").alias("py"))


@query("SELECT DISTINCT x, y, CAST(round(degrees(atan(sinh(pi() * (1.0 - 2.0 * (y + 0.5) / 4096.0)))) * 1e4) AS BIGINT) AS lat4, CAST(round(((x + 0.5) / 4096.0 * 360.0 - 180.0) * 1e4) AS BIGINT) AS lon4 FROM (SELECT CAST(trunc(fx) AS BIGINT) AS x, CAST(trunc(fy) AS BIGINT) AS y FROM t)", CELLS, _TILE)
def tile_center(spark, d):
    x, y = geo.tile_of(F.col("lat"), F.col("lon"))
    lat, lon = geo.tile_center(F.col("x"), F.col("y"))
    return cells(spark, d).select(x.alias("x"), y.alias("y")).distinct().select("x", "y", F.round(lat * 1e4).cast("long").alias("lat4"), F.round(lon * 1e4).cast("long").alias("lon4"))


_TILE_X = "CAST(trunc(({0} + 180.0) / 360.0 * 4096.0) AS BIGINT)"
_TILE_Y = "CAST(trunc((1.0 - ln(tan(radians({0})) + 1.0 / cos(radians({0}))) / pi()) / 2.0 * 4096.0) AS BIGINT)"


@query(f"SELECT way_id AS name, x, y FROM (SELECT way_id, {_TILE_X.format('x0')} AS a, {_TILE_X.format('x1')} AS b, {_TILE_Y.format('y1')} AS c, {_TILE_Y.format('y0')} AS d FROM area_boxes), LATERAL (SELECT unnest(range(a, b + 1)) AS x), LATERAL (SELECT unnest(range(c, d + 1)) AS y) QUALIFY row_number() OVER (PARTITION BY way_id ORDER BY x, y) <= 100", AREAS)
def tile_cover(spark, d):
    """Tiles of each protected area's box."""
    lon, lat = (F.transform("ring", lambda p: p[c]) for c in ("lon", "lat"))
    boxes = binding.areas(spark, d).select(F.col("way_id").alias("name"), F.array_min(lat).alias("lat_min"), F.array_max(lat).alias("lat_max"), F.array_min(lon).alias("lon_min"), F.array_max(lon).alias("lon_max"))
    return spatial.tiles_of_boxes(boxes)


@query("SELECT region AS name, rw, col, lat0 + rw * 0.04::DOUBLE AS lat, lon0 + col * 0.04::DOUBLE AS lon FROM (SELECT region, min(lat) AS lat0, min(lon) AS lon0, CAST(ceil((max(lat) - min(lat)) / 0.04::DOUBLE) AS BIGINT) AS n, CAST(ceil((max(lon) - min(lon)) / 0.04::DOUBLE) AS BIGINT) AS m FROM cells GROUP BY 1), LATERAL (SELECT unnest(range(0, n)) AS rw), LATERAL (SELECT unnest(range(0, m)) AS col)", CELLS)
def grid_generate(spark, d):
    """A coarser grid over each region's bounds."""
    ends = [f(c).alias(f"{c}_{f.__name__}") for c in ("lat", "lon") for f in (F.min, F.max)]
    return spatial.grids_of_boxes(cells(spark, d).groupBy(F.col("region").alias("name")).agg(*ends), 0.04)


@query("""SELECT cell_id, CAST(floor(degrees(atan(sqrt(zx * zx + zy * zy))) * 100 + 0.5) AS BIGINT) AS slope100 FROM (SELECT c.cell_id, coalesce((coalesce(e.elev10, c.elev10) - coalesce(w.elev10, c.elev10)) / 10.0 / (2.0 * 2226.4 * cos(radians(c.lat))), 0.0) AS zx, (coalesce(n.elev10, c.elev10) - coalesce(s.elev10, c.elev10)) / 10.0 / (2.0 * 2226.4) AS zy
FROM cells c LEFT JOIN cells e ON e.rw = c.rw AND e.col = c.col + 1 LEFT JOIN cells w ON w.rw = c.rw AND w.col = c.col - 1 LEFT JOIN cells n ON n.col = c.col AND n.rw = c.rw + 1 LEFT JOIN cells s ON s.col = c.col AND s.rw = c.rw - 1)""", CELLS)
def slope(spark, d):
    """Five-point stencil by equality joins on grid places, so that no row of the grid is one task's."""
    c = cells(spark, d).withColumn("height", F.col("elev10") / 10.0)
    return build.stencil_slope(c, "height", 0.02).select("cell_id", F.floor(F.col("slope_deg") * 100 + 0.5).alias("slope100"))


@query("SELECT cell_id, CAST(floor((CASE WHEN elev10 % 3 > 0 THEN elev10 / 100.0 ELSE greatest(0.0, 50.0 * exp(-(tc10 / 10.0) / 10.0)) END) * 10 + 0.5) AS BIGINT) AS density10 FROM cells", CELLS)
def population_fallback(spark, d):
    served = F.when(F.col("elev10") % 3 > 0, F.col("elev10") / 100.0).otherwise(0.0)
    return cells(spark, d).select("cell_id", F.floor(scores.population_estimate(served, F.col("tc10") / 10.0) * 10 + 0.5).alias("density10"))


_RATE = "rates AS (SELECT c.cell_id, 100.0::DOUBLE * b.lost / b.n / 19.0::DOUBLE * (CASE WHEN pre_period_loss = 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END) AS rate FROM cells c JOIN (SELECT region, CAST(sum(pre_period_loss) AS BIGINT) AS lost, count(*) AS n FROM cells GROUP BY 1) b USING (region))"


@query("SELECT cell_id, CAST(floor(rate * 1e6 + 0.5) AS BIGINT) AS rate6 FROM rates", CELLS, _RATE)
def annual_loss_rate(spark, d):
    return features.annual_loss_rate(cells(spark, d)).select("cell_id", F.floor(F.col("rate") * 1e6 + 0.5).alias("rate6"))


@query("SELECT cell_id, CAST(floor((rate / greatest((SELECT avg(rate) FROM rates), 0.001) - 1.0) * 1e4 + 0.5) AS BIGINT) AS acceleration4 FROM rates", CELLS, _RATE)
def loss_acceleration(spark, d):
    out = features.loss_acceleration(features.annual_loss_rate(cells(spark, d)))
    return out.select("cell_id", F.floor(F.col("acceleration") * 1e4 + 0.5).alias("acceleration4"))


@query("SELECT cell_id, CASE WHEN tc10 > (SELECT median(tc10) FROM cells) THEN 1::BIGINT ELSE 0 END AS indicator FROM cells", CELLS)
def median_indicator(spark, d):
    return features.loss_indicator(cells(spark, d), "tc10").select("cell_id", F.col("indicator").cast("long"))


@query("SELECT cell_id, p6, CASE WHEN p6 > 700000 THEN 'red' WHEN p6 > 400000 THEN 'amber' ELSE 'green' END AS tier FROM cells", CELLS)
def risk_tier(spark, d):
    return cells(spark, d).select("cell_id", "p6", scores.risk_tier(F.col("p6") / 1e6).alias("tier"))


@query("SELECT cell_id, lat - 0.02::DOUBLE / 2 AS south, lat + 0.02::DOUBLE / 2 AS north, lon - 0.02::DOUBLE / 2 AS west, lon + 0.02::DOUBLE / 2 AS east FROM cells", CELLS)
def cell_rectangle(spark, d):
    return report.cell_rectangle(cells(spark, d))


@query("SELECT replace(n_name, ' ', '_') AS region, list_aggregate(list_transform(string_split(lower(replace(n_name, '_', ' ')), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS title FROM nation")
def region_names(spark, d):
    regions = binding.table(spark, d, "nation").select(F.translate("n_name", " ", "_").alias("region"))
    return regions.select("region", scores.display_name(F.col("region")).alias("title"))


@query("SELECT cell_id, CAST(floor(1.0::DOUBLE / (1.0::DOUBLE + exp(-(-2.0::DOUBLE + 0.3::DOUBLE * (loss_year / 4.0::DOUBLE) + -0.01::DOUBLE * rw + 0.005::DOUBLE * col + -0.003::DOUBLE * (elev10 / 10.0::DOUBLE) + -0.8::DOUBLE * (block % 2) + -0.01::DOUBLE * (tc10 / 100.0::DOUBLE) + 0.02::DOUBLE * (rw / 10.0::DOUBLE)))) * 1e6 + 0.5) AS BIGINT) AS score6 FROM cells", CELLS)
def logistic_score(spark, d):
    """The synthetic table's risk, of features that stand in for its own."""
    c, at = cells(spark, d), F.col
    stand = {"annual_loss_rate_pct": at("loss_year") / 4.0, "dist_to_road_km": at("rw"), "population_density_per_km2": at("col"), "elevation_m": at("elev10") / 10.0, "protected_area": at("block") % 2, "dist_to_deforestation_frontier_km": at("tc10") / 100.0, "slope_deg": at("rw") / 10.0}
    return c.withColumns({n: v.cast("double") for n, v in stand.items()}).select("cell_id", F.floor(build.logistic_risk() * 1e6 + 0.5).alias("score6"))


@query("SELECT count(*) AS n, true AS same, 16::BIGINT AS digits FROM cells", CELLS)
def dataset_rows(spark, d):
    """The fingerprint: its rows, and whether its hash is that of the same rows in another order."""
    c = cells(spark, d).select("cell_id", "tc10", "loss_year")
    other = registry.fingerprint(c.repartition(7).sortWithinPartitions(F.desc("tc10"))).select(F.col("hash").alias("other"))
    both = registry.fingerprint(c).crossJoin(other)  # one row
    return both.select(F.col("rows").alias("n"), (F.col("hash") == F.col("other")).alias("same"), F.length("hash").cast("long").alias("digits"))


@query("SELECT cell_id FROM cells WHERE lat BETWEEN 9.0 AND 9.41 AND lon BETWEEN 117.2 AND 117.5", CELLS)
def bbox_filter(spark, d):
    return spatial.in_box(cells(spark, d), 9.0, 9.41, 117.2, 117.5).select("cell_id")


@query("SELECT cell_id FROM cells WHERE tc10 >= 100", CELLS)
def forest_only(spark, d):
    return report.forest(cells(spark, d).withColumn("tree_cover_2000_pct", F.col("tc10") / 10.0)).select("cell_id")


@query("SELECT cell_id, p6, CASE WHEN p6 >= 400000 THEN 1::BIGINT ELSE 0 END AS prediction FROM cells", CELLS)
def grid_predictions(spark, d):
    return report.grid_predictions(cells(spark, d), 0.4)


@query("SELECT feature, min, max, CAST(floor(mean * 1e4 + 0.5) AS BIGINT) AS mean4, CAST(floor(std * 1e4 + 0.5) AS BIGINT) AS std4 FROM (SELECT 'loss_year' AS feature, min(loss_year)::DOUBLE AS min, max(loss_year)::DOUBLE AS max, avg(loss_year) AS mean, stddev_samp(loss_year) AS std FROM cells UNION ALL SELECT 'tc10', min(tc10), max(tc10), avg(tc10), stddev_samp(tc10) FROM cells)", CELLS)
def dataset_summary(spark, d):
    four = lambda c: F.floor(F.col(c) * 1e4 + 0.5).alias(f"{c}4")
    return report.column_stats(cells(spark, d), ["loss_year", "tc10"]).select("feature", "min", "max", four("mean"), four("std"))


@query("SELECT high_risk AS label, count(*) AS n FROM cells GROUP BY 1", CELLS)
def class_distribution(spark, d):
    return report.class_distribution(cells(spark, d))


@query("SELECT min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max, (min(lat) + max(lat)) / 2 AS lat_mid, (min(lon) + max(lon)) / 2 AS lon_mid FROM cells", CELLS)
def geo_bounds(spark, d):
    return report.geo_bounds(cells(spark, d))


@query("SELECT y + 2000 AS year, count(cell_id) AS losses FROM range(1, 23) t(y) LEFT JOIN cells ON loss_year = y GROUP BY 1", CELLS)
def temporal_loss(spark, d):
    return report.yearly_losses(cells(spark, d))


@query("SELECT count(*) FILTER (loss_year > 0) AS total_losses, CAST(sum(high_risk) AS BIGINT) AS high_risk, CAST(floor(avg(tc10) * 1e4 + 0.5) AS BIGINT) AS rate4 FROM cells", CELLS)
def temporal_totals(spark, d):
    return report.loss_totals(cells(spark, d), "tc10").select("total_losses", "high_risk", F.floor(F.col("mean_rate") * 1e4 + 0.5).alias("rate4"))


@query("SELECT region, y + 2000 AS year, greatest(0, CAST(trunc(rate / 100.0::DOUBLE * n * (1.0::DOUBLE + 0.02::DOUBLE * (y - 1))) AS BIGINT)) AS losses FROM (SELECT region, 100.0::DOUBLE * CAST(sum(pre_period_loss) AS BIGINT) / count(*) / 19.0::DOUBLE AS rate, count(*) AS n FROM cells GROUP BY 1), range(1, 23) t(y)", CELLS)
def temporal_estimate(spark, d):
    """Each region's history as its rate and number of cells would have it."""
    lost = cells(spark, d).groupBy("region").agg(F.sum("pre_period_loss").alias("lost"), F.count("*").alias("cells"))
    return report.estimated_losses(lost.select("region", (100.0 * F.col("lost") / F.col("cells") / 19.0).alias("rate_pct"), "cells"))


@query("SELECT region, count(*) AS cells, CAST(sum(predicted) AS BIGINT) AS high, CAST(count(*) - sum(predicted) AS BIGINT) AS low, 100.0::DOUBLE * CAST(sum(predicted) AS BIGINT) / count(*) AS high_pct, CAST(sum(predicted) AS BIGINT) * (2.2::DOUBLE * 2.2::DOUBLE * 100.0::DOUBLE) AS hectares FROM cells GROUP BY 1", CELLS)
def risk_distribution(spark, d):
    return report.risk_distribution(cells(spark, d), "region")


@query("SELECT cell_id, p6 FROM cells WHERE predicted = 1 ORDER BY p6 DESC, cell_id LIMIT 5", CELLS)
def top_hotspots(spark, d):
    return report.hotspots(cells(spark, d)).select("cell_id", "p6")


@query("SELECT region, cell_id, p6 FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY p6 DESC, cell_id) AS k FROM cells) WHERE k = 1", CELLS)
def top_cell(spark, d):
    return cells(spark, d).groupBy("region").agg(F.max_by("cell_id", F.struct(F.col("p6"), -F.col("cell_id"))).alias("cell_id"), F.max("p6").alias("p6"))


@query("SELECT cell_id, tc10 / 10.0::DOUBLE AS tree_cover_2000_pct, elev10 / 10.0::DOUBLE AS elevation_m, pre_period_loss * 2 + 0.5::DOUBLE AS annual_loss_rate_pct FROM cells", CELLS)
def manifest_projection(spark, d):
    """Cells with the allowed features that their table has, in manifest order; the table has features of the target's time too."""
    c = cells(spark, d).withColumns({"annual_loss_rate_pct": F.col("pre_period_loss") * 2 + F.lit(0.5), "elevation_m": F.col("elev10") / 10.0, "tree_cover_2000_pct": F.col("tc10") / 10.0})
    return schema.project_features(c, "cell_id")


@query("SELECT cell_id, land, has_loss, year AS loss_year, CASE WHEN cover > 0 THEN 450 + cell_id % 500 WHEN alpha > 0 THEN 250 ELSE 0 END AS tc10 FROM (SELECT *, alpha > 0 OR cover > 0 AS land, alpha > 0 AND red > 0 AS has_loss, CASE WHEN alpha > 0 AND red > 0 THEN loss_year ELSE 0 END AS year FROM (SELECT cell_id, loss_year, cell_id % 3 AS alpha, CASE WHEN loss_year > 0 THEN 255 ELSE 0 END AS red, cell_id % 4 AS cover FROM cells)) WHERE land", CELLS)
def land_decode(spark, d):
    """Loss tiles' pixels decoded, water left out."""
    from gridloom.operators.raster import decode_loss

    c = F.col("cell_id")
    pixel = decode_loss(c % 3, F.when(F.col("loss_year") > 0, 255).otherwise(0), F.col("loss_year"), c % 4, c)
    return cells(spark, d).select("cell_id", pixel.alias("px")).select("cell_id", "px.*").where("land").withColumn("tc10", F.col("tc10").cast("long"))


@query("SELECT cell_id, tc10 * 2 AS tc10, rw FROM cells", CELLS)
def column_rewrite(spark, d):
    """A column dropped and put anew before another."""
    return tables.move_column(cells(spark, d).select("cell_id", "rw", "tc10"), "tc10", F.col("tc10") * 2, "rw")


@query("SELECT c.rw, c.cell_id, coalesce(s.elev10, 0) AS elev10 FROM cells c LEFT JOIN cells s ON c.cell_id = s.cell_id AND s.tc10 > 300", CELLS)
def elevation_lookup(spark, d):
    """A batch service's answers by rounded coordinates, 0 where it has none: of places of little tree cover it knows no elevation."""
    c = cells(spark, d)
    served = c.select("lat", "lon", F.when(F.col("tc10") > 300, F.col("elev10")).alias("elev"))
    return tables.lookup_rounded(c.select("rw", "cell_id", "lat", "lon"), served, "elev", 3).select("rw", "cell_id", F.col("elev").cast("long").alias("elev10"))


@query("SELECT c.cell_id, coalesce(s.tc10 * 100, 0)::BIGINT AS people FROM cells c LEFT JOIN cells s ON c.cell_id = s.cell_id AND s.tc10 > 300", CELLS)
def population_lookup(spark, d):
    """People a hectare by rounded coordinates, told by the square kilometre."""
    c = cells(spark, d)
    served = c.select("lat", "lon", F.when(F.col("tc10") > 300, F.col("tc10").cast("double")).alias("population"))
    return tables.lookup_population(c.select("cell_id", "lat", "lon"), served).select("cell_id", F.col("population").cast("long").alias("people"))


@query("SELECT n_name AS display_name FROM nation WHERE lower(n_name) = lower((SELECT min(n_name) FROM nation))")
def geocode_lookup(spark, d):
    nation = binding.table(spark, d, "nation")
    name = nation.agg(F.min("n_name")).first()[0]
    gazetteer = nation.select(F.col("n_name").alias("name"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.col("n_name").alias("display_name"))
    return tables.geocode(gazetteer, name.lower()).select("display_name")


@query("SELECT l_orderkey, l_linenumber, CAST(printf('%.2f', l_extendedprice * l_discount) AS DOUBLE) AS saved, CAST(printf('%.4f', l_discount * l_tax) AS DOUBLE) AS share, CAST(printf('%.1f', l_extendedprice / 8.0::DOUBLE) AS DOUBLE) AS eighth FROM lineitem")
def presented_rounding(spark, d):
    """Presented values, rounded half to even on their binary value."""
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    lines = binding.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (price * discount).alias("saved"), (discount * F.col("l_tax")).alias("share"), (price / 8.0).alias("eighth"))
    return rounding.present(lines, {"saved": 2, "share": 4, "eighth": 1})

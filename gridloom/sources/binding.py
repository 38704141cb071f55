"""The driver tables seen as cells, roads, fires, verdicts, areas and tiles, in Spark and in SQL alike (FIXTURES.md, B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scores import high_risk, pre_period_loss
from gridloom.operators.split import block_of


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """A cell for each customer on a grid of 50 rows; the score p is a fixed logistic of loss year and tree cover."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    joined = table(spark, d, "customer").join(orders, "c_custkey", "left").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey")
    rw, col = k % 50, F.floor(k / 50)
    out = joined.select(
        k.alias("cell_id"), F.col("r_name").alias("region"), rw.alias("rw"), col.alias("col"), (8.5 + rw * 0.02).alias("lat"), (117.2 + col * 0.02).alias("lon"),
        F.round((F.col("c_acctbal") + 1000.0) / 11.0).cast("long").alias("tc10"), F.when(F.col("c_acctbal") < 4000, (F.coalesce("n", F.lit(0)) * 7 + k) % 24).otherwise(0).cast("long").alias("loss_year"),
        block_of(rw, col).cast("long").alias("block"), ((k * 7919) % 15000).alias("elev10"),
    )
    p = 1.0 / (1.0 + F.exp(-(-3.0 + 0.25 * F.col("loss_year") - 0.001 * F.col("tc10"))))
    out = out.withColumn("high_risk", high_risk(F.col("loss_year")).cast("long")).withColumn("pre_period_loss", pre_period_loss(F.col("loss_year")).cast("long")).withColumn("p", p)
    return out.withColumn("p6", F.round(F.col("p") * 1e6).cast("long")).withColumn("predicted", (F.col("p6") > 500000).cast("long"))


CELLS = """cells0 AS (
  SELECT c_custkey AS cell_id, r_name AS region, c_custkey % 50 AS rw, c_custkey // 50 AS col,
    8.5::DOUBLE + (c_custkey % 50) * 0.02::DOUBLE AS lat, 117.2::DOUBLE + (c_custkey // 50) * 0.02::DOUBLE AS lon,
    CAST(round((c_acctbal + 1000.0::DOUBLE) / 11.0::DOUBLE) AS BIGINT) AS tc10,
    CASE WHEN c_acctbal < 4000 THEN (coalesce(n, 0) * 7 + c_custkey) % 24 ELSE 0 END AS loss_year,
    ((c_custkey % 50) // 5) * 1000 + (c_custkey // 50) // 5 AS block, (c_custkey * 7919) % 15000 AS elev10
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cells1 AS (SELECT *, CASE WHEN loss_year >= 20 THEN 1::BIGINT ELSE 0 END AS high_risk, CASE WHEN loss_year > 0 AND loss_year <= 19 THEN 1::BIGINT ELSE 0 END AS pre_period_loss,
  1.0::DOUBLE / (1.0::DOUBLE + exp(-(-3.0::DOUBLE + 0.25::DOUBLE * loss_year - 0.001::DOUBLE * tc10))) AS p FROM cells0),
cells AS (SELECT *, CAST(round(p * 1e6) AS BIGINT) AS p6, CASE WHEN CAST(round(p * 1e6) AS BIGINT) > 500000 THEN 1::BIGINT ELSE 0 END AS predicted FROM cells1),
km AS (SELECT c.*, lat * 111.0::DOUBLE AS y, lon * 111.0::DOUBLE * cos(radians(m)) AS x FROM cells c, (SELECT avg(lat) AS m FROM cells))"""


def roads(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select((8.507 + ((k * 37) % 50) * 0.02).alias("lat"), (117.207 + ((k * 53) % 300) * 0.02).alias("lon"))


ROADS = "roads AS (SELECT 8.507::DOUBLE + ((s_suppkey * 37) % 50) * 0.02::DOUBLE AS lat, 117.207::DOUBLE + ((s_suppkey * 53) % 300) * 0.02::DOUBLE AS lon FROM supplier)"


def fires(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, d, "events").where("event_type = 'error'").select(k.alias("fire_id"), (8.5 + ((k * 13) % 1000) * 0.001).alias("lat"), (117.2 + ((k * 29) % 6000) * 0.001).alias("lon"), F.col("value").alias("frp"))


FIRES = "fires AS (SELECT event_id AS fire_id, 8.5::DOUBLE + ((event_id * 13) % 1000) * 0.001::DOUBLE AS lat, 117.2::DOUBLE + ((event_id * 29) % 6000) * 0.001::DOUBLE AS lon, value AS frp FROM events WHERE event_type = 'error')"


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    log = table(spark, d, "events").where("event_type IN ('click', 'purchase', 'error')")
    return log.select(k.alias("event_id"), ((F.col("user_id") * 10 + k % 10) % 150).alias("cell_id"), F.concat(F.lit("r"), F.floor(k / 10) % 3).alias("run_id"), F.when(F.col("event_type") == "error", "reject").otherwise("accept").alias("verdict"), F.col("ts").alias("updated_at"))


VERDICTS = """verdicts AS (SELECT event_id, (user_id * 10 + event_id % 10) % 150 AS cell_id, 'r' || ((event_id // 10) % 3) AS run_id,
  CASE WHEN event_type = 'error' THEN 'reject' ELSE 'accept' END AS verdict, ts AS updated_at FROM events WHERE event_type IN ('click', 'purchase', 'error'))"""


def areas(spark: SparkSession, d: str) -> DataFrame:
    """A rectangle for each nation, off the cells' places: (way_id, ring)."""
    k = F.col("n_nationkey")
    x0, y0 = 117.211 + ((k * 7) % 25) * 0.2, 8.511 + ((k * 3) % 10) * 0.1
    x1, y1 = x0 + 0.08, y0 + 0.06
    at = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    return table(spark, d, "nation").select(k.cast("long").alias("way_id"), F.array(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1), at(x0, y0)).alias("ring"))


AREAS = """areas AS (SELECT n_nationkey AS way_id, 117.211::DOUBLE + ((n_nationkey * 7) % 25) * 0.2::DOUBLE AS x0, 8.511::DOUBLE + ((n_nationkey * 3) % 10) * 0.1::DOUBLE AS y0 FROM nation),
area_boxes AS (SELECT way_id, x0, y0, x0 + 0.08::DOUBLE AS x1, y0 + 0.06::DOUBLE AS y1 FROM areas)"""


def boxes(spark: SparkSession) -> DataFrame:
    """Four review sites: two that overlap, one large, one empty."""
    return spark.createDataFrame([("north", 9.0, 9.41, 117.2, 117.5), ("overlap", 9.2, 9.5, 117.3, 117.9), ("all", 8.0, 10.0, 117.0, 125.0), ("sea", 1.0, 2.0, 100.0, 101.0)], "name string, lat_min double, lat_max double, lon_min double, lon_max double")


BOXES = "boxes AS (SELECT * FROM (VALUES ('north', 9.0::DOUBLE, 9.41::DOUBLE, 117.2::DOUBLE, 117.5::DOUBLE), ('overlap', 9.2, 9.5, 117.3, 117.9), ('all', 8.0, 10.0, 117.0, 125.0), ('sea', 1.0, 2.0, 100.0, 101.0)) t(name, lat_min, lat_max, lon_min, lon_max))"


def tiles(spark: SparkSession, d: str, odd: int) -> DataFrame:
    """A tile of 21 pixels for every second vector: the even ones before, the odd ones after; channels of 0 to 255."""
    e = F.col("embedding")
    channel = lambda k: F.transform(F.slice(e, 1 + 21 * k, 21), lambda v: F.floor(F.abs(v.cast("double")) * 255.0).cast("double"))
    k = F.floor(F.col("vec_id") / 2)
    return table(spark, d, "embeddings").where(F.col("vec_id") % 2 == odd).select(F.lit(12).cast("long").alias("z"), (3000 + k % 40).alias("x"), (1900 + F.floor(k / 40)).alias("y"), channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))


TILES = """px AS (SELECT vec_id // 2 AS k, vec_id % 2 AS odd, i, floor(abs(embedding[i]::DOUBLE) * 255.0::DOUBLE) AS r, floor(abs(embedding[i + 21]::DOUBLE) * 255.0::DOUBLE) AS g, floor(abs(embedding[i + 42]::DOUBLE) * 255.0::DOUBLE) AS b
  FROM embeddings, range(1, 22) t(i)),
exg AS (SELECT *, (2.0::DOUBLE * g - r - b) / greatest(r + g + b, 1.0::DOUBLE) AS e FROM px),
change AS (SELECT a.k, a.i, a.e AS e0, c.e AS e1, c.e - a.e AS d FROM exg a JOIN exg c ON a.k = c.k AND a.i = c.i AND a.odd = 0 AND c.odd = 1),
tile_change AS (SELECT 12::BIGINT AS z, 3000 + k % 40 AS x, 1900 + k // 40 AS y, count(*) AS pixels, count(*) FILTER (d < -0.08::DOUBLE) AS loss, count(*) FILTER (d > 0.08::DOUBLE) AS gain FROM change GROUP BY k)"""

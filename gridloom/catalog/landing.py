"""Orders landed month by month from lines of text, some months at the second attempt."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog import query
from gridloom.plans.shared import workdir
from gridloom.sources import landing

_SCHEMA = "orderkey long, cents long, priority string"


@query(
    "SELECT strftime(o_orderdate, '%Y-%m') AS chunk, 'done' AS status, CAST(CASE WHEN max(year(o_orderdate)) % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS attempts, CAST(count(*) FILTER (o_orderkey % 97 <> 5) AS BIGINT) AS n_rows, "
    "CAST(count(*) FILTER (o_orderkey % 97 = 5) AS BIGINT) AS n_dead, CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderkey % 97 <> 5), 0) AS BIGINT) AS cents FROM orders GROUP BY 1"
)
def landed_orders(spark, d):
    """Every order is a line of CSV, one in 97 of them damaged; a chunk is a month. Months of every third year can't be had at first, so a second pass takes them, and them alone, up again."""
    root = workdir(spark, "landed")
    orders = spark.read.parquet(f"{d}/orders.parquet")
    cents = F.when(F.col("o_orderkey") % 97 == 5, "n/a").otherwise(F.round(F.col("o_totalprice") * 100).cast("long").cast("string"))
    lines = orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("chunk"), F.concat_ws(",", F.col("o_orderkey").cast("string"), cents, "o_orderpriority").alias("line"), F.lit(None).cast("string").alias("error"))
    away = F.substring("chunk", 1, 4).cast("int") % 3 == 0
    landing.land(lines.withColumn("error", F.when(away, "unreachable")), _SCHEMA, root, "csv")
    landing.land(landing.pending(lines, root), _SCHEMA, root, "csv")
    sums = landing.landed(spark, _SCHEMA, root).groupBy("chunk").agg(F.sum("record.cents").alias("cents"))
    told = landing.ledger(spark, root).select("chunk", "status", "attempts", F.col("rows").alias("n_rows"), F.col("dead").alias("n_dead"))
    return told.join(sums, "chunk", "left").withColumn("cents", F.coalesce("cents", F.lit(0).cast("long")))

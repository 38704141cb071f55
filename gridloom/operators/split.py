"""Train and test splits that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geo import portable_hash
from gridloom.operators.spatial import radius_pairs, with_km


def block_of(row, col, size: int = 5):
    """A spatial block of size by size cells, from integer grid positions: no drift."""
    return F.floor(row / size) * 1000 + F.floor(col / size)


def stratified(df: DataFrame, label: str = "high_risk", test_tenths: int = 2) -> DataFrame:
    """Add ``is_test``: of each class, the floor of its test share with the smallest hashes. Ranks are taken in buckets of the hash first, so no
    task sorts a class."""
    h = df.withColumn("__h", portable_hash(F.col("cell_id"))).withColumn("__bucket", F.floor(F.col("__h") / 16777216))
    sums = h.groupBy(label, "__bucket").agg(F.count("*").alias("__n"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(label).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = sums.groupBy(label).agg(F.sum("__n").alias("__total"))
    within = F.row_number().over(Window.partitionBy(label, "__bucket").orderBy("__h", "cell_id"))
    ranked = h.withColumn("__rank", within).join(before.drop("__n"), [label, "__bucket"]).join(total, label)
    return ranked.withColumn("is_test", (F.col("__rank") + F.col("__before")) * 10 <= F.col("__total") * test_tenths).select(*df.columns, "is_test")


def spatial(df: DataFrame, block: str = "block", test_tenths: int = 2) -> DataFrame:
    """Add ``is_test``: whole blocks, at least one, those with the smallest hashes."""
    blocks = df.select(block).distinct()
    n = max(1, blocks.count() * test_tenths // 10)
    test = blocks.orderBy(portable_hash(F.col(block)), block).limit(n).withColumn("is_test", F.lit(True))
    return df.join(test, block, "left").withColumn("is_test", F.coalesce("is_test", F.lit(False))).select(*df.columns, "is_test")


def buffer_exclusion(df: DataFrame, km: float) -> DataFrame:
    """``df`` (with is_test) without the test cells closer than ``km`` to a training cell."""
    if km <= 0:
        return df
    flat = with_km(df).select("cell_id", "x", "y", "is_test")
    close = radius_pairs(flat.where("is_test").drop("is_test"), flat.where("NOT is_test").drop("is_test"), km).select("cell_id").distinct()
    return df.join(close, "cell_id", "left_anti")

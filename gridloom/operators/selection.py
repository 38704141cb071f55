"""Exact quantiles without a sort: a place in the order is found by counting, for a whole frame or for many groups at once.

A group's values between the least and the largest are counted in equal buckets, in each task first; the bucket that holds the place has its own least and largest value, between which
the next round counts, until they are one value. The least and the largest of a round fall into different buckets, so that every round narrows; whole numbers of up to some ten thousand different
values take one round, and any values about ten. What a round sorts are a group's ``buckets``, however many rows there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.plans.shared import materialize, release, small_side

#: Buckets of a round for one group, and for each of many.
WIDE, NARROW = 65_536, 512
MAX_ROUNDS = 100


def _part(first: bool) -> Column:
    """Where ``x`` lies between ``lo`` and ``hi``, from 0 to 1 and in order. After the first round spans of both signs are parted by sign, and those of very different sizes by
    logarithms, so that values near zero are told apart as fast as others."""
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    span = hi - lo
    halves = (x / 2 - lo / 2) / (hi / 2 - lo / 2)  # where the span is beyond the largest double
    part = F.when(span < F.lit(float("inf")), (x - lo) / span).otherwise(halves)
    if first:
        return part
    signs = F.when(x < 0, 0.0).when(x == 0, 0.5).otherwise(1.0)
    ups = (F.log(x) - F.log(lo)) / (F.log(hi) - F.log(lo))
    downs = (F.log(-lo) - F.log(-x)) / (F.log(-lo) - F.log(-hi))
    return F.when((lo < 0) & (hi >= 0) | (lo == 0), signs).when((lo > 0) & (hi / 1024 > lo), ups).when((hi < 0) & (lo / 1024 < hi), downs).otherwise(part)


def exact_quantiles(df: DataFrame, value: str, qs: dict[str, float], by: tuple[str, ...] = (), buckets: int | None = None) -> DataFrame:
    """``by`` with a column for each of ``qs`` (name -> share), the exact quantile of ``value`` by linear interpolation; without ``by`` one row. Nulls and values that aren't finite
    don't count; of a group without others the quantiles are null. Null groups are groups."""
    buckets = buckets or (NARROW if by else WIDE)
    x = F.col(value).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    keys = [f"g{i}" for i in range(len(by))]
    rows = materialize(df.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.when(finite, x).alias("x")), "quantile-values")

    def settled(df: DataFrame) -> DataFrame:
        """Targets between rounds: of one group they are a few rows by number of ``qs``, of many a table."""
        return materialize(df, "quantile-targets") if keys else df.sparkSession.createDataFrame(df.collect(), df.schema)

    # a target is a place in a group's order: of each quantile the two places that it lies between
    ends = rows.groupBy(*keys).agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    places = F.explode(F.array(*(F.struct(F.lit(name).alias("q"), F.lit(q).alias("share"), F.lit(up).alias("up")) for name, q in qs.items() for up in (0, 1))))
    targets = ends.select(*keys, "n", "lo", "hi", places.alias("t")).select(*keys, "lo", "hi", "t.q", "t.share", "t.up", (F.col("t.share") * (F.col("n") - 1)).alias("at"))
    targets = settled(targets.withColumn("rank", F.when(F.col("up") == 1, F.ceil("at")).otherwise(F.floor("at"))))
    first = True
    for _ in range(MAX_ROUNDS):
        if targets.where("lo < hi").isEmpty():
            break
        # targets of one span are counted once
        spans = targets.where("lo < hi").select(*keys, "lo", "hi").distinct()
        held = spans.select(*(F.col(k).alias(f"s_{k}") for k in keys), "lo", "hi")
        same = F.col("x").between(F.col("lo"), F.col("hi"))
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"s_{k}"))
        inside = rows.join(F.broadcast(held) if not keys else small_side(materialize(held, "quantile-spans")), same)
        bucket = F.least(F.floor(_part(first) * buckets), F.lit(buckets - 1))
        first = False
        counted = inside.groupBy(*keys, "lo", "hi", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "lo", "hi").orderBy("bucket"))
        counted = counted.withColumn("upto", upto).select(*(F.col(k).alias(f"c_{k}") for k in keys), F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi"), "n", "least", "most", "upto")
        match = (F.col("lo") == F.col("c_lo")) & (F.col("hi") == F.col("c_hi")) & (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"c_{k}"))
        found = targets.join(counted, match, "left")
        known = F.col("least").isNotNull()
        new = found.select(
            *keys, F.when(known, F.col("least")).otherwise(F.col("lo")).alias("lo"), F.when(known, F.col("most")).otherwise(F.col("hi")).alias("hi"), "q", "share", "up", "at",
            F.when(known, F.col("rank") - (F.col("upto") - F.col("n"))).otherwise(F.col("rank")).alias("rank"),
        )
        before, targets = targets, settled(new)
        release(before)
    else:
        raise RuntimeError(f"quantiles did not settle in {MAX_ROUNDS} rounds")
    release(rows)
    of = lambda name, up: F.max(F.when((F.col("q") == name) & (F.col("up") == up), F.col("lo")))
    share = lambda name: F.max(F.when(F.col("q") == name, F.col("at") - F.floor("at")))
    out = targets.groupBy(*keys).agg(*((of(name, 0) + (of(name, 1) - of(name, 0)) * share(name)).alias(name) for name in qs))
    return out.select(*(F.col(k).alias(c) for c, k in zip(by, keys)), *qs)

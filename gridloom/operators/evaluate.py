"""Metrics of predictions, each in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scores import ratio
from gridloom.operators.raster import predicted_loss


def confusion(label: Column, predicted: Column) -> list[Column]:
    cell = lambda a, b, name: F.count_if((label == a) & (predicted == b)).alias(name)
    return [cell(1, 1, "tp"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(0, 0, "tn")]


def with_rates(df: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall, f1 to tp, fp, fn, tn; 0 where a denominator is."""
    c = {k: F.col(k) for k in ("tp", "fp", "fn", "tn")}
    return (
        df.withColumn("accuracy", ratio(c["tp"] + c["tn"], c["tp"] + c["fp"] + c["fn"] + c["tn"]))
        .withColumn("precision", ratio(c["tp"], c["tp"] + c["fp"]))
        .withColumn("recall", ratio(c["tp"], c["tp"] + c["fn"]))
        .withColumn("f1", ratio(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]))
    )


def metrics(df: DataFrame, label: str = "high_risk", predicted: str = "predicted") -> DataFrame:
    return with_rates(df.agg(*confusion(F.col(label), F.col(predicted))))


def outcome(label: Column, predicted: Column) -> Column:
    return F.when(predicted == 1, F.when(label == 1, "tp").otherwise("fp")).otherwise(F.when(label == 1, "fn").otherwise("tn"))


def threshold_sweep(df: DataFrame, label: str = "high_risk", ppm: str = "p6") -> DataFrame:
    """(threshold in hundredths, tp, fp, fn, precision, recall, f1, best) at 10, 15 .. 85: one pass counts the steps that each row reaches, sums from above
    give the rest. best marks the first largest f1."""
    steps = 16
    reached = F.greatest(F.lit(-1), F.least(F.lit(steps - 1), F.floor((F.col(ppm) - 100000) / 50000))).cast("int")
    counts = df.groupBy(reached.alias("step")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    grid = df.sparkSession.range(-1, steps).select(F.col("id").cast("int").alias("step"))
    w = Window.orderBy(F.desc("step"))  # 17 rows
    up = grid.join(counts, "step", "left").na.fill(0, ["pos", "neg"]).withColumn("tp", F.sum("pos").over(w)).withColumn("fp", F.sum("neg").over(w))
    all_ = Window.partitionBy()
    up = up.withColumn("fn", F.sum("pos").over(all_) - F.col("tp")).where("step >= 0").withColumn("threshold", F.col("step") * 5 + 10)
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    up = up.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("f1", f1)
    first = F.row_number().over(Window.orderBy(F.desc("f1"), "step")) == 1
    return up.withColumn("best", first & (F.col("f1") > 0)).select("threshold", "tp", "fp", "fn", "precision", "recall", "f1", "best")


def correlation(x: Column, y: Column) -> Column:
    """Pearson, 0 where either side doesn't vary."""
    varies = (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).otherwise(0.0)


def leakage_scan(df: DataFrame, features: list[str], label: str = "high_risk") -> DataFrame:
    """(feature, r, varies) of every feature with the label."""
    row = df.agg(*(F.struct(F.lit(f).alias("feature"), correlation(F.col(f).cast("double"), F.col(label).cast("double")).alias("r"), (F.stddev_pop(f) > 1e-10).alias("varies")).alias(f) for f in features))
    return row.select(F.inline(F.array(*features)))


def change_validation(df: DataFrame, exg: str, label: str = "high_risk", limit: float = -0.05, least: int = 10) -> DataFrame:
    """Agreement of a vegetation change with the truth: r, group means, counts, precision, recall, f1; under ``least`` rows valid is false and reason says so."""
    e, y = F.col(exg), F.col(label)
    row = df.where(e.isNotNull()).agg(F.count("*").alias("n"), correlation(e, y.cast("double")).alias("r"), F.avg(F.when(y == 1, e)).alias("mean_loss"), F.avg(F.when(y == 0, e)).alias("mean_stable"), *confusion(y, predicted_loss(e, limit).cast("int")))
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    row = row.withColumn("valid", F.col("n") >= least).withColumn("reason", F.when(F.col("n") < least, F.format_string("Only %d valid land points found", "n")))
    return row.withColumn("precision", p).withColumn("recall", r).withColumn("f1", 2 * p * r / F.greatest(p + r, F.lit(0.001)))


def class_weights(df: DataFrame, label: str = "high_risk") -> DataFrame:
    """(label, n, weight): rows / (2 * class's rows); boost: negatives over positives."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    all_ = Window.partitionBy()  # two rows
    pos, neg = F.sum(F.when(F.col(label) == 1, F.col("n"))).over(all_), F.sum(F.when(F.col(label) == 0, F.col("n"))).over(all_)
    return counts.select(F.col(label).alias("label"), "n", (F.sum("n").over(all_) / (2.0 * F.col("n"))).alias("weight"), (F.coalesce(neg, F.lit(0)) / F.greatest(F.coalesce(pos, F.lit(0)), F.lit(1))).alias("boost"))

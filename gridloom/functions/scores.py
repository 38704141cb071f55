"""Labels, tiers and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH_RISK_FROM, PRE_UNTIL = 20, 19


def high_risk(loss_year: Column) -> Column:
    return (loss_year >= HIGH_RISK_FROM).cast("int")


def pre_period_loss(loss_year: Column) -> Column:
    return ((loss_year > 0) & (loss_year <= PRE_UNTIL)).cast("int")


def calendar_year(loss_year: Column) -> Column:
    return F.when(loss_year > 0, loss_year + 2000)


def risk_tier(p: Column) -> Column:
    return F.when(p > 0.7, "red").when(p > 0.4, "amber").otherwise("green")


def severity(mean_p: Column) -> Column:
    return F.when(mean_p > 0.7, "critical").when(mean_p > 0.4, "elevated").otherwise("moderate")


def excess_green(r: Column, g: Column, b: Column) -> Column:
    """2g - r - b on channels over their sum, the sum 1 at least."""
    s = F.greatest(r + g + b, F.lit(1.0))
    return (2.0 * g - r - b) / s


def change_class(change: Column, limit: float = 0.08) -> Column:
    return F.when(change < -limit, "loss").when(change > limit, "gain").otherwise("stable")


def population_estimate(served: Column, distance_km: Column) -> Column:
    """The served density, or a decay with distance from roads where there is none."""
    return F.when(served > 0, served).otherwise(F.greatest(F.lit(0.0), 50.0 * F.exp(-distance_km / 10.0)))


def display_name(region: Column) -> Column:
    return F.initcap(F.translate(region, "_", " "))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))

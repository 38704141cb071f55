"""Sums over the disc around each cell of a regular grid: one exchange of little more than the cells, where pairs need a row for every neighbour."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geo import KM_PER_DEGREE
from gridloom.operators.spatial import radius_pairs, with_km
from gridloom.plans.shared import dealt

#: Side, in cells, of the squares of the grid that a task adds up.
TILE = 64
#: Km by which a distance must miss the radius, and degrees by which a cell may miss its place, for the grid to tell what is inside.
SURE_KM, OFF_GRID = 1e-6, 1e-9


def half_widths(mean_lat: float, step: float, radius: float) -> list[tuple[int, int]] | None:
    """(row offset, columns to either side) of the disc of ``radius`` km, its edge left out; None if a place lies so near the edge that only coordinates can tell."""
    down, across = step * KM_PER_DEGREE, step * KM_PER_DEGREE * math.cos(math.radians(mean_lat))
    rows = math.ceil(radius / down)
    found = []
    for dr in range(-rows - 1, rows + 2):
        if abs(abs(dr) * down - radius) <= SURE_KM:
            return None
        if abs(dr) * down < radius:
            w = math.ceil(math.sqrt(radius**2 - (dr * down) ** 2) / across) - 1
            if any(abs(math.hypot(dr * down, c * across) - radius) <= SURE_KM for c in (w, w + 1)):
                return None
            found.append((dr, w))
    return found


def _steps(widths: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(row offset, column offset, sign): where along its rows a cell's value comes into the running sum and where it leaves; never at its own place."""
    out = []
    for dr, w in widths:
        out += [(dr, -w, 1), (dr, w + 1, -1)] + ([(0, 0, -1), (0, 1, 1)] if dr == 0 else [])
    return out


def disc_sums(cells: DataFrame, values: list[str], radius: float, step: float) -> DataFrame:
    """cell_id with n, the cells closer than ``radius`` km and off the cell's own place, and the sums over them of ``values`` (integers, exact; nulls count as 0).

    ``cells`` has cell_id (unique), lat, lon, and rw, col, the place on a grid of ``step`` degrees; it is read twice. A cell's value enters a row's running sum at one column of the
    disc and leaves it at another, so a neighbourhood costs two steps a row and not a pair for each neighbour. Squares of TILE by TILE cells, copied with the rim that
    reaches into others, are exchanged once; steps are added up by place before they are put in order, so a square holds at most a few rows for each of its places.
    Cells that lie off the grid, have no coordinates, or a grid on which a place falls on the disc's edge go the way of pairs, with the same result.
    """
    a, o = F.col("lat") - F.col("rw") * step, F.col("lon") - F.col("col") * step
    facts = cells.agg(F.avg("lat").alias("mean"), F.count("*").alias("rows"), F.count(a + o).alias("placed"), (F.max(a) - F.min(a)).alias("a"), (F.max(o) - F.min(o)).alias("o")).first()
    on_grid = facts.rows and facts.rows == facts.placed and facts.a <= OFF_GRID and facts.o <= OFF_GRID
    widths = half_widths(facts.mean, step, radius) if on_grid else None
    if widths is None or max(w for _, w in widths) > TILE:
        return _by_pairs(cells, values, radius)
    return _by_steps(cells, values, widths, facts.rows)


def _by_pairs(cells: DataFrame, values: list[str], radius: float) -> DataFrame:
    flat = with_km(cells).select("cell_id", "x", "y", *values)
    pairs = radius_pairs(flat.select("cell_id", "x", "y"), flat, radius, apart=True)
    sums = pairs.groupBy("cell_id").agg(F.count("*").alias("n"), *(F.sum(f"r_{v}").alias(v) for v in values))
    filled = cells.select("cell_id").join(sums, "cell_id", "left")
    return filled.select("cell_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", *values)))


def _by_steps(cells: DataFrame, values: list[str], widths: list[tuple[int, int]], rows: int = 0) -> DataFrame:
    high, wide = max(dr for dr, _ in widths), max(w for _, w in widths)
    tiles = lambda c, reach: F.sequence(F.floor((F.col(c) - reach) / TILE), F.floor((F.col(c) + reach) / TILE))
    flat = cells.select("cell_id", F.col("rw").cast("long").alias("__r"), F.col("col").cast("long").alias("__c"), F.lit(1).cast("long").alias("n"), *(F.coalesce(F.col(v).cast("long"), F.lit(0)).alias(v) for v in values))
    copies = flat.withColumn("__tr", F.explode(tiles("__r", high))).withColumn("__tc", F.explode(tiles("__c", wide))).repartition("__tr", "__tc")
    copies = dealt(copies, rows, "__tr", "__tc")
    inside = lambda r, c: (F.floor(r / TILE) == F.col("__tr")) & (F.floor(c / TILE) == F.col("__tc"))

    step = lambda r, c, sign: F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(sign).alias("sign"))
    steps = F.array(*(step(*s) for s in _steps(widths)))
    own = F.when(inside(F.col("__r"), F.col("__c")), F.array(step(0, 0, 0))).otherwise(F.array().cast("array<struct<r:int,c:int,sign:int>>"))  # sign 0 asks for the sum
    moved = copies.withColumn("__s", F.explode(F.concat(steps, own)))
    at_r, at_c = F.col("__r") + F.col("__s.r"), F.greatest(F.col("__c") + F.col("__s.c"), F.col("__tc") * TILE)  # what began before the square begins with it
    placed = moved.select("__tr", "__tc", at_r.alias("__r"), at_c.alias("__c"), F.when(F.col("__s.sign") == 0, F.col("cell_id")).alias("cell_id"), *((F.col(v) * F.col("__s.sign")).alias(v) for v in ("n", *values)))
    summed = placed.where(inside(F.col("__r"), F.col("__c"))).groupBy("__tr", "__tc", "__r", "__c", "cell_id").agg(*(F.sum(v).alias(v) for v in ("n", *values)))
    along = Window.partitionBy("__tr", "__tc", "__r").orderBy("__c")  # by range: all steps of a place count there
    return summed.select("cell_id", *(F.sum(v).over(along).alias(v) for v in ("n", *values))).where("cell_id IS NOT NULL")

"""Spatial joins. Radius joins meet in bins of the radius' size, so that candidates grow with density and not with the square of the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geo import haversine_km, project_km
from gridloom.plans.shared import BROADCAST_BYTES, materialize

MISSING_KM = 999.0


def with_km(df: DataFrame, frame: DataFrame | None = None, mean_lat: Column | None = None) -> DataFrame:
    """Add x, y in km around the mean latitude of ``frame`` (of ``df`` itself without one). The mean is of the whole frame, whatever is filtered later."""
    if mean_lat is None:
        mean = (df if frame is None else frame).agg(F.avg("lat").alias("__mean"))
        df = df.crossJoin(F.broadcast(mean))  # one row
        mean_lat = F.col("__mean")
    x, y = project_km(F.col("lat"), F.col("lon"), mean_lat)
    return df.withColumn("x", x).withColumn("y", y).drop("__mean")


def radius_pairs(left: DataFrame, right: DataFrame, radius: float, inclusive: bool = False, apart: bool = False) -> DataFrame:
    """Pairs of ``left`` and ``right`` rows (both with x, y; right columns come with prefix r_) closer than ``radius``.

    ``inclusive``: at most; ``apart``: further than 0, which leaves out a row itself and what shares its place. The right side is copied to its
    nine bins; a bin that holds very many rows is split by the adaptive skew join.
    """
    near = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    spot = lambda c: F.floor(F.col(c) / radius)
    right = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    right = right.withColumn("__dx", F.explode(near)).withColumn("__dy", F.explode(near)).withColumn("__bx", spot("r_x") + F.col("__dx")).withColumn("__by", spot("r_y") + F.col("__dy")).drop("__dx", "__dy")
    left = left.withColumn("__bx", spot("x")).withColumn("__by", spot("y"))
    d = F.sqrt((F.col("x") - F.col("r_x")) ** 2 + (F.col("y") - F.col("r_y")) ** 2)
    pairs = left.join(right, ["__bx", "__by"]).withColumn("d", d).drop("__bx", "__by")
    return pairs.where((F.col("d") <= radius if inclusive else F.col("d") < radius) & ((F.col("d") > 0) if apart else F.lit(True)))


def _sphere(lat: str, lon: str) -> dict[str, Column]:
    """Places on the unit sphere: no seam at longitude 180 and no poles."""
    phi, lam = F.radians(lat), F.radians(lon)
    return {"u": F.cos(phi) * F.cos(lam), "v": F.cos(phi) * F.sin(lam), "w": F.sin(phi)}


_AXES = ("u", "v", "w")
#: How many times a cube's side holds that of the cubes inside it.
TIMES = 8


def _cube(axis: str, side: float) -> Column:
    return F.floor((F.col(axis) + 1.0) / side)


def _id(*places: Column) -> Column:
    """Three places of a cube as one number, each below 2^20."""
    a, b, c = places
    return (a * (1 << 40) + b * (1 << 20) + c).cast("long")


#: Points that an occupied cube should hold on average at most, and how many times a cube's side is halved for that.
CROWD, HALVINGS = 4, 8


def _side(degrees: float) -> float:
    return 2 * math.sin(math.radians(degrees) / 2)


def fitting_side(points: DataFrame, step: float) -> tuple[int, float]:
    """(points, side): how many ``points`` (r_u, r_v, r_w) there are, and the side of cubes of ``step`` degrees, halved while they hold more than CROWD points each. Halving ends
    where it no longer parts them. The cubes are counted roughly: the side decides what is looked at first, not what is found."""
    sides = [s for s in (_side(step / 2**k) for k in range(HALVINGS + 1)) if s == _side(step) or 2 / s < (1 << 20) - 2]
    n, *cubes = points.agg(F.count("*"), *(F.approx_count_distinct(_id(*(_cube(f"r_{a}", s) for a in _AXES))) for s in sides)).first()
    k = 0
    while k + 1 < len(sides) and n > CROWD * cubes[k] and cubes[k + 1] > 1.5 * cubes[k]:
        k += 1
    return n, sides[k]


def nearest(left: DataFrame, right: DataFrame, key: str, step: float = 0.1) -> DataFrame:
    """``left``'s key with ``km``, the haversine distance to the nearest of ``right`` (lat, lon), MISSING_KM if there is none.

    Places become points of the unit sphere, in cubes of ``step`` degrees, or smaller ones where points crowd them. A row whose nearest among the 27 cubes around it is closer than a cube's
    side has its answer; of rows and points, the few points are sent to the rows' tasks, and many are dealt to the cubes around them, so that a row is sent but once. The
    others descend from cubes as large as the globe, TIMES smaller at each level: of the occupied cubes inside those that are left, a row keeps those that begin
    no further off than the nearest point that it knows, each cube having one that stands for it. So a row's candidates depend on how many cubes are about as far as
    its answer, not on how many points there are. Haversine distances are taken of the last candidates alone. ``left``'s keys are unique. A row of ``left``
    without a latitude or longitude stays, its km null; such rows of ``right`` are no points.
    """
    right = materialize(right.select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")).where("r_lat IS NOT NULL AND r_lon IS NOT NULL").distinct(), "nearest")
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    points = right.withColumns({f"r_{a}": c for a, c in _sphere("r_lat", "r_lon").items()})
    n, side = fitting_side(points, step)
    if not n:
        return left.select(key, F.when(placed, MISSING_KM).alias("km"))
    nowhere = left.where(~placed).select(key, F.lit(None).cast("double").alias("km"))
    points = points.withColumns({f"c_{a}": _cube(f"r_{a}", side) for a in _AXES})
    points = points.select("r_lat", "r_lon", *(f"r_{a}" for a in _AXES), *(f"c_{a}" for a in _AXES), _id(*(F.col(f"c_{a}") for a in _AXES)).alias("cube"))
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    chord = F.sqrt(sum((F.col(a) - F.col(f"r_{a}")) ** 2 for a in _AXES))
    few = n * 64 <= BROADCAST_BYTES  # and so are the occupied cubes of any size
    small = F.broadcast if few else (lambda level: level)

    todo = left.where(placed).select(key, "lat", "lon").repartition(key).withColumns(_sphere("lat", "lon"))  # dealt out before they meet points: pairs with few need no exchange
    near = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    shifts = lambda df: df.withColumn("n_u", F.explode(near)).withColumn("n_v", F.explode(near)).withColumn("n_w", F.explode(near))
    if few:
        pairs = shifts(todo).withColumn("cube", _id(*(_cube(a, side) + F.col(f"n_{a}") for a in _AXES))).join(F.broadcast(points), "cube")
    else:
        beside = {a: F.col(f"c_{a}") + F.col(f"n_{a}") for a in _AXES}
        middle = {a: (c + 0.5) * side - 1.0 for a, c in beside.items()}
        through = F.abs(F.sqrt(sum(c * c for c in middle.values())) - 1.0) <= side * 0.867  # the sphere passes within half a diagonal of a cube's middle, or not through the cube
        dealt = shifts(points).where(through).withColumn("cube", _id(*beside.values())).select("cube", "r_lat", "r_lon", *(f"r_{a}" for a in _AXES))
        pairs = todo.withColumn("cube", _id(*(_cube(a, side) for a in _AXES))).join(dealt, "cube")
    # without an answer in sight, a row has none of these
    found = pairs.groupBy(key).agg(F.min(chord).alias("chord"), F.min(km).alias("km"))  # plain numbers: a least struct would sort all pairs
    done = materialize(found.where(F.col("chord") <= side * (1 - 1e-9)).select(key, "km"), "nearest")
    todo = materialize(todo.join(done.select(key), key, "left_anti"), "nearest")
    if todo.isEmpty():
        return done.unionByName(nowhere)

    levels = [points.groupBy("cube").agg(*(F.first(f"c_{a}").alias(f"c_{a}") for a in _AXES), F.min(F.struct(*(f"r_{a}" for a in _AXES))).alias("rep"))]
    sides = [side]
    while sides[-1] < 1.0:
        up = [F.floor(F.col(f"c_{a}") / TIMES).alias(f"c_{a}") for a in _AXES]
        above = levels[-1].select(*up, "rep").groupBy(*(f"c_{a}" for a in _AXES)).agg(F.min("rep").alias("rep"))
        levels.append(above.withColumn("cube", _id(*(F.col(f"c_{a}") for a in _AXES))))
        sides.append(TIMES * sides[-1])
    rows = todo.withColumn("parent", F.lit(0).cast("long"))  # the largest cubes, 27 at most, have one parent
    for k in range(len(levels) - 1, -1, -1):
        width, level = sides[k], levels[k].withColumn("parent", _id(*(F.floor(F.col(f"c_{a}") / TIMES) for a in _AXES)))
        rep = F.sqrt(sum((F.col(a) - F.col(f"rep.r_{a}")) ** 2 for a in _AXES))
        gap = lambda a: F.greatest(F.lit(0.0), F.col(f"c_{a}") * width - 1.0 - F.col(a), F.col(a) - ((F.col(f"c_{a}") + 1) * width - 1.0))  # noqa: B023, E731
        begins = F.sqrt(sum(gap(a) ** 2 for a in _AXES))
        rows = rows.join(F.broadcast(level) if k == len(levels) - 1 else small(level), "parent").withColumn("rep_d", rep).withColumn("begins", begins)
        rows = rows.withColumn("known", F.min("rep_d").over(Window.partitionBy(key))).where(F.col("begins") <= F.col("known") + 1e-9)
        rows = rows.select(key, "lat", "lon", *_AXES, F.col("cube").alias("parent"))
    last = rows.withColumnRenamed("parent", "cube").join(points, "cube").groupBy(key).agg(F.min(km).alias("km"))
    return done.unionByName(last).unionByName(nowhere)


def in_box(df: DataFrame, lat_min=None, lat_max=None, lon_min=None, lon_max=None) -> DataFrame:
    """Inclusive box; without all four bounds nothing is filtered."""
    if None in (lat_min, lat_max, lon_min, lon_max):
        return df
    return df.where(F.col("lat").between(lat_min, lat_max) & F.col("lon").between(lon_min, lon_max))


def join_boxes(boxes: DataFrame, cells: DataFrame, step: float = 1.0) -> DataFrame:
    """Cells in named boxes (name, lat_min .. lon_max), inclusive; a cell may lie in several, and a box without cells keeps a row of nulls. Boxes are cut
    along a grid of ``step`` degrees, so that the join is by equality."""
    parts = boxes.withColumn("by", F.explode(F.sequence(F.floor(F.col("lat_min") / step), F.floor(F.col("lat_max") / step)))).withColumn("bx", F.explode(F.sequence(F.floor(F.col("lon_min") / step), F.floor(F.col("lon_max") / step))))
    spots = cells.withColumn("by", F.floor(F.col("lat") / step)).withColumn("bx", F.floor(F.col("lon") / step))
    hits = spots.join(parts, ["by", "bx"]).where("lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max").drop("by", "bx", "lat_min", "lat_max", "lon_min", "lon_max")
    return boxes.select("name").join(hits, "name", "left")


def inside_any(cells: DataFrame, rings: DataFrame, key: str = "cell_id", step: float = 0.5) -> DataFrame:
    """(key, protected 0/1): whether a cell lies in any ring; ``rings`` (ring) of under four points don't count, and open ones are closed. Each ring is an area of its own."""
    from gridloom.operators.polygons import edges_of_rings, inside_areas

    numbered = rings.select(F.monotonically_increasing_id().alias("way_id"), "ring")
    edges = materialize(edges_of_rings(numbered), "ring-edges")  # written: a ring keeps its number
    return inside_areas(cells, edges, key, step).select(key, F.col("inside").cast("int").alias("protected"))


def nearest_cell(cells: DataFrame, lat: float, lon: float, key: str = "cell_id") -> DataFrame:
    """The cell closest to a point in degrees; of equals the smallest key."""
    d2 = (F.col("lat") - lat) ** 2 + (F.col("lon") - lon) ** 2
    return cells.orderBy(d2, key).limit(1)


def tiles_of_boxes(boxes: DataFrame, zoom: int = 12, limit: int | None = 100) -> DataFrame:
    """(name, x, y) of the tiles that cover each of ``boxes`` (name, lat_min .. lon_max); of a box the first ``limit`` tiles, by x, then y, as shown."""
    from gridloom.functions.geo import tile_of

    x0, y1 = tile_of(F.col("lat_min"), F.col("lon_min"), zoom)
    x1, y0 = tile_of(F.col("lat_max"), F.col("lon_max"), zoom)
    columns = boxes.select("name", F.sequence(y0, y1).alias("ys"), F.posexplode(F.sequence(x0, x1)).alias("i", "x"))
    tiles = columns.select("name", "x", "i", F.size("ys").alias("n"), F.posexplode("ys").alias("j", "y"))
    return (tiles.where(F.col("i") * F.col("n") + F.col("j") < limit) if limit else tiles).select("name", "x", "y")


def grids_of_boxes(boxes: DataFrame, step: float) -> DataFrame:
    """(name, rw, col, lat, lon) of the cells of each of ``boxes`` (name, lat_min .. lon_max), ends exclusive. A box's rows are dealt out before they become cells."""
    count = lambda lo, hi: F.ceil((F.col(hi) - F.col(lo)) / step)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1))
    rows = boxes.withColumns({"rw": F.explode(upto(count("lat_min", "lat_max")))}).repartition("name", "rw")
    cells = rows.withColumn("col", F.explode(upto(count("lon_min", "lon_max"))))
    return cells.select("name", "rw", "col", (F.col("lat_min") + F.col("rw") * F.lit(step)).alias("lat"), (F.col("lon_min") + F.col("col") * F.lit(step)).alias("lon"))


def grid(spark, lat_min: float, lat_max: float, lon_min: float, lon_max: float, step: float) -> DataFrame:
    """Cells of a box, ends exclusive: cell_id, rw, col, lat, lon."""
    n_lat, n_lon = math.ceil((lat_max - lat_min) / step), math.ceil((lon_max - lon_min) / step)
    i = F.col("id")
    cells = spark.range(n_lat * n_lon).select(i.alias("cell_id"), F.floor(i / n_lon).alias("rw"), (i % n_lon).alias("col"))
    return cells.withColumn("lat", F.lit(lat_min) + F.col("rw") * F.lit(step)).withColumn("lon", F.lit(lon_min) + F.col("col") * F.lit(step))

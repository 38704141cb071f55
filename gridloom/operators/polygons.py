"""Points in polygons by an index of grid squares: an area is its edges, and a square holds only the edges that touch it.

Whether a point lies in an area is the parity of edges east of it. From a square's south-west corner to a point in it one can go north, then east, without leaving the square, so the point's
parity is the corner's and that of the square's own edges on the way. A corner's parity is read off the edges that cross its row's lower line. Squares inside an area, without edges, answer
without a test. A ring of n vertices is never sent whole anywhere: work and exchange grow with edges and squares touched, and with the points.

As parity needs edges and no order, a hole is an inner ring's edges beside the outer's, and a relation's ways need no stitching: only that every node ends an even number of its edges.
Points off all borders are told exactly; rows without a place, or with one that isn't a number, lie in no area.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the grid's lines are counted from, off the round coordinates that data likes to stand on.
ORIGIN = 0.0013819660112501
#: Degrees by which an edge's place is widened when its squares are looked for.
SLACK = 1e-9
EDGE = "ax double, ay double, bx double, by double"


def edges_of_rings(rings: DataFrame) -> DataFrame:
    """(area, ax, ay, bx, by) of ``rings`` (way_id, ring array<struct<lon, lat>>); several rings of one id are one area, the inner ones its holes."""
    n = F.size("ring")
    same = (F.col("ring")[0]["lon"] == F.element_at("ring", -1)["lon"]) & (F.col("ring")[0]["lat"] == F.element_at("ring", -1)["lat"])
    closed = F.when(same, F.col("ring")).otherwise(F.concat("ring", F.array(F.col("ring")[0])))
    rings = rings.where(n >= 4).select(F.col("way_id").alias("area"), closed.alias("ring"))
    m = F.size("ring") - 1
    pairs = F.arrays_zip(F.slice("ring", F.lit(1), m).alias("a"), F.slice("ring", F.lit(2), m).alias("b"))
    edges = rings.select("area", F.explode(pairs).alias("e"))
    return edges.select("area", F.col("e.a.lon").alias("ax"), F.col("e.a.lat").alias("ay"), F.col("e.b.lon").alias("bx"), F.col("e.b.lat").alias("by"))


def edges_of_relations(members: DataFrame, ways: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Areas of relations: ``members`` (relation, way), ``ways`` (id, nodes), ``nodes`` (id, lon, lat). Returns (area, ax, ay, bx, by) and the relations that aren't
    closed (area, ends: the nodes where an odd number of edges end, as where a way or a node is unknown), whose edges are left out."""
    used = members.select(F.col("relation").alias("area"), F.col("way").alias("id")).distinct().join(ways, "id", "left")
    m = F.size("nodes") - 1
    pairs = F.when(m > 0, F.arrays_zip(F.slice("nodes", F.lit(1), m).alias("a"), F.slice("nodes", F.lit(2), m).alias("b")))
    steps = used.select("area", F.explode_outer(pairs).alias("e")).select("area", F.col("e.a").alias("a"), F.col("e.b").alias("b"))
    place = lambda end, x, y: nodes.select(F.col("id").alias(end), F.col("lon").alias(x), F.col("lat").alias(y))
    edges = steps.join(place("a", "ax", "ay"), "a", "left").join(place("b", "bx", "by"), "b", "left")
    known = F.col("ax").isNotNull() & F.col("bx").isNotNull()
    ends = edges.select("area", known.alias("known"), F.explode(F.array("a", "b")).alias("node"))
    odd = ends.groupBy("area", "node").agg(F.count_if("known").alias("n"), F.count_if(~F.col("known")).alias("lost")).where("n % 2 = 1 OR lost > 0 OR node IS NULL")
    open_ = odd.groupBy("area").agg(F.count("*").alias("ends"))
    return edges.where(known).join(open_, "area", "left_anti").select("area", "ax", "ay", "bx", "by"), open_


def _square(value: Column, step: float) -> Column:
    return F.floor((value - ORIGIN) / step).cast("long")


def _line(i: Column, step: float) -> Column:
    return F.lit(ORIGIN) + i * F.lit(step)


def _at(edge, y: Column) -> Column:
    """Where the line through an edge is at latitude ``y``."""
    return F.try_divide((edge("bx") - edge("ax")) * (y - edge("ay")), edge("by") - edge("ay")) + edge("ax")


def squares_of(edges: DataFrame, step: float) -> DataFrame:
    """(gy, gx, areas array<struct<corner, edges>>): every square that an area touches or covers, with the parity of its south-west corner and its own edges. A square that
    one area covers whole holds that area alone."""
    edges = edges.where("ax IS NOT NULL AND ay IS NOT NULL AND bx IS NOT NULL AND by IS NOT NULL")
    south, north = F.least("ay", "by"), F.greatest("ay", "by")
    rows = F.sequence(_square(south - SLACK, step), _square(north + SLACK, step))
    cut = edges.withColumn("gy", F.explode(rows))
    # the part of the edge in a row of squares
    y0, y1 = F.greatest(south, _line(F.col("gy"), step) - SLACK), F.least(north, _line(F.col("gy") + 1, step) + SLACK)
    flat = F.col("ay") == F.col("by")
    x0, x1 = F.when(flat, F.col("ax")).otherwise(_at(F.col, y0)), F.when(flat, F.col("bx")).otherwise(_at(F.col, y1))
    west, east = F.greatest(F.least(x0, x1), F.least("ax", "bx")), F.least(F.greatest(x0, x1), F.greatest("ax", "bx"))
    touched = cut.withColumn("gx", F.explode(F.sequence(_square(west - SLACK, step), _square(east + SLACK, step))))
    touched = touched.select("area", "gy", "gx", F.struct("ax", "ay", "bx", "by").alias("edge"), F.lit(0).alias("corner"))

    line = _line(F.col("gy"), step)
    crossed = cut.where((F.col("ay") > line) != (F.col("by") > line)).select("area", "gy", _at(F.col, line).alias("x"))
    runs = crossed.groupBy("area", "gy").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    # of an even number of crossings, an odd number lies east of what is between the first and the second, the third and the fourth, ...
    pairs = F.transform(F.sequence(F.lit(1), F.size("xs") - 1, F.lit(2)), lambda i: F.struct(F.element_at("xs", i).alias("a"), F.element_at("xs", i + 1).alias("b")))
    runs = runs.where(F.size("xs") > 1).select("area", "gy", F.explode(pairs).alias("p"))
    inner = runs.select("area", "gy", "p", F.explode(F.sequence(_square(F.col("p.a"), step), _square(F.col("p.b"), step) + 1)).alias("gx"))
    inner = inner.where((_line(F.col("gx"), step) >= F.col("p.a")) & (_line(F.col("gx"), step) < F.col("p.b")))
    inner = inner.select("area", "gy", "gx", F.lit(None).cast(touched.schema["edge"].dataType).alias("edge"), F.lit(1).alias("corner"))
    squares = touched.unionByName(inner).groupBy("area", "gy", "gx").agg((F.max("corner") == 1).alias("corner"), F.collect_list("edge").alias("edges"))
    covers = F.struct("corner", F.lit(None).cast(squares.schema["edges"].dataType).alias("edges"))
    found = squares.groupBy("gy", "gx").agg(
        F.max(F.when((F.size("edges") == 0) & F.col("corner"), covers)).alias("cover"),
        F.collect_list(F.when(F.size("edges") > 0, F.struct("corner", "edges"))).alias("areas"),
    )
    return found.select("gy", "gx", F.when(F.col("cover").isNotNull(), F.array("cover")).otherwise(F.col("areas")).alias("areas"))


def inside_areas(cells: DataFrame, edges: DataFrame, key: str = "cell_id", step: float = 0.5) -> DataFrame:
    """(key, inside): whether each of ``cells`` (key, lat, lon) lies in any area of ``edges`` (area, ax, ay, bx, by), in degrees."""
    squares = squares_of(edges, step).select(F.col("gy").alias("__gy"), F.col("gx").alias("__gx"), "areas")
    finite = ~F.isnan("lat") & ~F.isnan("lon") & (F.abs("lat") < 1e6) & (F.abs("lon") < 1e6)
    spots = cells.select(key, "lat", "lon", F.when(finite, _square(F.col("lat"), step)).alias("__y"), F.when(finite, _square(F.col("lon"), step)).alias("__x"))
    joined = spots.join(squares, (F.col("__y") == F.col("__gy")) & (F.col("__x") == F.col("__gx")), "left")
    x, y, corner_x, corner_y = F.col("lon"), F.col("lat"), _line(F.col("__x"), step), _line(F.col("__y"), step)

    def crossed(e: Column) -> Column:
        part = lambda name: e[name]
        at = _at(part, y)
        east = ((e["ay"] > y) != (e["by"] > y)) & (corner_x < at) & (at <= x)
        height = F.try_divide((e["by"] - e["ay"]) * (corner_x - e["ax"]), e["bx"] - e["ax"]) + e["ay"]
        north = ((e["ax"] > corner_x) != (e["bx"] > corner_x)) & (corner_y < height) & (height <= y)
        return east.cast("int") + north.cast("int")

    def holds(area: Column) -> Column:
        odd = F.aggregate(F.coalesce(area["edges"], F.expr(f"cast(array() AS array<struct<{EDGE.replace(' ', ':')}>>)".replace(",:", ","))), F.lit(0), lambda n, e: n + F.coalesce(crossed(e), F.lit(0))) % 2 == 1
        return area["corner"] != odd

    return joined.select(key, F.coalesce(F.exists("areas", holds), F.lit(False)).alias("inside"))

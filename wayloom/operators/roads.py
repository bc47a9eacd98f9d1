"""Roads as chains of edges, their summaries, text forms and shifts, and areas of vertices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .spatial import in_ring


def chains(edges: DataFrame) -> DataFrame:
    """(src, dst, road, step): each edge with its road and its place in it from 0 on.

    A road runs through vertices with one edge in and one out. The edge before is looked up by doubling: each round an
    edge knows the edge twice as far back, so rounds grow with the logarithm of the longest road. `road` is the first edge
    (src, dst); a ring without forks begins at its smallest edge and is emitted once."""
    graph.ensure_checkpoints(edges.sparkSession)
    e = graph.settled(edges.select("src", "dst").distinct())
    through = graph.degrees(e).filter("outs = 1 and ins = 1").select(F.col("id").alias("src"))
    here = F.struct(F.col("src").alias("s"), F.col("dst").alias("d"))
    before = e.select(F.col("dst").alias("src"), here.alias("up")).join(through, "src")
    state = e.select("src", "dst", here.alias("me")).join(before, "src", "left").select("me", "up", F.when(F.col("up").isNull(), F.col("me")).alias("top"), F.coalesce(F.least("me", "up"), F.col("me")).alias("low"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("steps")).checkpoint()
    before_n = -1
    while True:
        far = state.select(F.col("me").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("low").alias("low2"), F.col("steps").alias("steps2"))
        moved = state.filter("top is null").join(far, "up").select("me", F.when(F.col("top2").isNull(), F.col("up2")).alias("up"), F.col("top2").alias("top"), F.least("low", "low2").alias("low"), (F.col("steps") + F.col("steps2")).alias("steps"))
        state = state.filter("top is not null").unionByName(moved).checkpoint()
        n, seen = state.filter("top is null").agg(F.count("*"), F.min("steps")).first()
        if not n or (n == before_n and seen >= n):
            break  # a round that ends no line leaves rings only, and each edge has seen all of its ring
        before_n = n
    lines = state.filter("top is not null").select("me", F.col("top").alias("first"), F.col("steps").alias("step"))
    ring = state.filter("top is null").select("me", F.col("low").alias("first"))
    if not ring.isEmpty():
        lines = lines.unionByName(_ring_steps(e, ring))
    return lines.select(F.col("me.s").alias("src"), F.col("me.d").alias("dst"), F.col("first").alias("road"), F.col("step").cast("int").alias("step"))


def _ring_steps(edges: DataFrame, ring: DataFrame) -> DataFrame:
    """Places in rings: cut at the edge before the first one, they are lines."""
    cut = ring.filter(F.col("me") != F.col("first")).select("me", F.col("me.s").alias("src"), F.col("me.d").alias("dst"))
    firsts = ring.filter(F.col("me") == F.col("first"))
    inner = chains(cut.select("src", "dst"))
    inner = inner.select(F.struct(F.col("src").alias("s"), F.col("dst").alias("d")).alias("me"), (F.col("step") + 1).alias("step"))
    return ring.join(inner, "me").select("me", "first", "step").unionByName(firsts.select("me", "first", F.lit(0).alias("step")))


def summaries(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(source, target, length, weight, last_traversal, z_variance, wkt) of each road.

    edges: (src, dst, weight, last_traversal); vertices: (id, x, y, z, z_variance, weight). The weight is that of all edges
    with both ends on the road over its steps; the variance is the vertices' mean by weight."""
    e = graph.settled(edges.select("src", "dst", "weight", "last_traversal"))
    placed = chains(e).checkpoint()
    w = F.struct("step", "src", "dst")
    ends = placed.groupBy("road").agg(F.min_by("src", w).alias("source"), F.max_by("dst", w).alias("target"), F.count("*").alias("length"))
    nodes = placed.select("road", F.col("src").alias("id"), "step").unionByName(ends.select("road", F.col("target").alias("id"), F.col("length").cast("int").alias("step")))
    v = vertices.select("id", "x", "y", "z", "z_variance", F.col("weight").alias("points"))
    at = nodes.join(v, "id")
    shape = at.groupBy("road").agg(
        F.sort_array(F.collect_list(F.struct("step", "x", "y", "z"))).alias("line"),
        (F.sum(F.col("z_variance") * F.col("points")) / F.sum("points")).alias("z_variance"),
    )
    on = nodes.select("road", "id").distinct()
    own = e.join(on.select(F.col("road"), F.col("id").alias("src")), "src").join(on.select("road", F.col("id").alias("dst")), ["road", "dst"])
    sums = own.groupBy("road").agg(F.sum("weight").alias("sum"), F.floor(F.avg("last_traversal")).alias("last_traversal"))
    rows = ends.join(sums, "road").join(shape, "road")
    return rows.select("source", "target", "length", F.floor(F.col("sum") / F.col("length")).alias("weight"), "last_traversal", "z_variance", linestring("line").alias("wkt"))


def number(c: Column) -> Column:
    """A coordinate with three decimals."""
    return F.format_string("%.3f", c)


def linestring(line: str) -> Column:
    """3-D well-known text of an array of (x, y, z)."""
    return F.concat(F.lit("LINESTRING Z ("), F.array_join(F.transform(line, lambda p: F.concat_ws(" ", number(p["x"]), number(p["y"]), number(p["z"]))), ", "), F.lit(")"))


def polygon(ring: str) -> Column:
    """Well-known text of an array of corners, closed; z is written where corners have it."""
    corner = lambda p: F.concat_ws(" ", number(p["x"]), number(p["y"]), F.when(p["z"].isNotNull(), number(p["z"])))
    closed = F.concat(F.col(ring), F.slice(ring, 1, 1))
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(closed, corner), ", "), F.lit("))"))


def shifted(vertices: DataFrame, dx: float, dy: float, dz: float = 0.0) -> DataFrame:
    """Vertices in another coordinate system."""
    return vertices.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy, "z": F.col("z") + dz})


def shifted_areas(areas: DataFrame, dx: float, dy: float) -> DataFrame:
    """Areas (with `ring`) in another coordinate system; as a shift moves the plane only, corners lose their z."""
    return areas.withColumn("ring", F.transform("ring", lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y"), F.lit(None).cast("double").alias("z"))))


def area_heights(areas: DataFrame, members: DataFrame, vertices: DataFrame) -> DataFrame:
    """(area, ring): corners with the mean z of the vertices that the area owns and its ring contains; areas without any are dropped."""
    inside = areas.join(members, "area").join(vertices.select("id", "x", "y", "z"), "id").filter(in_ring(F.col("x"), F.col("y"), F.col("ring")))
    height = inside.groupBy("area").agg(F.avg("z").alias("h"))
    return areas.join(height, "area").withColumn("ring", F.transform("ring", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.col("h").alias("z")))).drop("h")

"""Equipment: latest state, nearness and points of interest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..settings import Settings
from . import graph
from .spatial import cell, radius_join

#: Types of tags and points of interest (fixed values).
UNKNOWN, LOAD_LOCATION, DUMP_LOCATION = 0, 1, 2
DIGGER, TRUCK_DIG, TRUCK_DUMP, DUMP = 1, 2, 3, 4


def tag_type(tag):
    """1 for LOAD*, 2 for DUMP*, else 0."""
    return F.when(tag.startswith("LOAD"), LOAD_LOCATION).when(tag.startswith("DUMP"), DUMP_LOCATION).otherwise(UNKNOWN)


def latest(rows: DataFrame, key: str, values: list[str], ts: str = "ts", seq: str = "seq") -> DataFrame:
    """The last row of each key; of equal times the one that came last wins."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*values, F.col(ts).alias("ts")), F.struct(ts, seq)).alias("v")).select(key, "v.*")


def latest_first(rows: DataFrame, key: str, values: list[str], ts: str = "ts", seq: str = "seq") -> DataFrame:
    """The last row of each key; of equal times the one that came first stays."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*values, F.col(ts).alias("ts")), F.struct(ts, -F.col(seq))).alias("v")).select(key, "v.*")


def proximity_tags(points: DataFrame, diggers: DataFrame, dumps: DataFrame, locations: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(point_id, tag, type): points near a dump get its name, else points near a digger its location; the last name wins."""
    d = diggers.join(locations.select("name", "location"), "name").select("name", F.col("location").alias("tag"), "x", "y", F.lit(0).alias("rank"), F.lit(LOAD_LOCATION).alias("type"))
    e = dumps.select("name", F.col("name").alias("tag"), "x", "y", F.lit(1).alias("rank"), F.lit(DUMP_LOCATION).alias("type"))
    return _foremost(points.select("point_id", "x", "y"), d.unionByName(e), settings.proximity_radius)


def _foremost(points: DataFrame, sites: DataFrame, radius: float) -> DataFrame:
    """(point_id, tag, type) of each point's last site, by rank and name, that is nearer than the radius. Points meet the sites of their cell."""
    size = radius / 8
    at = points.filter("x is not null and y is not null").withColumn("cx", cell(F.col("x"), size)).withColumn("cy", cell(F.col("y"), size))
    some = cell_sites(at.select("cx", "cy").distinct(), sites, radius, size)
    dx, dy = F.col("sx") - F.col("x"), F.col("sy") - F.col("y")
    near = at.join(some, ["cx", "cy"]).filter(F.sqrt(dx * dx + dy * dy) < radius)
    best = near.groupBy("point_id").agg(F.max_by(F.struct("tag", "type"), "order").alias("v"))
    return best.select("point_id", "v.tag", "v.type")


def cell_sites(cells: DataFrame, sites: DataFrame, radius: float, size: float) -> DataFrame:
    """(cx, cy, order, tag, type, sx, sy): the sites that can be the last near one of a place in each cell.

    Sites before the last one that is near to all of the cell are nobody's. What is left is that one and the later ones whose
    circle cuts the cell, few however much equipment stands there."""
    span = lambda c: F.sequence(cell(F.col(c) - radius, size) - 1, cell(F.col(c) + radius, size) + 1)
    own = sites.filter("x is not null and y is not null").withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    low = lambda c: F.col(f"c{c}") * F.lit(size) - F.col(c)
    least = lambda c: F.greatest(low(c), -low(c) - F.lit(size), F.lit(0.0))
    most = lambda c: F.greatest(F.abs(low(c)), F.abs(low(c) + F.lit(size)))
    far = lambda f: F.sqrt(f("x") * f("x") + f("y") * f("y"))
    slack = 1e-6 * radius
    own = own.filter(far(least) < radius + slack).withColumn("whole", far(most) < radius - slack)
    own = own.join(cells, ["cx", "cy"], "left_semi").withColumn("order", F.struct("rank", "name"))
    own = graph.settled(own.select("cx", "cy", "whole", "order", "tag", "type", F.col("x").alias("sx"), F.col("y").alias("sy")))
    last = own.filter("whole").groupBy("cx", "cy").agg(F.max("order").alias("last"))
    return own.join(last, ["cx", "cy"], "left").filter(F.col("last").isNull() | (F.col("order") >= F.col("last"))).drop("last", "whole")


def points_of_interest(diggers: DataFrame, dumps: DataFrame, locations: DataFrame, tags: DataFrame) -> DataFrame:
    """(type, name, x, y, z, last_seen, equipment): for each location the newest digger or dump, and each load or dump tag.

    A digger counts with its location's time. Of equal times a digger stays before a dump, and the smaller name."""
    d = diggers.join(locations.select("name", "location", F.col("ts").alias("seen")), "name").select(F.lit(DIGGER).alias("type"), F.col("location").alias("place"), "x", "y", "z", F.col("seen").alias("last_seen"), F.col("name").alias("equipment"))
    e = dumps.select(F.lit(DUMP).alias("type"), F.col("name").alias("place"), "x", "y", "z", F.col("ts").alias("last_seen"), F.lit(None).cast("string").alias("equipment"))
    w = Window.partitionBy("place").orderBy(F.desc("last_seen"), "type", "equipment")
    first = d.unionByName(e).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n").withColumnRenamed("place", "name")
    kind = tag_type(F.col("tag"))
    t = tags.withColumn("k", kind).filter(F.col("k") != UNKNOWN)
    t = t.select(F.when(F.col("k") == DUMP_LOCATION, TRUCK_DUMP).otherwise(TRUCK_DIG).alias("type"), F.col("tag").alias("name"), "x", "y", "z", F.col("ts").alias("last_seen"), F.lit(None).cast("string").alias("equipment"))
    return first.select(t.columns).unionByName(t)


def metadata(points: DataFrame, ts: str = "timestamp") -> DataFrame:
    """(latest, oldest, points) of a point table."""
    return points.agg(F.max(ts).alias("latest"), F.min(ts).alias("oldest"), F.count("*").alias("points"))


def in_circles(points: DataFrame, circles: DataFrame, radius: float, before: str = "before", ts: str = "timestamp") -> DataFrame:
    """(point_id): the points within radius of a circle's centre and no later than its `before`."""
    near = radius_join(points.select("point_id", "x", "y", F.col(ts).alias("t")), circles.select("x", "y", F.col(before).alias("before")), radius)
    return near.filter("l_t <= r_before").select(F.col("l_point_id").alias("point_id")).distinct()

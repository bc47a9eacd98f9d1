"""Spatial joins as equi-joins on grid cells with an exact residual test: no pair of far cells is formed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import bearing, center_angle, distance, point


def cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(float(size))).cast("bigint")


def around(x: Column, y: Column, size: float) -> Column:
    """The cell of a place and its eight neighbours."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    return F.transform(steps, lambda s: F.struct((cell(x, size) + s["i"]).alias("cx"), (cell(y, size) + s["j"]).alias("cy")))


def radius_join(left: DataFrame, right: DataFrame, radius: float, lx: str = "x", ly: str = "y", rx: str = "x", ry: str = "y", strict: bool = False, prefixes: tuple[str, str] = ("l_", "r_")) -> DataFrame:
    """Pairs of rows within a plane distance; columns get the two prefixes, and dist."""
    a = left.select(*(F.col(c).alias(f"{prefixes[0]}{c}") for c in left.columns))
    b = right.select(*(F.col(c).alias(f"{prefixes[1]}{c}") for c in right.columns))
    ax, ay, bx, by = f"{prefixes[0]}{lx}", f"{prefixes[0]}{ly}", f"{prefixes[1]}{rx}", f"{prefixes[1]}{ry}"
    a = a.withColumn("cx", cell(F.col(ax), radius)).withColumn("cy", cell(F.col(ay), radius))
    b = b.withColumn("c", F.explode(around(F.col(bx), F.col(by), radius))).withColumn("cx", F.col("c.cx")).withColumn("cy", F.col("c.cy")).drop("c")
    dx, dy = F.col(bx) - F.col(ax), F.col(by) - F.col(ay)
    joined = a.join(b, ["cx", "cy"]).withColumn("dist", F.sqrt(dx * dx + dy * dy)).drop("cx", "cy")
    return joined.filter(F.col("dist") < radius if strict else F.col("dist") <= radius)


def nearest_within(points: DataFrame, sites: DataFrame, radius: float, point_id: str = "point_id", site_id: str = "id", angular_weight: float = 1.0) -> DataFrame:
    """(point_id, site_id, dist): the nearest site by place and heading, if within radius; of equally near ones the smallest id."""
    p = points.select(F.col(point_id).alias(point_id), "x", "y", "orientation")
    s = sites.select(F.col(site_id).alias(site_id), "x", "y", "orientation")
    near = radius_join(p, s, radius).withColumn("d", distance(point("l_"), point("r_"), angular_weight)).filter(F.col("d") <= radius)
    best = near.groupBy(f"l_{point_id}").agg(F.min(F.struct("d", F.col(f"r_{site_id}").alias("id"))).alias("m"))
    return best.select(F.col(f"l_{point_id}").alias(point_id), F.col("m.id").alias(site_id), F.col("m.d").alias("dist"))


def nearest_any(places: DataFrame, sites: DataFrame, place_id: str, site_id: str = "id", first_radius: float = 60.0, doublings: int = 24) -> DataFrame:
    """(place_id, site_id, dist): the nearest site in the plane, however far: rings of doubled radius, each for the places without an answer."""
    p, s = places.select(place_id, "x", "y"), sites.select(site_id, "x", "y")
    if s.isEmpty() or p.isEmpty():
        return p.join(s.limit(0).select(F.col(site_id)), F.lit(False)).select(place_id, site_id, F.lit(0.0).alias("dist"))
    found, radius = None, first_radius
    left = p.filter("x is not null and y is not null")
    for _ in range(doublings):
        near = radius_join(left, s, radius)
        best = near.groupBy(f"l_{place_id}").agg(F.min(F.struct("dist", F.col(f"r_{site_id}").alias("id"))).alias("m"))
        here = best.select(F.col(f"l_{place_id}").alias(place_id), F.col("m.id").alias(site_id), F.col("m.dist").alias("dist"))
        found = here if found is None else found.unionByName(here)
        left = left.join(here.select(place_id), place_id, "left_anti")
        if left.isEmpty():
            break
        radius *= 2
    return found


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a place lies inside a polygon, by ray casting over the array of (x, y) corners."""
    n = F.size(ring)
    corner = lambda i: F.get(ring, i)

    def crosses(i: Column) -> Column:
        a, b = corner(i), corner((i + 1) % n)
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    hits = F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses))
    return hits % 2 == 1


def deduped(points: DataFrame, epsilon: float = 1e-4, order: str = "point_id", rank: str | None = None, equal: tuple[str, ...] = (), numbers: tuple[str, ...] = ("x", "y", "z", "speed", "orientation")) -> DataFrame:
    """(point_id, stored_id): points whose second is equal and whose numbers, x and y among them, differ by at most epsilon are one; the first by order is stored.

    Cells are 1 m wide, so a point meets all within epsilon in its own or a neighbouring cell. rank, if any, comes before order; the columns of
    `equal` are equal too."""
    place = F.struct(F.col(rank) if rank else F.lit(0), F.col(order))
    p = points.select(F.col(order).alias("id"), place.alias("place"), F.col("ts").cast("bigint").alias("ts"), *numbers, *(F.col(c).alias(f"same_{c}") for c in equal))
    a = p.withColumn("cx", cell(F.col("x"), 1.0)).withColumn("cy", cell(F.col("y"), 1.0))
    b = p.select(*(F.col(c).alias(f"o_{c}") for c in p.columns)).withColumn("c", F.explode(around(F.col("o_x"), F.col("o_y"), 1.0)))
    near = a.join(b, (F.col("ts") == F.col("o_ts")) & (F.col("cx") == F.col("c.cx")) & (F.col("cy") == F.col("c.cy")) & (F.col("o_place") <= F.col("place")))
    for c in numbers:
        near = near.filter(F.abs(F.col(c) - F.col(f"o_{c}")) <= epsilon)
    for c in equal:
        near = near.filter(F.col(f"same_{c}").eqNullSafe(F.col(f"o_same_{c}")))
    return near.groupBy(F.col("id").alias(order)).agg(F.min_by("o_id", "o_place").alias("stored_id"))


def opposite_lane(vertices: DataFrame, radius: float = 60.0, angle: float = 45.0, side: str = "left", vid: str = "id") -> DataFrame:
    """(id, partner, dist): vertices near each other whose headings are opposite, the partner on the far side of the road."""
    v = vertices.select(F.col(vid).alias("id"), "x", "y", "orientation")
    near = radius_join(v, v, radius).filter("l_id != r_id")
    turned = F.abs(center_angle(F.col("r_orientation") - F.col("l_orientation") + F.lit(180.0)))
    relative = center_angle(bearing(point("l_"), point("r_")) - F.col("l_orientation"))
    keep = relative <= 0 if side == "left" else relative >= 0
    return near.filter((turned <= angle) & keep).select(F.col("l_id").alias("id"), F.col("r_id").alias("partner"), "dist")


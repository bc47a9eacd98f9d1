"""Connections between clusters: demand, statistics, weights and the waypoints in between."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import center_angle
from ..settings import Settings
from .spatial import cell


def linked(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """Each pair with its clusters, flipped where the vehicle reversed: (src, dst, rev, src_ts, dst_ts, tag, a_point_id, b_point_id).

    Pairs inside one cluster and pairs with an unassigned point are left out."""
    ids = assigned.select("point_id", "id")
    a, b = ids.select(F.col("point_id").alias("a_point_id"), F.col("id").alias("a_id")), ids.select(F.col("point_id").alias("b_point_id"), F.col("id").alias("b_id"))
    rows = edges.join(a, "a_point_id").join(b, "b_point_id").filter("a_id != b_id")
    turn = lambda x, y: F.when(F.col("rev"), F.col(y)).otherwise(F.col(x))
    return rows.select(turn("a_id", "b_id").alias("src"), turn("b_id", "a_id").alias("dst"), "rev", turn("a_ts", "b_ts").alias("src_ts"), turn("b_ts", "a_ts").alias("dst_ts"), "a_tag", "a_point_id", "b_point_id")


def desired(links: DataFrame) -> DataFrame:
    """(src, dst, fwd, rev): how many pairs ask for a connection, driving forwards and backwards."""
    return links.groupBy("src", "dst").agg(F.count_if(~F.col("rev")).alias("fwd"), F.count_if("rev").alias("rev"))


def tag_counts(links: DataFrame, tag: str = "a_tag") -> DataFrame:
    """(src, dst, tag, votes): untagged pairs count as a tag of their own, null."""
    return links.groupBy("src", "dst", F.col(tag).alias("tag")).agg(F.count("*").alias("votes"))


def direct_links(links: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """The pairs of each direct edge: of every edge on the path of their connection, or of the connection itself.

    paths: (src, dst, path) with path an array of clusters from src to dst."""
    if paths is None:
        return links
    steps = paths.select("src", "dst", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("s"), F.get("path", i + 1).alias("d"))))).alias("e"))
    return links.join(steps, ["src", "dst"]).drop("src", "dst").select(F.col("e.s").alias("src"), F.col("e.d").alias("dst"), *(c for c in links.columns if c not in ("src", "dst")))


def statistics(links: DataFrame) -> DataFrame:
    """(src, dst, weight, first_src, last_dst, last_traversal) of each direct edge."""
    rows = links.groupBy("src", "dst").agg(F.count("*").alias("weight"), F.min("src_ts").alias("first_src"), F.max("dst_ts").alias("last_dst"), F.max("src_ts").alias("last_src"))
    return rows.select("src", "dst", "weight", "first_src", "last_dst", F.greatest("last_src", "last_dst").alias("last_traversal"))


def path_weights(paths: DataFrame, weights: DataFrame) -> DataFrame:
    """(src, dst, bottleneck): the least summed weight over the direct edges of each connection's path. weights: (src, dst, weight) of connections."""
    steps = paths.select("src", "dst", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("s"), F.get("path", i + 1).alias("d"))))).alias("e"))
    summed = steps.join(weights, ["src", "dst"]).groupBy("e").agg(F.sum("weight").alias("w"))
    return steps.join(summed, "e").groupBy("src", "dst").agg(F.min("w").alias("bottleneck"))


def circle_candidates(connections: DataFrame, clusters: DataFrame, size: float = 60.0) -> DataFrame:
    """(src, dst, id): the clusters in the circle that has each connection as its diameter, besides its ends.

    Circles are cut into the grid cells that their boxes touch, and meet clusters by cell."""
    c = clusters.select("id", "x", "y")
    s, d = c.select(F.col("id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy")), c.select(F.col("id").alias("dst"), F.col("x").alias("dx"), F.col("y").alias("dy"))
    rows = connections.select("src", "dst").distinct().join(s, "src").join(d, "dst")
    mx, my = (F.col("sx") + F.col("dx")) / 2, (F.col("sy") + F.col("dy")) / 2
    ex, ey = F.col("dx") - F.col("sx"), F.col("dy") - F.col("sy")
    rows = rows.withColumn("mx", mx).withColumn("my", my).withColumn("r", F.sqrt(ex * ex + ey * ey) / 2)
    rows = rows.withColumn("cx", F.explode(F.sequence(cell(F.col("mx") - F.col("r"), size), cell(F.col("mx") + F.col("r"), size))))
    rows = rows.withColumn("cy", F.explode(F.sequence(cell(F.col("my") - F.col("r"), size), cell(F.col("my") + F.col("r"), size))))
    near = rows.join(c.withColumn("cx", cell(F.col("x"), size)).withColumn("cy", cell(F.col("y"), size)), ["cx", "cy"])
    ux, uy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    return near.filter((F.sqrt(ux * ux + uy * uy) <= F.col("r")) & (F.col("id") != F.col("src")) & (F.col("id") != F.col("dst"))).select("src", "dst", "id")


def valid_intermediates(candidates: DataFrame, clusters: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The candidates that can lie between: a chord of some length whose turn against their heading fits those of the ends."""
    c = clusters.select("id", "x", "y", "orientation")
    as_ = lambda p, k: c.select(F.col("id").alias(k), *(F.col(n).alias(f"{p}{n}") for n in ("x", "y", "orientation")))
    rows = candidates.join(as_("s_", "src"), "src").join(as_("d_", "dst"), "dst").join(as_("m_", "id"), "id")
    dx, dy = F.col("d_x") - F.col("s_x"), F.col("d_y") - F.col("s_y")
    chord = F.degrees(F.atan2(dy, dx))
    turn = lambda p: center_angle(F.col(f"{p}orientation") - chord)
    t = settings.angular_threshold
    low = F.least(F.lit(-t), turn("s_") - t, turn("d_") - t)
    high = F.greatest(F.lit(t), turn("s_") + t, turn("d_") + t)
    return rows.filter((F.sqrt(dx * dx + dy * dy) >= 1e-5) & (turn("m_") >= low) & (turn("m_") <= high)).select("src", "dst", "id")

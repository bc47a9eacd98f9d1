"""Consecutive positions of vehicles and which of them are road."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import distance2d, point, reversing
from ..settings import Settings

POINT = ("point_id", "x", "y", "z", "orientation", "speed", "ts", "tag")


def consecutive(points: DataFrame, vehicle: str = "vehicle", order: str = "seq", ts: str = "dense_ts") -> DataFrame:
    """Each point with the next one of its vehicle in arrival order: columns a_* and b_*. The last point of a vehicle gives no pair."""
    w = Window.partitionBy(vehicle).orderBy(order)
    own = points.withColumn("ts", F.col(ts)).withColumn("a", F.struct(*POINT)).withColumn("b", F.lead("a").over(w))
    rows = own.filter("b is not null").select(vehicle, F.col(order).alias("seq"), "a", "b")
    return rows.select(vehicle, "seq", *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in POINT))


def measured(pairs: DataFrame) -> DataFrame:
    """Adds dt, dist and rev."""
    a, b = point("a_"), point("b_")
    return pairs.withColumn("dt", F.col("b_ts") - F.col("a_ts")).withColumn("dist", distance2d(a, b)).withColumn("rev", reversing(a, b))


def verdict(settings: Settings = Settings()):
    """Why a measured pair makes no edge; null if it does. Both points of a dropped pair are kept."""
    same = (F.col("dt") == 0) & (F.col("a_x") == F.col("b_x")) & (F.col("a_y") == F.col("b_y")) & (F.col("a_z") == F.col("b_z")) & (F.col("a_orientation") == F.col("b_orientation"))
    gap = (F.col("dt") > settings.max_allowed_pair_time_threshold) & (F.col("dist") > settings.max_allowed_pair_distance_threshold)
    fast = (F.col("dt") > 0) & (F.col("dist") / F.col("dt") > F.lit(settings.max_allowed_pair_speed))
    return F.when(same, "identical").when(gap, "gap").when(fast, "speed")


def edges(points: DataFrame, settings: Settings = Settings(), ts: str = "dense_ts") -> DataFrame:
    """The pairs that are road."""
    return measured(consecutive(points, ts=ts)).filter(verdict(settings).isNull())


def violations(links: DataFrame, source: str = "a_point_id", target: str = "b_point_id") -> DataFrame:
    """(point_id, side, n): points with more than one next or previous point; none in a sound table."""
    out = links.groupBy(F.col(source).alias("point_id")).agg(F.countDistinct(target).alias("n")).withColumn("side", F.lit("next"))
    back = links.groupBy(F.col(target).alias("point_id")).agg(F.countDistinct(source).alias("n")).withColumn("side", F.lit("previous"))
    return out.unionByName(back).filter("n > 1").select("point_id", "side", "n")

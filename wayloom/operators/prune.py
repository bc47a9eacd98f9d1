"""Expiry of points: old runs inside clusters go unless the roads they lie on are seldom driven and not too old."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..settings import Settings


def runs(assigned: DataFrame) -> DataFrame:
    """Points with `run`, the number of the unbroken stay in one cluster, and `last`, the time of its newest point."""
    w = Window.partitionBy("vehicle").orderBy("seq")
    new = F.when(F.lag("id").over(w).eqNullSafe(F.col("id")), 0).otherwise(1)
    rows = assigned.withColumn("new", new).withColumn("run", F.sum("new").over(w)).drop("new")
    return rows.withColumn("last", F.max("timestamp").over(Window.partitionBy("vehicle", "run")))


def flagged(assigned: DataFrame, weights: DataFrame, now: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(point_id, vehicle, seq, run, flag): whether a point's run may go. weights: (src, dst, weight) of connections, either
    direction counts; now: one row with `latest`, the newest time of all points.

    A run stays while it is young, or while a road next to it has too few observations for its age."""
    rows = runs(assigned)
    stays = rows.groupBy("vehicle", "run").agg(F.first("id").alias("id"), F.max("last").alias("last"))
    w = Window.partitionBy("vehicle").orderBy("run")
    stays = stays.withColumn("before", F.lag("id").over(w)).withColumn("after", F.lead("id").over(w))
    both = weights.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), "weight").groupBy("lo", "hi").agg(F.sum("weight").alias("weight"))
    for side in ("before", "after"):
        named = both.withColumnRenamed("weight", f"w_{side}")
        stays = stays.withColumn("lo", F.least("id", side)).withColumn("hi", F.greatest("id", side)).join(named, ["lo", "hi"], "left").drop("lo", "hi")
    latest = now.select("latest")
    stays = stays.join(F.broadcast(latest))  # one row
    age = F.col("latest") - F.col("last")

    def holds(side: str):
        weight = F.coalesce(F.col(f"w_{side}"), F.lit(0))
        limit = settings.minimum_prune_age + settings.assume_truck_every_when_pruning * weight
        return F.col(side).isNotNull() & (weight < settings.maximum_connection_count) & (age < settings.maximum_prune_age) & (age < limit)

    keep = (age <= settings.minimum_prune_age) | holds("before") | holds("after")
    return rows.join(stays.select("vehicle", "run", (~keep).alias("flag")), ["vehicle", "run"]).select("point_id", "vehicle", "seq", "run", "flag")


def candidates(assigned: DataFrame, weights: DataFrame, now: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(point_id): flagged points none of whose neighbours within the protected number of cluster changes is unflagged."""
    f = flagged(assigned, weights, now, settings)
    hops = settings.protected_hop_count_when_pruning
    stays = f.groupBy("vehicle", "run").agg(F.min("flag").alias("all"))
    near = Window.partitionBy("vehicle").orderBy("run").rangeBetween(-(hops - 1), hops - 1)
    ok = stays.withColumn("ok", F.min("all").over(near)).filter("ok").select("vehicle", "run")
    return f.join(ok, ["vehicle", "run"], "left_semi").select("point_id")

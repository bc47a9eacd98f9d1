"""Graph steps as iterative DataFrame jobs."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Edges up to which components are found in one task (16 MB of numbers); larger graphs go round by round.
SMALL_GRAPH = 1 << 20


def ensure_checkpoints(spark: SparkSession) -> None:
    """A checkpoint folder: the cluster's. Without one a local folder serves where driver and executors are one process; else it is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        where = context.getConf().get("spark.checkpoint.dir")
        if not where and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="wayloom-checkpoint-"))


def settled(df: DataFrame) -> DataFrame:
    """df computed once, for steps that read it several times; kept in the shared checkpoint folder, so lost executors cost nothing."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def least_labels(s: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that each of n numbers is joined to by the edges (s, t)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[s], label[t])
        new = label.copy()
        for at in (s, t, label[s], label[t]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _small_components(one: DataFrame) -> DataFrame:
    """components of edges (s, t) that one task holds."""
    kind = one.schema["s"].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if held:
            e = pd.concat(held)
            codes, names = pd.factorize(pd.concat([e["s"], e["t"]]), sort=True)
            yield pd.DataFrame({"node": names, "label": names[least_labels(codes[: len(e)], codes[len(e) :], len(names))]})

    return one.coalesce(1).mapInPandas(run, StructType([StructField("node", kind), StructField("label", kind)])).checkpoint()


def components(edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL_GRAPH) -> DataFrame:
    """(node, label): the smallest node that each node of an edge table is joined to, directions ignored.

    Graphs of at most `small` edges are one task. In larger ones each round every group of nodes with one label takes the least label next to any of them, and then that label's own
    choice, so the rounds grow with the logarithm of the input. A node sends one number to each neighbour; no component is gathered."""
    ensure_checkpoints(edges.sparkSession)
    one = edges.select(F.col(a).alias("s"), F.col(b).alias("t")).filter("s is not null and t is not null")
    one = one.distinct().checkpoint()
    if one.schema["s"].dataType == one.schema["t"].dataType and isinstance(one.schema["s"].dataType, LongType | StringType) and one.limit(small + 1).count() <= small:
        return _small_components(one)
    both = one.unionByName(one.select(F.col("t").alias("s"), F.col("s").alias("t"))).distinct().checkpoint()
    label = both.groupBy(F.col("s").alias("node")).agg(F.least(F.col("node"), F.min("t")).alias("label")).checkpoint()
    while True:
        near = both.join(label, both["t"] == label["node"]).groupBy("s").agg(F.min("label").alias("near"))
        low = label.join(near, label["node"] == near["s"]).select("label", F.least("label", "near").alias("low"))
        hook = low.groupBy("label").agg(F.min("low").alias("top"))
        up = hook.select(F.col("label").alias("top"), F.col("top").alias("upper"))
        hook = hook.join(up, "top").select(F.col("label").alias("old"), F.col("upper").alias("new"))
        moved = label.join(hook, label["label"] == hook["old"]).select("node", F.col("new").alias("label"), "old").checkpoint()
        changed = moved.filter("label != old").limit(1).count()
        label = moved.select("node", "label")
        if not changed:
            return label


def sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("size"))


def degrees(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(id, outs, ins) of every vertex of distinct edges."""
    out = edges.groupBy(F.col(a).alias("id")).agg(F.count("*").alias("outs"), F.lit(0).cast("bigint").alias("ins"))
    back = edges.groupBy(F.col(b).alias("id")).agg(F.lit(0).cast("bigint").alias("outs"), F.count("*").alias("ins"))
    return out.unionByName(back).groupBy("id").agg(F.sum("outs").alias("outs"), F.sum("ins").alias("ins"))

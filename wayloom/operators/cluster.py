"""Clusters of positions and headings: road vertices."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import circular_mean, distance, point
from ..settings import Settings
from . import graph
from .spatial import cell, nearest_within, radius_join

#: Room for cell numbers on either side of zero in a cluster id, and sectors of heading.
OFFSET, WIDTH, SECTORS = 1 << 20, 1 << 21, 16


def grid_id(settings: Settings = Settings()) -> Column:
    """The cluster of a point in grid mode: its cell of cluster_radius and its sector of angular_threshold."""
    r = settings.cluster_radius
    sector = F.floor((F.col("orientation") + F.lit(180.0)) / F.lit(settings.angular_threshold)).cast("bigint")
    return ((cell(F.col("x"), r) + OFFSET) * WIDTH + (cell(F.col("y"), r) + OFFSET)) * SECTORS + sector


def grid_clusters(points: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """points with `id`, their cluster."""
    return points.withColumn("id", grid_id(settings))


def cluster_stats(assigned: DataFrame) -> DataFrame:
    """(id, x, y, z, orientation, z_variance, weight) of each cluster: means, circular mean heading, population variance, points."""
    return assigned.groupBy("id").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), circular_mean("orientation").alias("orientation"),
        F.var_pop("z").alias("z_variance"), F.count("*").alias("weight"),
    )


def close_pairs(clusters: DataFrame, radius: float, angular_weight: float = 1.0) -> DataFrame:
    """(a, b, dist): pairs of clusters within radius by place and heading, a < b."""
    own = clusters.select("id", "x", "y", "orientation")
    near = radius_join(own, own, radius).filter("l_id < r_id").withColumn("d", distance(point("l_"), point("r_"), angular_weight))
    return near.filter(F.col("d") <= radius).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), F.col("d").alias("dist"))


def merge_pairs(clusters: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(keep, gone): disjoint pairs to merge. Each cluster may merge with its nearest neighbour only; in order of id the first to ask wins.

    Nearest neighbours form chains; those are decided per connected group in one task, a group being what the merge radius joins."""
    pairs = close_pairs(clusters, settings.cluster_merge_radius, settings.angular_weight)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist"))
    nearest = both.groupBy("a").agg(F.min(F.struct("dist", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    label = graph.components(nearest)
    rows = nearest.join(label, nearest["a"] == label["node"]).select("label", "a", "b")

    def greedy(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        used: set[int] = set()
        out = []
        for a, b in g.sort_values("a")[["a", "b"]].itertuples(index=False):
            if a not in used and b not in used:
                used |= {a, b}
                out.append((min(a, b), max(a, b)))
        return pd.DataFrame(out, columns=["keep", "gone"], dtype="int64")

    return rows.groupBy("label").applyInPandas(greedy, "keep bigint, gone bigint")


def moved_neighbours(before: DataFrame, after: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(moved, near): clusters whose position moved beyond the threshold, and all clusters within twice the radius of them."""
    b, a = before.select("id", *(F.col(c).alias(f"b_{c}") for c in ("x", "y", "orientation"))), after.select("id", *(F.col(c).alias(f"a_{c}") for c in ("x", "y", "orientation")))
    moved = a.join(b, "id").filter(distance(point("b_"), point("a_"), settings.angular_weight) > settings.cluster_move_threshold)
    m = moved.select("id", F.col("a_x").alias("x"), F.col("a_y").alias("y"), F.col("a_orientation").alias("orientation"))
    near = radius_join(m, after.select("id", "x", "y", "orientation"), 2 * settings.cluster_radius)
    near = near.filter(distance(point("l_"), point("r_"), settings.angular_weight) <= 2 * settings.cluster_radius)
    return near.select(F.col("l_id").alias("moved"), F.col("r_id").alias("near"))


def merged(assigned: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """assigned after rounds of merging close clusters and dealing points anew; those of the last preparations and of the map itself, or until nothing changes.

    Dealt anew are the points of merged clusters, and of moved ones and all near them: to the nearest cluster, else to the
    nearest after those moves. What is still without one founds clusters in order of time, named by a hash of founder and round."""
    pose = ("id", "x", "y", "orientation")
    known = graph.settled(cluster_stats(assigned).select(*pose))
    for k in range(settings.final_prepare_rounds + 1):
        pairs = graph.settled(merge_pairs(cluster_stats(assigned), settings))
        if not pairs.isEmpty():
            joined = assigned.join(pairs.withColumnRenamed("gone", "id"), "id", "left")
            assigned = graph.settled(joined.withColumn("id", F.coalesce("keep", "id")).select(*assigned.columns))
        sites = graph.settled(cluster_stats(assigned).select(*pose))
        moved = graph.settled(moved_neighbours(known, sites, settings))
        if pairs.isEmpty() and moved.isEmpty():
            break
        known = graph.settled(sites.join(moved.select(F.col("moved").alias("id")), "id", "left_semi").unionByName(known.join(moved.select(F.col("moved").alias("id")), "id", "left_anti").join(sites.select("id"), "id", "left_semi")))
        again = pairs.select(F.col("keep").alias("id")).unionByName(moved.select(F.col("near").alias("id"))).distinct()
        queue = graph.settled(assigned.join(again, "id", "left_semi"))

        def dealt(rows: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
            """(point_id, to) of the rows with a cluster in reach, and the other rows."""
            to = graph.settled(nearest_within(rows, sites, settings.cluster_radius, angular_weight=settings.angular_weight).select("point_id", F.col("id").alias("to")))
            return to, graph.settled(rows.join(to, "point_id", "left_anti"))

        def placed(to: DataFrame, assigned: DataFrame) -> DataFrame:
            return graph.settled(assigned.join(to, "point_id", "left").withColumn("id", F.coalesce("to", "id")).select(*assigned.columns))

        to, left = dealt(queue, sites)
        assigned = placed(to, assigned)
        if not left.isEmpty():
            to, left = dealt(left, cluster_stats(assigned))
            founded = leader_clusters(left, settings).select("point_id", F.xxhash64("id", F.lit(k)).alias("to"))
            assigned = placed(to.unionByName(founded), assigned)
        new = cluster_stats(assigned).select(*pose).join(known.select("id"), "id", "left_anti")
        known = graph.settled(known.unionByName(new))
    return assigned


def _wrap(a: np.ndarray) -> np.ndarray:
    return (a + 180) % 360 - 180


def lead(xs: np.ndarray, ys: np.ndarray, hs: np.ndarray, settings: Settings) -> np.ndarray:
    """Leader clustering of points in the given order: for each the index of its cluster's founder.

    A point joins the best leader within the radius, whose position is the mean of its points then, or founds a cluster.
    Afterwards points are dealt to the nearest mean anew, until none moves or the rounds are over. Leaders are kept by cell of
    place and heading, with a list for each cell of those in it and next to it, as most points move no leader to another cell."""
    w, r = settings.angular_weight, settings.cluster_radius
    n = len(xs)
    sectors = max(1, int(360 * w / r - 1e-9))  # none narrower than the radius
    width, wide = 360 / sectors, 1 << 26
    owner = np.full(n, -1)
    mx, my, mh, points, place, founder = [], [], [], [], [], []
    near: dict[int, list[int]] = {}  # leaders by the cells around that of their mean: those within the radius are among them

    def keys(x: np.ndarray, y: np.ndarray, h: np.ndarray) -> np.ndarray:
        return (np.floor_divide(x, r).astype(np.int64) * wide + np.floor_divide(y, r).astype(np.int64)) * sectors + np.floor_divide(h + 180, width).astype(np.int64) % sectors

    def around(c: int) -> list[int]:
        at, s = divmod(c, sectors)
        turns = {(s + k) % sectors for k in (-1, 0, 1)}
        return [(at + i * wide + j) * sectors + t for i in (-1, 0, 1) for j in (-1, 0, 1) for t in turns]

    for begin in range(0, n, 1 << 17):
        part = slice(begin, begin + (1 << 17))
        px, py, ph = xs[part], ys[part], hs[part]
        own = []
        for x, y, h, c in zip(px.tolist(), py.tolist(), ph.tolist(), keys(px, py, ph).tolist(), strict=True):
            best, least = -1, r
            for k in near.get(c, ()):
                dx, dy = mx[k] - x, my[k] - y
                if -r <= dx <= r and -r <= dy <= r:
                    dh = w * ((mh[k] - h + 180) % 360 - 180)
                    d = math.sqrt(dx * dx + dy * dy + dh * dh)
                    if d < least or (d == least and (best < 0 or k < best)):
                        best, least = k, d
            if best < 0:
                best = len(founder)
                founder.append(begin + len(own))
                mx.append(x)
                my.append(y)
                mh.append(h)
                points.append(1)
                place.append(c)
                for a in around(c):
                    near.setdefault(a, []).append(best)
            else:
                m = points[best] = points[best] + 1
                x = mx[best] = mx[best] + (x - mx[best]) / m
                y = my[best] = my[best] + (y - my[best]) / m
                h = mh[best] = (mh[best] + ((h - mh[best] + 180) % 360 - 180) / m + 180) % 360 - 180
                now = (int(x // r) * wide + int(y // r)) * sectors + int((h + 180) // width) % sectors
                if now != place[best]:
                    for a in around(place[best]):
                        near[a].remove(best)
                    for a in around(now):
                        near.setdefault(a, []).append(best)
                    place[best] = now
            own.append(best)
        owner[part] = own
    cells = keys(xs, ys, hs)
    order = np.argsort(cells, kind="stable")
    ends = np.flatnonzero(np.diff(cells[order], append=cells[order[-1:]] + 1)) + 1 if n else np.zeros(0, dtype=np.int64)
    rows = list(zip([0, *ends[:-1].tolist()], ends.tolist(), cells[order[ends - 1]].tolist(), strict=False))
    ox, oy, oh = xs[order], ys[order], hs[order]
    sine, cosine = np.sin(np.radians(hs)), np.cos(np.radians(hs))
    del cells
    k = len(founder)
    for _ in range(settings.final_assign_rounds):
        size = np.bincount(owner, minlength=k)
        count = np.maximum(size, 1)
        m = np.stack([np.bincount(owner, xs, k) / count, np.bincount(owner, ys, k) / count, np.degrees(np.arctan2(np.bincount(owner, sine, k), np.bincount(owner, cosine, k)))], axis=1)
        at = defaultdict(list)
        for j, c in zip(range(k), keys(m[:, 0], m[:, 1], m[:, 2]).tolist(), strict=True):
            if size[j]:
                for a in around(c):
                    at[a].append(j)
        new = owner.copy()
        for first, last, c in rows:
            some = np.array(at.get(c, ()), dtype=np.int64)
            for begin in range(first, last if len(some) else first, 1 << 16):
                s = slice(begin, min(last, begin + (1 << 16)))
                d = np.sqrt((m[some, 0] - ox[s, None]) ** 2 + (m[some, 1] - oy[s, None]) ** 2 + (w * _wrap(m[some, 2] - oh[s, None])) ** 2)
                best = d.argmin(axis=1)
                at_ = order[s]
                new[at_] = np.where(d[np.arange(len(best)), best] <= r, some[best], owner[at_])
        if (new == owner).all():
            break
        owner = new
    return np.array(founder, dtype=np.int64)[owner]


def leader_clusters(points: DataFrame, settings: Settings = Settings(), key: str = "point_id", ts: str = "dense_ts") -> DataFrame:
    """(point_id, id): sequential leader clustering in order of time and point id; id is the founding point's.

    Occupied cells of twice the radius that touch form a group; no cluster reaches across groups, so each group is one
    sequential task and the result does not depend on partitioning."""
    size = 2 * settings.cluster_radius
    p = points.select(F.col(key).alias("k"), F.col(ts).alias("ts"), "x", "y", "orientation", cell(F.col("x"), size).alias("cx"), cell(F.col("y"), size).alias("cy"))
    place = (F.col("cx") + OFFSET) * WIDTH + F.col("cy") + OFFSET
    cells = p.select("cx", "cy").distinct().withColumn("a", place)
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))))
    touch = cells.select("a", F.explode(F.transform(steps, lambda s: (F.col("cx") + s["i"] + OFFSET) * WIDTH + F.col("cy") + s["j"] + OFFSET)).alias("b"))
    label = graph.components(touch.join(cells.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b"))
    grouped = p.withColumn("c", place).join(label, F.col("c") == label["node"], "left").withColumn("g", F.coalesce("label", "c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in _by_group(batches):
            k, x, y, h = (np.concatenate([b[c].to_numpy() for b in held]) for c in ("k", "x", "y", "orientation"))
            held.clear()
            first = lead(x, y, h, settings)
            for i in range(0, len(k), 1 << 20):
                yield pd.DataFrame({"k": k[i : i + (1 << 20)], "id": k[first[i : i + (1 << 20)]]})

    ordered = grouped.select("g", "k", "ts", "x", "y", "orientation").repartition("g").sortWithinPartitions("g", "ts", "k").drop("ts")
    return ordered.mapInPandas(run, "k bigint, id bigint").withColumnRenamed("k", key)


def _by_group(batches: Iterator[pd.DataFrame]) -> Iterator[list[pd.DataFrame]]:
    """The rows of each value of g, in parts; rows of one value are neighbours."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        g = batch["g"].to_numpy()
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b or not len(g):
                continue
            if held and held[-1]["g"].iloc[-1] != g[a]:
                yield held
                held = []
            held.append(batch.iloc[a:b])
    if held:
        yield held


def assignment_near(assigned: DataFrame, clusters: DataFrame, x: float, y: float, radius: float = 500.0) -> DataFrame:
    """(point_id, id, px, py, x, y): points within radius of a place with their clusters' positions."""
    near = assigned.filter((F.abs(F.col("x") - x) <= radius) & (F.abs(F.col("y") - y) <= radius) & (F.sqrt((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)) <= radius))
    return near.select("point_id", "id", F.col("x").alias("px"), F.col("y").alias("py")).join(clusters.select("id", "x", "y"), "id")



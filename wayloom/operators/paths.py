"""Waypoints of connections: least-cost sequences of clusters between two, by chord, Dubins path or gravity.

Each connection is one row with its candidates, so connections are worked on independently in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import CHORD, DUBINS, GRAVITY, Settings
from . import graph
from .connect import circle_candidates
from .spatial import cell

SCHEMA = "src bigint, dst bigint, path array<bigint>"


def wrap(a: np.ndarray) -> np.ndarray:
    return (a + 180) % 360 - 180


def dubins(a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
    """Shortest lengths of bounded curvature between poses (x, y, degrees), broadcast over rows."""
    two_pi = 2 * math.pi
    dx, dy = b[..., 0] - a[..., 0], b[..., 1] - a[..., 1]
    d = np.hypot(dx, dy) / radius
    phi = np.arctan2(dy, dx)
    p, q = np.mod(np.radians(a[..., 2]) - phi, two_pi), np.mod(np.radians(b[..., 2]) - phi, two_pi)
    sa, sb, ca, cb, c = np.sin(p), np.sin(q), np.cos(p), np.cos(q), np.cos(p - q)
    mod = lambda t: np.mod(t, two_pi)
    with np.errstate(invalid="ignore"):
        s = np.sqrt(2 + d * d - 2 * c + 2 * d * (sa - sb))
        t = np.arctan2(cb - ca, d + sa - sb)
        every = [mod(t - p) + s + mod(q - t)]
        s = np.sqrt(2 + d * d - 2 * c + 2 * d * (sb - sa))
        t = np.arctan2(ca - cb, d - sa + sb)
        every.append(mod(p - t) + s + mod(t - q))
        s = np.sqrt(-2 + d * d + 2 * c + 2 * d * (sa + sb))
        t = np.arctan2(-ca - cb, d + sa + sb) - np.arctan2(-2.0, s)
        every.append(mod(t - p) + s + mod(t - q))
        s = np.sqrt(-2 + d * d + 2 * c - 2 * d * (sa + sb))
        t = np.arctan2(ca + cb, d - sa - sb) - np.arctan2(2.0, s)
        every.append(mod(p - t) + s + mod(q - t))
        m = mod(two_pi - np.arccos((6 - d * d + 2 * c + 2 * d * (sa - sb)) / 8))
        t = mod(p - np.arctan2(ca - cb, d - sa + sb) + m / 2)
        every.append(t + m + mod(p - q - t + m))
        m = mod(two_pi - np.arccos((6 - d * d + 2 * c + 2 * d * (sb - sa)) / 8))
        t = mod(-p - np.arctan2(ca - cb, d + sa - sb) + m / 2)
        every.append(t + m + mod(mod(q) - p - t + m))
    return np.nanmin(np.stack(every), axis=0) * radius


def intermediate_ok(a: np.ndarray, b: np.ndarray, m: np.ndarray, tolerance: float) -> bool:
    """Whether pose m may lie between a and b: its turn against their chord is within the tolerance of theirs."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    if math.hypot(dx, dy) < 1e-5:
        return False
    chord = math.degrees(math.atan2(dy, dx))
    ta, tb, tm = (float(wrap(np.float64(v[2] - chord))) for v in (a, b, m))
    return min(-tolerance, ta - tolerance, tb - tolerance) <= tm <= max(tolerance, ta + tolerance, tb + tolerance)


def search(poses: np.ndarray, settings: Settings, method: int) -> list[int]:
    """Dijkstra over all ordered pairs of poses from the first to the last; the cost of a step is its squared length.

    With chords, a pose that does not fit between the one before it and the end is closed when it is reached."""
    n = len(poses)
    cost, before, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, dtype=bool)
    cost[0] = 0
    while True:
        i = int(np.where(done, np.inf, cost).argmin())
        if done[i] or cost[i] == np.inf:
            return [0, n - 1]
        done[i] = True
        if i == n - 1:
            break
        if method == CHORD and i != 0 and not intermediate_ok(poses[before[i]], poses[-1], poses[i], settings.angular_threshold):
            continue
        if method == CHORD:
            step = (poses[:, 0] - poses[i, 0]) ** 2 + (poses[:, 1] - poses[i, 1]) ** 2
        else:
            step = dubins(poses[i], poses, settings.dubins_turning_radius) ** 2
        step[i] = np.inf
        better = ~done & (cost[i] + step < cost)
        cost[better] = (cost[i] + step)[better]
        before[better] = i
    out = [n - 1]
    while out[-1]:
        out.append(int(before[out[-1]]))
    return out[::-1]


def gravity(a: np.ndarray, b: np.ndarray, points: np.ndarray, settings: Settings) -> np.ndarray:
    """A chord cut into short pieces that points nearby, of like heading, draw sideways while springs keep it even."""
    radius = settings.cluster_radius / 2
    n = max(2, math.ceil(math.hypot(*(b[:2] - a[:2])) / radius) + 1)
    t = np.linspace(0, 1, n)[:, None]
    line = a[:2] + t * (b[:2] - a[:2])
    if n == 2:
        return line
    span = b[:2] - a[:2]
    unit = span / max(1e-9, np.hypot(*span))
    heading = math.degrees(math.atan2(unit[1], unit[0]))
    like = points[np.abs(wrap(points[:, 2] - heading)) <= settings.gravity_angle + abs(float(wrap(np.float64(a[2] - heading))))] if len(points) else points
    if len(like):  # pieces move sideways only: each meets the points of its stretch of the chord
        along = (like[:, :2] - a[:2]) @ unit
        order = np.argsort(along, kind="stable")
        like, along = like[order], along[order]
        at = (line[1:-1] - a[:2]) @ unit
        spans = list(zip(np.searchsorted(along, at - radius - 1e-6).tolist(), np.searchsorted(along, at + radius + 1e-6, "right").tolist(), strict=True))
    for _ in range(settings.gravity_rounds):
        inner = line[1:-1]
        spring = (line[:-2] + line[2:]) / 2 - inner
        pull = np.zeros_like(inner)
        if len(like):
            for k, (first, last) in enumerate(spans):
                v = like[first:last, :2] - inner[k]
                d = np.hypot(v[:, 0], v[:, 1])
                w = np.where(d <= radius, (radius - d) / radius, 0)
                total = w.sum()
                if total > 0:
                    mean = (v * w[:, None]).sum(axis=0) / total
                    pull[k] = mean - (mean @ unit) * unit  # sideways only
        line = np.vstack([line[:1], inner + spring / 2 + pull / 2, line[-1:]])
    return line


def _rows(connections: DataFrame, clusters: DataFrame) -> DataFrame:
    """(src, dst, poses): each connection's ends and candidates between them as (id, x, y, heading)."""
    pose = F.struct(F.col("id"), "x", "y", "orientation")
    c = clusters.select("id", pose.alias("pose"))
    near = circle_candidates(connections, clusters).join(c, "id").groupBy("src", "dst").agg(F.sort_array(F.collect_list("pose")).alias("between"))
    s, d = c.select(F.col("id").alias("src"), F.col("pose").alias("a")), c.select(F.col("id").alias("dst"), F.col("pose").alias("b"))
    return connections.select("src", "dst").distinct().join(s, "src").join(d, "dst").join(near, ["src", "dst"], "left")


def _poses(rows: list) -> tuple[np.ndarray, list[int]]:
    return np.array([[r["x"], r["y"], r["orientation"]] for r in rows], dtype=float).reshape(-1, 3), [r["id"] for r in rows]


def connect(connections: DataFrame, clusters: DataFrame, settings: Settings = Settings(), method: int | None = None, points: DataFrame | None = None) -> DataFrame:
    """(src, dst, path): the sequence of clusters of each connection, its ends included."""
    method = settings.intermediate_point_method if method is None else method
    if method == GRAVITY:
        return _gravity_paths(connections, clusters, points, settings)
    if method not in (CHORD, DUBINS):
        raise ValueError(f"unknown intermediate_point_method: {method}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            out = []
            for src, dst, a, b, between in g[["src", "dst", "a", "b", "between"]].itertuples(index=False):
                poses, ids = _poses([a, *(between if between is not None else []), b])
                out.append((src, dst, [ids[i] for i in search(poses, settings, method)]))
            yield pd.DataFrame(out, columns=["src", "dst", "path"])

    return _rows(connections, clusters).mapInPandas(run, SCHEMA)


def _gravity_paths(connections: DataFrame, clusters: DataFrame, points: DataFrame, settings: Settings) -> DataFrame:
    """Gravity lines snapped to the nearest clusters within the radius, in the order of first meeting.

    A connection needs the points in the cells of its box. Those whose boxes begin in one tile of two by two cells are one task,
    which gets each point once, however many connections pass it."""
    size, tile = 60.0, 2
    c = clusters.select("id", "x", "y", "orientation")
    ends = connections.select("src", "dst").distinct().join(c.select(F.col("id").alias("src"), F.struct("id", "x", "y", "orientation").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.struct("id", "x", "y", "orientation").alias("b")), "dst")
    margin = settings.cluster_radius
    low = lambda n: cell(F.least(F.col(f"a.{n}"), F.col(f"b.{n}")) - margin, size)
    high = lambda n: cell(F.greatest(F.col(f"a.{n}"), F.col(f"b.{n}")) + margin, size)
    rows = ends.withColumns({"x0": low("x"), "x1": high("x"), "y0": low("y"), "y1": high("y")}).withColumns({"tx": F.floor(F.col("x0") / tile), "ty": F.floor(F.col("y0") / tile)})
    rows = graph.settled(rows)
    cells = rows.withColumn("cx", F.explode(F.sequence("x0", "x1"))).withColumn("cy", F.explode(F.sequence("y0", "y1"))).select(F.col("tx").alias("px"), F.col("ty").alias("py"), "cx", "cy").distinct()
    at = lambda df, *kept: df.select(*kept, "x", "y", "orientation", cell(F.col("x"), size).alias("cx"), cell(F.col("y"), size).alias("cy"))
    places = at(points, F.lit(0).cast("bigint").alias("id"), F.lit(False).alias("site")).unionByName(at(c, "id", F.lit(True).alias("site"))).join(cells, ["cx", "cy"])
    numbers = ("ax", "ay", "ah", "bx", "by", "bh", "x0", "x1", "y0", "y1")
    flat = rows.select("tx", "ty", "src", "dst", *(F.col(f"{e}.{n}").alias(f"{e}{k}") for e in "ab" for n, k in (("x", "x"), ("y", "y"), ("orientation", "h"))), "x0", "x1", "y0", "y1")

    def run(key: tuple, e: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["cx", "cy"], kind="stable")
        own = p["site"].to_numpy(dtype=bool)
        split = [_Cells(q) for q in (p[~own], p[own].sort_values(["cx", "cy", "id"], kind="stable"))]
        out = []
        for src, dst, ax, ay, ah, bx, by, bh, x0, x1, y0, y1 in e[["src", "dst", *numbers]].itertuples(index=False):
            pts, _ = split[0].box(x0, x1, y0, y1)
            poses, ids = split[1].box(x0, x1, y0, y1)
            order = np.argsort(ids, kind="stable")
            poses, ids = poses[order], ids[order].tolist()
            path = [src]
            for x, y in gravity(np.array([ax, ay, ah]), np.array([bx, by, bh]), pts, settings)[1:-1]:
                if len(ids):
                    d = np.hypot(poses[:, 0] - x, poses[:, 1] - y)
                    k = int(d.argmin())
                    if ids[k] == dst:
                        break
                    if d[k] <= settings.cluster_radius and ids[k] not in path:
                        path.append(ids[k])
            out.append((src, dst, [*path, dst]))
        return pd.DataFrame(out, columns=["src", "dst", "path"])

    return flat.groupBy("tx", "ty").cogroup(places.groupBy("px", "py")).applyInPandas(run, SCHEMA)


class _Cells:
    """Places (x, y, heading) and ids, sorted by cell, to be taken out by boxes of cells."""

    def __init__(self, p: pd.DataFrame):
        self.poses = p[["x", "y", "orientation"]].to_numpy(dtype=float)
        self.ids = p["id"].to_numpy()
        cx, cy = p["cx"].to_numpy(), p["cy"].to_numpy()
        first = np.flatnonzero(np.r_[True, (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])]) if len(cx) else np.zeros(0, dtype=int)
        self.spans = {(int(cx[i]), int(cy[i])): slice(i, j) for i, j in zip(first.tolist(), [*first[1:].tolist(), len(cx)], strict=True)}

    def box(self, x0: int, x1: int, y0: int, y1: int) -> tuple[np.ndarray, np.ndarray]:
        some = [self.spans[i, j] for i in range(x0, x1 + 1) for j in range(y0, y1 + 1) if (i, j) in self.spans]
        if not some:
            return self.poses[:0], self.ids[:0]
        return np.concatenate([self.poses[s] for s in some]), np.concatenate([self.ids[s] for s in some])

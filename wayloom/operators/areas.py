"""Areas: intersections, useful paths in zones, and outlines of buffered lines on a raster."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..settings import Settings
from . import graph
from .cluster import cluster_stats
from .connect import desired
from .paths import dubins
from .spatial import opposite_lane


def junctions(edges: DataFrame, zone: DataFrame) -> DataFrame:
    """(id, outs, ins, closed): degrees, and whether a vertex cannot belong to an intersection."""
    d = graph.degrees(edges.select("src", "dst").distinct())
    z = zone.select("id", F.lit(True).alias("zoned"))
    return d.join(z, "id", "left").select("id", "outs", "ins", (F.coalesce("zoned", F.lit(False)) | ((F.col("outs") <= 1) & (F.col("ins") <= 1))).alias("closed"), F.coalesce("zoned", F.lit(False)).alias("zoned"))


def lane_partners(edges: DataFrame, vertices: DataFrame, zone: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(id, partner, dist): open splits and the open joins on the opposite lane near them."""
    j = junctions(edges, zone).filter("not closed")
    pairs = opposite_lane(vertices, settings.intersection_search_radius, settings.intersection_search_angular_threshold, settings.roadnetwork_driving_side)
    splits, joins = j.filter("outs > 1").select("id"), j.filter("ins > 1").select(F.col("id").alias("partner"))
    return pairs.join(splits, "id", "left_semi").join(joins, "partner", "left_semi").select("id", "partner", "dist")


def _short_paths(edges: DataFrame, starts: DataFrame, goals: DataFrame, barred: DataFrame, hops: int) -> DataFrame:
    """(a, b): steps of all walks of at most `hops` edges from starts to goals through vertices that are not barred."""
    e = edges.select("src", "dst").distinct().join(barred.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")
    walk = starts.select(F.col("id").alias("at"), F.array("id").alias("path"))
    found = None
    for _ in range(hops):
        walk = walk.join(e, walk["at"] == e["src"]).select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        hit = walk.join(goals.select(F.col("id").alias("at")), "at", "left_semi").select("path")
        found = hit if found is None else found.unionByName(hit)
    steps = F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("a"), F.get("path", i + 1).alias("b")))
    return found.select(F.explode(steps).alias("s")).select("s.*").distinct()


def intersection_links(edges: DataFrame, vertices: DataFrame, zone: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(a, b): what belongs together in intersections: lane partners, and short ways from pure splits to joins and from splits to pure joins."""
    j = junctions(edges, zone)
    open_ = j.filter("not closed")
    partners = lane_partners(edges, vertices, zone, settings).select(F.col("id").alias("a"), F.col("partner").alias("b"))
    zoned = j.filter("zoned").select("id")
    hops = settings.intersection_search_max_path_hops
    forward = _short_paths(edges, open_.filter("outs > 1 and ins <= 1").select("id"), open_.filter("ins > 1").select("id"), zoned, hops)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    backward = _short_paths(back, open_.filter("ins > 1 and outs <= 1").select("id"), open_.filter("outs > 1").select("id"), zoned, hops)
    return partners.unionByName(forward).unionByName(backward.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def intersections(edges: DataFrame, vertices: DataFrame, zone: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(area, id): the vertices of each intersection; an area is named by its smallest vertex."""
    edges, vertices = graph.settled(edges.select("src", "dst").distinct()), graph.settled(vertices.select("id", "x", "y", "orientation"))
    label = graph.components(intersection_links(edges, vertices, graph.settled(zone.select("id")), settings))
    return label.select(F.col("label").alias("area"), F.col("node").alias("id"))


def outlines(segments: np.ndarray, out: float, back: float = 0.0, size: float = 2.0) -> list[list[tuple[float, float]]]:
    """Exterior rings around all places within `out` of the segments (x1, y1, x2, y2), drawn in again by `back`.

    Places are cells of a raster of the given size, which is the tolerance; rings follow cell corners, with straight runs joined."""
    if not len(segments):
        return []
    low = np.floor((segments.reshape(-1, 2).min(axis=0) - out) / size) - 2
    high = np.ceil((segments.reshape(-1, 2).max(axis=0) + out) / size) + 2
    nx, ny = (high - low).astype(int)
    gx = (low[0] + np.arange(nx) + 0.5) * size
    gy = (low[1] + np.arange(ny) + 0.5) * size
    near = np.zeros((nx, ny), dtype=bool)
    reach = math.ceil(out / size) + 1

    def mark(mask: np.ndarray, segs: np.ndarray, radius: float) -> None:
        for x1, y1, x2, y2 in segs:
            i0, i1 = (int(math.floor(v / size - low[0])) for v in (min(x1, x2), max(x1, x2)))
            j0, j1 = (int(math.floor(v / size - low[1])) for v in (min(y1, y2), max(y1, y2)))
            i, j = slice(max(0, i0 - reach), i1 + reach + 1), slice(max(0, j0 - reach), j1 + reach + 1)
            px, py = gx[i][:, None] - x1, gy[j][None, :] - y1
            dx, dy = x2 - x1, y2 - y1
            t = np.clip((px * dx + py * dy) / max(1e-12, dx * dx + dy * dy), 0, 1)
            mask[i, j] |= (px - t * dx) ** 2 + (py - t * dy) ** 2 <= radius * radius

    mark(near, segments, out)
    if back > 0:
        k = int(round(back / size))
        disk = [(a, b) for a in range(-k, k + 1) for b in range(-k, k + 1) if a * a + b * b <= k * k]
        padded = np.pad(near, k)
        near = np.logical_and.reduce([padded[k + a : k + a + nx, k + b : k + b + ny] for a, b in disk])
    return _rings(near, low, size)


def _rings(mask: np.ndarray, low: np.ndarray, size: float) -> list[list[tuple[float, float]]]:
    """Exterior boundaries of a mask's 4-connected parts, counter-clockwise."""
    nx, ny = mask.shape
    inside = lambda i, j: 0 <= i < nx and 0 <= j < ny and mask[i, j]
    step: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for i, j in np.argwhere(mask).tolist():
        if not inside(i, j - 1):
            step[i, j].append((i + 1, j))
        if not inside(i + 1, j):
            step[i + 1, j].append((i + 1, j + 1))
        if not inside(i, j + 1):
            step[i + 1, j + 1].append((i, j + 1))
        if not inside(i - 1, j):
            step[i, j + 1].append((i, j))
    out = []
    while step:
        first = min(step)
        ring, at, came = [], first, None
        while True:
            ways = step[at]
            if came is not None and len(ways) > 1:  # at a touching corner keep to the left turn of the own part
                ways.sort(key=lambda w: (came[0] * (w[1] - at[1]) - came[1] * (w[0] - at[0])), reverse=True)
            to = ways.pop(0)
            if not ways:
                del step[at]
            d = (to[0] - at[0], to[1] - at[1])
            if d != came:
                ring.append(at)
            came, at = d, to
            if at == first:
                break
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))
        if area > 0:
            out.append([((low[0] + i) * size, (low[1] + j) * size) for i, j in ring])
    return out


def area_rings(segments: DataFrame, out: float, back: float = 0.0, size: float = 2.0) -> DataFrame:
    """(area, n, ring): the rings around each area's segments (area, x1, y1, x2, y2). One task draws one area."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        rings = outlines(g[["x1", "y1", "x2", "y2"]].to_numpy(dtype=float), out, back, size)
        return pd.DataFrame({"area": [str(key[0])] * len(rings), "n": list(range(len(rings))), "ring": [[{"x": x, "y": y, "z": None} for x, y in r] for r in rings]})

    return segments.groupBy("area").applyInPandas(run, "area string, n int, ring array<struct<x: double, y: double, z: double>>")


def subwalks(run: list[tuple[int, int]], source: int, goals: set[int], ways: dict[tuple[int, int], tuple[int, ...]]) -> Iterator[tuple[int, tuple[int, ...], list[int], int]]:
    """(goal, path, points, support) of the parts of a run of (cluster, point) from the source until they touch a goal.

    Each point in the source begins a walk of its own. Paths go by the waypoints of connections, backwards where only the opposite one is there."""
    stays = [(v, [p for _, p in g]) for v, g in groupby(run, key=lambda r: r[0])]
    for i, (start, own) in enumerate(stays):
        if start != source:
            continue
        path, points = [start], list(own)
        for at, more in stays[i + 1 :]:
            last = path[-1]
            if (last, at) in ways:
                path.extend(ways[last, at][1:])
            elif (at, last) in ways:
                path.extend(ways[at, last][-2::-1])
            else:
                path.append(at)
            if at in goals:
                yield at, tuple(path), [*points, more[0]], len(own)
            points.extend(more)


def useful_part(zone_meta: dict[int, str], edges: list[tuple[int, int]], pose: dict[int, tuple[float, float, float]], runs: list[tuple[str, list[tuple[int, int]]]], barred: dict[int, set[int]], targets: set[int], settings: Settings, travel: list[tuple[int, int]] | None = None, ways: dict[tuple[int, int], tuple[int, ...]] | None = None) -> tuple[list[tuple[int, int, str]], set[int]]:
    """The edges of one connected part that ways through its zones need: (src, dst, 'H' observed or 'D' by Dubins length), and the points of the observed ways.

    Wanted are ways from each entry to each exit of a meta zone that are no turn-back, and to and from equipment places. Live
    edges enter and leave; ways go on all edges that were travelled, in the direction of travel. runs: (meta, [(cluster, point)]);
    ways: waypoints by connection."""
    out, back = defaultdict(set), defaultdict(set)
    for a, b in edges if travel is None else travel:
        out[a].add(b)
        back[b].add(a)
    entries = sorted((a, b) for a, b in edges if a not in zone_meta and b in zone_meta)
    exits = sorted((a, b) for a, b in edges if a in zone_meta and b not in zone_meta)

    def deep(start: int, ways: dict[int, set[int]], stop: set[int]) -> bool:
        """Whether a walk of the search depth leads on from start without a stopped cluster."""
        seen, level = {start}, [start]
        for _ in range(settings.zone_exit_search_depth):
            level = sorted({u for v in level for u in ways[v] if u not in seen and u not in stop})
            seen.update(level)
            if not level:
                return False
        return True

    wanted: dict[int, set[int]] = defaultdict(set)
    for outer, head in entries:
        for tail, beyond in exits:
            if zone_meta[head] == zone_meta[tail] and not (beyond in barred.get(outer, ()) and not (deep(beyond, out, barred.get(outer, set())) and deep(outer, back, barred.get(beyond, set())))):
                wanted[head].add(tail)
    for place in sorted(targets):
        if place in zone_meta:
            for _, head in entries:
                if zone_meta[head] == zone_meta[place]:
                    wanted[head].add(place)
            for tail, _ in exits:
                if zone_meta[tail] == zone_meta[place]:
                    wanted[place].add(tail)
    need: set[tuple[int, int, str]] = set()
    support: set[int] = set()
    by_source: dict[int, list[list[tuple[int, int]]]] = defaultdict(list)
    for _, run in runs:
        for v in {v for v, _ in run}:
            if v in wanted:
                by_source[v].append(run)
    for source in sorted(wanted):
        goals = set(wanted[source])
        seen: dict[int, dict[tuple[int, ...], list]] = defaultdict(dict)
        for run in by_source[source]:
            for goal, path, points, n in subwalks(run, source, goals, ways or {}):
                held = seen[goal].setdefault(path, [0, set()])
                held[0] += n
                held[1].update(points)
        for goal, found in sorted(seen.items()):
            path = min(found, key=lambda p: (-found[p][0], p))  # noqa: B023
            need.update((a, b, "H") for a, b in zip(path, path[1:], strict=False))
            support |= found[path][1]
            goals.discard(goal)
        if not goals:
            continue
        cost, before, queue, done = {source: 0.0}, {}, [(0.0, source)], set()
        while queue and goals - done:
            c, v = heapq.heappop(queue)
            if v in done:
                continue
            done.add(v)
            for u in sorted(out[v]):
                if zone_meta.get(u) == zone_meta[source] and u not in done and v in pose and u in pose:
                    new = c + float(dubins(np.array(pose[v]), np.array(pose[u]), settings.dubins_turning_radius))
                    if new < cost.get(u, math.inf):
                        cost[u], before[u] = new, v
                        heapq.heappush(queue, (new, u))
        for goal in sorted(goals & done):
            while goal in before:
                need.add((before[goal], goal, "D"))
                goal = before[goal]
    return sorted(need), support


def chain_points(chained: DataFrame) -> DataFrame:
    """(vehicle, chain, seq, point_id): every point of unbroken runs of pairs, the last one of each included."""
    last = Window.partitionBy("vehicle", "chain").orderBy(F.desc("seq"))
    ends = chained.withColumn("n", F.row_number().over(last)).filter("n = 1").select("vehicle", "chain", (F.col("seq") + 1).alias("seq"), F.col("b_point_id").alias("point_id"))
    return chained.select("vehicle", "chain", "seq", F.col("a_point_id").alias("point_id")).unionByName(ends)


def zone_runs(steps: DataFrame, zone_meta: DataFrame) -> DataFrame:
    """(meta, ids, points): the clusters and points of each run that a vehicle drove inside one meta zone. steps: (vehicle, chain, seq, point_id, id)."""
    w = Window.partitionBy("vehicle", "chain").orderBy("seq")
    rows = steps.join(zone_meta.select("id", "meta"), "id", "left").withColumn("new", F.when(F.lag("meta").over(w).eqNullSafe(F.col("meta")), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("new").over(w)).filter("meta is not null")
    runs = rows.groupBy("vehicle", "chain", "run").agg(F.sort_array(F.collect_list(F.struct("seq", "id", "point_id"))).alias("s"), F.first("meta").alias("meta"))
    return runs.select("meta", F.col("s.id").alias("ids"), F.col("s.point_id").alias("points"))


def zone_walks(steps: DataFrame, zone_meta: DataFrame) -> DataFrame:
    """(meta, path, support): runs of clusters that vehicles drove inside one meta zone, and how often."""
    ids = F.col("ids")
    path = F.filter(F.transform(ids, lambda x, i: F.when((i == 0) | (F.get(ids, i - 1) != x), x)), lambda x: x.isNotNull())
    return zone_runs(steps, zone_meta).select("meta", path.alias("path")).filter("size(path) > 1").groupBy("meta", "path").agg(F.count("*").alias("support"))


def useful_ways(edges: DataFrame, vertices: DataFrame, zone_meta: DataFrame, runs: DataFrame, partners: DataFrame, places: DataFrame, links: DataFrame, settings: Settings = Settings(), ways: DataFrame | None = None) -> DataFrame:
    """(src, dst, kind): the edges inside zones that are needed, and as kind 'P' the points (src) that drove the observed ones.

    edges: live ones; zone_meta: (id, meta); runs: as zone_runs; partners: (id, partner); places: (id); links: pairs of direct
    edges, suppressed or not; ways: (src, dst, path) of connections."""
    edges, vertices, zone_meta = graph.settled(edges.select("src", "dst")), graph.settled(vertices.select("id", "x", "y", "orientation")), graph.settled(zone_meta)
    driven = desired(links)
    travel = driven.filter("fwd > 0").select("src", "dst").union(driven.filter("rev > 0").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    travel = graph.settled(travel.distinct())
    label = graph.components(travel, "src", "dst")
    part = lambda df, c: df.join(label.withColumnRenamed("node", c), c)
    zoned = part(zone_meta, "id").select("label", "id", "meta")
    live = zoned.select("label").distinct()
    types = (("a", "bigint"), ("b", "bigint"), ("s", "string"), ("p", "array<bigint>"), ("q", "array<bigint>"), ("x", "double"), ("y", "double"), ("h", "double"))
    add = lambda df, k, **c: df.select("label", F.lit(k).alias("k"), *(c.get(n, F.lit(None).cast(t)).alias(n) for n, t in types))
    rows = add(part(edges, "src"), "e", a=F.col("src"), b=F.col("dst"))
    rows = rows.unionByName(add(part(travel, "src"), "r", a=F.col("src"), b=F.col("dst")))
    rows = rows.unionByName(add(zoned, "z", a=F.col("id"), s=F.col("meta")))
    rows = rows.unionByName(add(part(vertices, "id"), "v", a=F.col("id"), x=F.col("x"), y=F.col("y"), h=F.col("orientation")))
    rows = rows.unionByName(add(part(runs.withColumn("id", F.get("ids", 0)), "id"), "w", s=F.col("meta"), p=F.col("ids"), q=F.col("points")))
    rows = rows.unionByName(add(part(partners.select("id", "partner"), "id"), "o", a=F.col("id"), b=F.col("partner")))
    rows = rows.unionByName(add(part(places.select("id"), "id"), "t", a=F.col("id")))
    if ways is not None:
        inner = ways.join(zone_meta.select(F.col("id").alias("src")), "src", "left_semi")
        rows = rows.unionByName(add(part(inner, "src"), "c", a=F.col("src"), b=F.col("dst"), p=F.col("path")))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        of = lambda k: g[g["k"] == k]
        ints = lambda s: s.astype("int64").tolist()
        both = lambda k: list(zip(ints(of(k)["a"]), ints(of(k)["b"]), strict=True))
        barred: dict[int, set[int]] = defaultdict(set)
        for a, b in both("o"):
            barred[a].add(b)
        v, w = of("v"), of("w")
        driven = [(s, list(zip(map(int, p), map(int, q), strict=True))) for s, p, q in zip(w["s"], w["p"], w["q"], strict=True)]
        paths = {e: tuple(map(int, p)) for e, p in zip(both("c"), of("c")["p"], strict=True)}
        got, points = useful_part(
            dict(zip(ints(of("z")["a"]), of("z")["s"], strict=True)), both("e"),
            dict(zip(ints(v["a"]), zip(v["x"], v["y"], v["h"], strict=True), strict=True)), driven, barred, set(ints(of("t")["a"])), settings, both("r"), paths,
        )
        rows = [*got, *((p, 0, "P") for p in sorted(points))]
        return pd.DataFrame(rows, columns=["src", "dst", "kind"]).astype({"src": "int64", "dst": "int64"})

    return rows.join(live, "label", "left_semi").groupBy("label").applyInPandas(run, "src bigint, dst bigint, kind string")


def needed_edges(found: DataFrame) -> DataFrame:
    """(src, dst, kind) of the edges of useful_ways."""
    return found.filter("kind != 'P'").groupBy("src", "dst").agg(F.max("kind").alias("kind"))


def overridden(vertices: DataFrame, assigned: DataFrame, found: DataFrame) -> DataFrame:
    """vertices, those on observed ways with the statistics of the points that drove them."""
    driven = found.filter("kind = 'P'").select(F.col("src").alias("point_id")).distinct()
    better = cluster_stats(assigned.join(driven, "point_id", "left_semi"))
    kept = vertices.join(better.select("id"), "id", "left_anti")
    return kept.unionByName(better.join(vertices.select("id"), "id", "left_semi"))

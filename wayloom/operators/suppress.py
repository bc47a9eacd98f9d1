"""Which edges of the road graph are left out: little used, redundant, disconnected. Inputs: (src, dst, weight) of live edges."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..settings import Settings
from . import graph


def without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The edges that are not suppressed."""
    return edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti")


def little_used(edges: DataFrame, zone: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(src, dst): edges of too little weight between clusters without zone."""
    if settings.minimum_edge_weight <= 1:
        return edges.select("src", "dst").limit(0)
    z = zone.select("id")
    weak = edges.filter(F.col("weight") < settings.minimum_edge_weight)
    return weak.join(z, weak["src"] == z["id"], "left_anti").join(z, weak["dst"] == z["id"], "left_anti").select("src", "dst")


def part_sizes(edges: DataFrame) -> DataFrame:
    """(id, label, size): each vertex with its weakly connected part and that part's size."""
    label = graph.components(edges, "src", "dst")
    return label.join(graph.sizes(label), "label").select(F.col("node").alias("id"), "label", "size")


def disconnected(edges: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(src, dst): edges of parts that are too small or beyond the allowed number, the largest first, then the smallest label."""
    parts = part_sizes(edges)
    own = parts.select("label", "size").distinct().filter(F.col("size") >= settings.minimum_road_network_component_size)
    if settings.maximum_road_network_component_count != float("inf"):
        own = own.orderBy(F.desc("size"), "label").limit(int(settings.maximum_road_network_component_count))
    kept = parts.join(own.select("label"), "label", "left_semi").select("id")
    return edges.join(kept, edges["src"] == kept["id"], "left_anti").select("src", "dst")


def fork_paths(edges: DataFrame, zone: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(start, goal, path, bottleneck, mean): all walks of two to four edges from forks without zone; a walk goes on while it is short."""
    e = edges.select("src", "dst", "weight")
    forks = graph.degrees(e).filter("outs > 1").select(F.col("id").alias("src"))
    if settings.multipath_search_ignore_zones:
        forks = forks.join(zone.select(F.col("id").alias("src")), "src", "left_anti")
    walk = e.join(forks, "src").select(F.col("src").alias("start"), F.col("dst").alias("goal"), F.array("src", "dst").alias("path"), F.col("weight").alias("bottleneck"), F.col("weight").alias("total"))
    every = walk
    for _ in range(settings.multipath_search_max_path_hops - 1):
        step = e.select(F.col("src").alias("goal"), F.col("dst").alias("next"), "weight")
        walk = walk.join(step, "goal").select("start", F.col("next").alias("goal"), F.concat("path", F.array("next")).alias("path"), F.least("bottleneck", "weight").alias("bottleneck"), (F.col("total") + F.col("weight")).alias("total"))
        every = every.unionByName(walk)
    return every.select("start", "goal", "path", "bottleneck", (F.col("total") / (F.size("path") - 1)).alias("mean"))


def rivals(paths: DataFrame) -> DataFrame:
    """(start, goal, paths, best): goals that several paths reach with different first and last steps, and the best path: the largest
    bottleneck, then mean weight, then the smallest path."""
    second, last = F.get("path", 1), F.get("path", F.size("path") - 2)
    w = Window.partitionBy("start", "goal").orderBy(F.desc("bottleneck"), F.desc("mean"), "path")
    n = paths.groupBy("start", "goal").agg(F.count("*").alias("paths"), F.countDistinct(second).alias("firsts"), F.countDistinct(last).alias("lasts"))
    best = paths.withColumn("n", F.row_number().over(w)).filter("n = 1").select("start", "goal", F.col("path").alias("best"))
    return n.filter("paths > 1 and firsts > 1 and lasts > 1").join(best, ["start", "goal"]).select("start", "goal", "paths", "best")


def redundant_part(edges: dict[tuple[int, int], int], zoned: set[int], settings: Settings, starts: set[int] | None = None) -> list[tuple[int, int]]:
    """The redundant edges of one part; starts (all forks, or some) are taken in order of id, and each sees what the earlier ones left out."""
    out, back = defaultdict(set), defaultdict(set)
    for a, b in edges:
        out[a].add(b)
        back[b].add(a)
    incoming = {v: frozenset(s) for v, s in back.items()}
    gone: list[tuple[int, int]] = []
    for start in sorted(out):
        if (starts is not None and start not in starts) or len(out[start]) <= 1 or (settings.multipath_search_ignore_zones and start in zoned):
            continue
        by_goal: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        grow = [(start, v) for v in sorted(out[start])]
        while grow:
            path = grow.pop()
            by_goal[path[-1]].append(path)
            if len(path) <= settings.multipath_search_max_path_hops:
                grow.extend((*path, v) for v in sorted(out[path[-1]]))
        for goal in sorted(by_goal):
            paths = [p for p in by_goal[goal] if all(b in out[a] for a, b in zip(p, p[1:], strict=False))]
            if len(paths) < 2 or len({p[-2] for p in paths}) < 2 or len({p[1] for p in paths}) < 2:
                continue
            weight = lambda p: [edges[e] for e in zip(p, p[1:], strict=False)]
            best = min(paths, key=lambda p: (-min(weight(p)), -sum(weight(p)) / (len(p) - 1), p))
            on, every = set(best), {v for p in paths for v in p}
            chosen = set(zip(best, best[1:], strict=False))

            def inside(v: int, ways, on: set[int] = on, every: set[int] = every) -> bool:
                """Whether all that v reaches by `ways` without the best path stays among the paths."""
                seen, todo = set(), [v]
                while todo:
                    u = todo.pop()
                    if u in on or u in seen:
                        continue
                    if u not in every:
                        return False
                    seen.add(u)
                    todo.extend(ways.get(u, ()))
                return True

            for a in sorted(every):
                for b in sorted(out[a]):
                    if b in every and (a, b) not in chosen and (b in on or inside(b, out)) and (a in on or inside(a, incoming)):
                        gone.append((a, b))
            for a, b in gone:
                out[a].discard(b)
    return gone


def redundant(edges: DataFrame, zone: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(src, dst): edges off the best path that lead nowhere else.

    A start looks at the clusters of its rival paths and the edges at these, and leaves out edges between them. So starts whose rival paths
    share no cluster do not see each other: what shares some is one part, one task, however large the connected map is. Edges that are
    left out make no new rivals, so those of the whole graph are all."""
    edges, zone = graph.settled(edges.select("src", "dst", "weight")), graph.settled(zone.select("id"))
    walks = fork_paths(edges, zone, settings)
    apart = rivals(walks).select("start", "goal")
    on = graph.settled(walks.join(apart, ["start", "goal"]).select("start", F.explode("path").alias("v")).distinct())
    label = graph.components(on.filter("start != v"), "start", "v")
    starts = on.select(F.col("start").alias("src")).distinct().withColumn("fork", F.lit(True))
    at = edges.join(label, edges["src"] == label["node"]).unionByName(edges.join(label, edges["dst"] == label["node"])).select("label", "src", "dst", "weight").distinct()
    z = zone.select("id", F.lit(True).alias("zoned"))
    rows = at.join(starts, "src", "left").join(z, at["src"] == z["id"], "left").select("label", "src", "dst", "weight", F.coalesce("fork", F.lit(False)).alias("fork"), F.coalesce("zoned", F.lit(False)).alias("zoned"))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        w = {(a, b): n for a, b, n in g[["src", "dst", "weight"]].sort_values(["src", "dst"]).itertuples(index=False)}
        of = lambda c: set(g.loc[g[c], "src"].tolist())
        return pd.DataFrame(sorted(set(redundant_part(w, of("zoned"), settings, of("fork")))), columns=["src", "dst"], dtype="int64")

    return rows.groupBy("label").applyInPandas(run, "src bigint, dst bigint").distinct()

"""Load and dump tags: propagation along trajectories, votes on edges, zones."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..settings import Settings
from . import graph


def chains(edges: DataFrame) -> DataFrame:
    """edges with `chain`, the number of the unbroken run of pairs in its vehicle's trajectory, and `at`, the metres driven in it before the pair."""
    w = Window.partitionBy("vehicle").orderBy("seq")
    broken = F.when(F.lag("b_point_id").over(w) == F.col("a_point_id"), 0).otherwise(1)
    rows = edges.withColumn("broken", broken).withColumn("chain", F.sum("broken").over(w)).drop("broken")
    run = Window.partitionBy("vehicle", "chain").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    micro = F.floor(F.col("dist") * 1e6 + 0.5)  # whole micrometres: sums are exact
    return rows.withColumn("to", F.sum(micro).over(run) / 1e6).withColumn("at", (F.sum(micro).over(run) - micro) / 1e6)


def propagated(edges: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(a_point_id, b_point_id, tag): the tag of each pair, from tagged points of its chain within the time and distance limits.

    Of several the one that arrived first (by time, then point id) holds; as tags spread without gaps and with equal limits,
    none can pass an earlier one. Tagged points meet pairs by chain and by stretch of the distance limit."""
    reach, horizon = settings.event_backtrack_distance, settings.event_backtrack_time
    rows = chains(edges)
    keep = ["vehicle", "chain"]
    starts = rows.filter("a_tag is not null").select(*keep, F.col("at").alias("p"), F.col("a_ts").alias("t0"), F.col("a_point_id").alias("pid"), F.col("a_tag").alias("tag"))
    ends = rows.filter("b_tag is not null").select(*keep, F.col("to").alias("p"), F.col("b_ts").alias("t0"), F.col("b_point_id").alias("pid"), F.col("b_tag").alias("tag"))
    tagged = starts.unionByName(ends).groupBy(*keep, "pid").agg(F.max("p").alias("p"), F.first("t0").alias("t0"), F.first("tag").alias("tag"))
    stretch = lambda c: F.floor(F.col(c) / reach)
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    tagged = tagged.withColumn("s", F.explode(F.transform(near, lambda i: stretch("p") + i)))
    met = rows.withColumn("s", stretch("at")).join(tagged, [*keep, "s"])
    ahead = (F.col("at") >= F.col("p")) & (F.col("to") - F.col("p") <= reach) & (F.col("b_ts") <= F.col("t0") + horizon)
    back = (F.col("to") <= F.col("p")) & (F.col("p") - F.col("at") <= reach) & (F.col("a_ts") >= F.col("t0") - horizon)
    return met.filter(ahead | back).groupBy("a_point_id", "b_point_id").agg(F.min_by("tag", F.struct("t0", "pid")).alias("tag"))


def majority(links: DataFrame, settings: Settings = Settings(), tag: str = "tag") -> DataFrame:
    """(src, dst, tag, votes): the tag most pairs of an edge have, if it is one and has votes enough; untagged pairs vote too. Ties go to the smaller name."""
    counted = links.groupBy("src", "dst", F.col(tag).alias("tag")).agg(F.count("*").alias("votes"))
    w = Window.partitionBy("src", "dst").orderBy(F.desc("votes"), F.asc_nulls_last("tag"))
    best = counted.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    return best.filter(F.col("tag").isNotNull() & (F.col("votes") >= settings.minimum_zone_votes))


def seeds(assigned: DataFrame) -> DataFrame:
    """(id, tag): the clusters that own a point with the tag."""
    return assigned.filter("tag is not null").select("id", "tag").distinct()


def trimmed(edges: list[tuple[int, int]], seed: set[int]) -> set[int]:
    """The vertices that stay when tails without seeds are cut from both ends until nothing changes."""
    live = {v for e in edges for v in e}
    while True:
        out, back = defaultdict(list), defaultdict(list)
        for a, b in edges:
            if a in live and b in live:
                out[a].append(b)
                back[b].append(a)
        gone: set[int] = set()
        for there, other in ((out, back), (back, out)):
            for v in sorted(live):
                if other[v]:
                    continue
                while v not in gone and v not in seed and len(there[v]) <= 1:
                    gone.add(v)
                    if not there[v]:
                        break
                    v = there[v][0]
        if not gone:
            return live
        live -= gone


def zones(votes: DataFrame, seed: DataFrame) -> DataFrame:
    """(id, tag): each tag's clusters after trimming; a cluster of several tags takes the last name. One task holds the edges of one tag's area."""
    rows = votes.select("tag", "src", "dst", F.lit(None).cast("bigint").alias("seed")).unionByName(seed.select("tag", F.lit(None).cast("bigint").alias("src"), F.lit(None).cast("bigint").alias("dst"), F.col("id").alias("seed")))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        e = g.dropna(subset=["src"])
        stay = trimmed(list(zip(e["src"].astype("int64").tolist(), e["dst"].astype("int64").tolist(), strict=True)), set(g["seed"].dropna().astype("int64").tolist()))
        return pd.DataFrame({"id": sorted(stay), "tag": key[0]}).astype({"id": "int64"})

    return rows.groupBy("tag").applyInPandas(run, "id bigint, tag string").groupBy("id").agg(F.max("tag").alias("tag"))


def meta_zones(zone: DataFrame, direct: DataFrame) -> DataFrame:
    """(tag, meta): zones that a direct edge joins are one; meta is the smallest name."""
    a, b = zone.select(F.col("id").alias("src"), F.col("tag").alias("a")), zone.select(F.col("id").alias("dst"), F.col("tag").alias("b"))
    touch = direct.select("src", "dst").join(a, "src").join(b, "dst").filter("a != b").select("a", "b")
    label = graph.components(touch)
    names = zone.select("tag").distinct()
    return names.join(label, names["tag"] == label["node"], "left").select("tag", F.coalesce("label", "tag").alias("meta"))


def grown_part(zone: dict[int, str], meta: dict[str, str], edges: list[tuple[int, int]], settings: Settings) -> dict[int, str]:
    """Zones of one connected part after growth: paths back to the zone or over a short way to its meta zone are adopted,
    and so are dead ends that lead nowhere else. Clusters are taken in order of id."""
    out, back = defaultdict(set), defaultdict(set)
    for a, b in edges:
        out[a].add(b)
        back[b].add(a)
    zone = dict(zone)
    work = sorted(zone)
    heapq.heapify(work)
    while work:
        start = heapq.heappop(work)
        if start not in zone:
            continue
        own = zone[start]
        for forward in (True, False):
            queue = [(0.0, start, forward, (start,), 0)]
            best: dict[tuple[int, bool], float] = {}
            dead, elsewhere = [], set()
            while queue:
                cost, v, ahead, path, turns = heapq.heappop(queue)
                if best.get((v, ahead), float("inf")) <= cost and len(path) > 1:
                    continue
                best[v, ahead] = cost
                if len(path) - 1 >= settings.stray_hops:
                    elsewhere.update(path[1:])
                    continue
                if v in path[:-1]:
                    dead.append(path)
                    continue
                if v in zone and len(path) > 1:
                    if meta.get(zone[v], zone[v]) != meta.get(own, own):
                        elsewhere.update(path[1:])
                    elif turns <= 1 and (zone[v] == own or len(path) - 1 <= settings.meta_hops):
                        for u in path:
                            if u not in zone:
                                zone[u] = own
                                heapq.heappush(work, u)
                    continue
                ways, other = (out, back) if ahead else (back, out)
                before = path[-2] if len(path) > 1 else None
                if len(other[v]) > 1:
                    for u in sorted(other[v]):
                        if u != before:
                            heapq.heappush(queue, (cost + 1 + settings.direction_change_cost, u, not ahead, (*path, u), turns + 1))
                if ways[v]:
                    for u in sorted(ways[v]):
                        heapq.heappush(queue, (cost + 1, u, ahead, (*path, u), turns))
                elif len(path) > 1:
                    dead.append(path)
            for path in dead:
                if not elsewhere.intersection(path):
                    for u in path:
                        if u not in zone:
                            zone[u] = own
                            heapq.heappush(work, u)
    return zone


def grown(zone: DataFrame, meta: DataFrame, direct: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(id, tag): zones after growth, part by part of the road graph; parts without zones do not move."""
    zone, direct = graph.settled(zone), graph.settled(direct.select("src", "dst"))
    parts = graph.components(direct, "src", "dst")
    zoned = zone.join(parts, zone["id"] == parts["node"]).join(meta, "tag").select("label", "id", "tag", "meta")
    live = zoned.select("label").distinct()
    edges = direct.select("src", "dst").join(parts, direct["src"] == parts["node"]).join(live, "label", "left_semi").select("label", "src", "dst")

    def run(key: tuple, z: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        got = grown_part(dict(zip(z["id"].tolist(), z["tag"], strict=True)), dict(zip(z["tag"], z["meta"], strict=True)), list(zip(e["src"].tolist(), e["dst"].tolist(), strict=True)), settings)
        return pd.DataFrame({"id": list(got), "tag": list(got.values())}).astype({"id": "int64"})

    grew = zoned.groupBy("label").cogroup(edges.withColumnRenamed("label", "part").groupBy("part")).applyInPandas(run, "id bigint, tag string")
    alone = zone.join(parts, zone["id"] == parts["node"], "left_anti")
    return grew.unionByName(alone.select("id", "tag"))

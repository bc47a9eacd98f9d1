"""The road map: vertices, edges, areas, points of interest and metadata of a state of points and pairs. A pure function of its input."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import areas, cluster, connect, equipment, graph, paths, roads, spatial, suppress, tags
from ..settings import Settings

#: Where an area comes from (fixed values).
UNKNOWN, INTERSECTION, TAG = 0, 1, 2


@dataclass
class State:
    """points: point_id, vehicle, timestamp, dense_ts, seq, x, y, z, orientation, speed, tag; edges as operators.pairs.edges gives them."""

    points: DataFrame
    edges: DataFrame
    diggers: DataFrame | None = None
    dumps: DataFrame | None = None
    locations: DataFrame | None = None
    latest_tags: DataFrame | None = None


@dataclass
class RoadMap:
    vertices: DataFrame  # id, x, y, z, orientation, z_variance, weight, areas
    edges: DataFrame  # src, dst, weight, last_traversal
    areas: DataFrame  # area, source, name, n, ring
    vertex_areas: DataFrame  # area, id
    points_of_interest: DataFrame | None
    metadata: DataFrame


def road_map(state: State, settings: Settings = Settings(), mode: str = "grid", method: int | None = None) -> RoadMap:
    """Assigns points, merges clusters, finds waypoints, zones and statistics, suppresses edges in the order little used, redundant,
    disconnected, adds what zones need, and draws areas. mode: 'grid' or 'leader' clusters; method: of waypoints, None for that of the settings."""
    if mode not in ("leader", "grid"):
        raise ValueError(f"unknown mode: {mode}")
    state = replace(state, points=graph.settled(state.points), edges=graph.settled(state.edges))
    if mode == "leader":
        founded = cluster.leader_clusters(state.points, settings)
        assigned = graph.settled(state.points.join(founded, "point_id"))
    else:
        assigned = graph.settled(cluster.grid_clusters(state.points, settings))
    assigned = cluster.merged(assigned, settings)
    vertices = graph.settled(cluster.cluster_stats(assigned))
    links = graph.settled(connect.linked(state.edges, assigned).join(tags.propagated(state.edges, settings), ["a_point_id", "b_point_id"], "left"))
    wanted = links.select("src", "dst").distinct()
    ways = graph.settled(paths.connect(wanted, vertices, settings, method, state.points))
    links = graph.settled(connect.direct_links(links, ways))
    statistics = graph.settled(connect.statistics(links))

    zone = tags.zones(tags.majority(links, settings), tags.seeds(assigned))
    meta = tags.meta_zones(zone, statistics)
    zone = graph.settled(tags.grown(zone, meta, statistics, settings))
    meta = graph.settled(tags.meta_zones(zone, statistics))

    live = suppress.without(statistics, suppress.little_used(statistics, zone, settings))
    live = graph.settled(live)
    if settings.improve_multipath:
        live = graph.settled(suppress.without(live, suppress.redundant(live, zone, settings)))
    live = graph.settled(suppress.without(live, suppress.disconnected(live, settings)))

    zone_meta = graph.settled(zone.join(meta, "tag").select("id", "meta"))
    a, b = zone.select(F.col("id").alias("src"), F.col("tag").alias("za")), zone.select(F.col("id").alias("dst"), F.col("tag").alias("zb"))
    outside = live.join(a, "src", "left").join(b, "dst", "left").filter("za is null or zb is null or za != zb").select("src", "dst")
    steps = areas.chain_points(tags.chains(state.edges)).join(assigned.select("point_id", "id"), "point_id")
    partners = areas.opposite_lane(vertices, settings.intersection_search_radius, settings.intersection_search_angular_threshold, settings.roadnetwork_driving_side)
    places = zone_meta.select("id").limit(0)
    if state.diggers is not None:
        near = spatial.nearest_any(state.diggers.unionByName(state.dumps, allowMissingColumns=True), vertices, "name")
        places = near.select("id").distinct()
    found = graph.settled(areas.useful_ways(live, vertices, zone_meta, areas.zone_runs(steps, zone_meta), partners, places, links, settings, ways))
    kept = outside.unionByName(areas.needed_edges(found).select("src", "dst")).distinct()
    edges = graph.settled(kept.join(statistics, ["src", "dst"], "left").select("src", "dst", F.coalesce("weight", F.lit(0)).alias("weight"), "last_traversal"))

    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    shown = graph.settled(areas.overridden(vertices.join(ends, "id"), assigned, found))
    crossing = graph.settled(areas.intersections(edges, shown, zone, settings))
    member = crossing.select(F.concat(F.lit("intersection_"), F.col("area").cast("string")).alias("area"), "id")
    member = graph.settled(member.unionByName(zone.join(ends, "id").select(F.col("tag").alias("area"), "id")))
    at = shown.select("id", "x", "y")
    lines = areas.intersection_links(edges, shown, zone, settings)
    p, q = at.select(F.col("id").alias("a"), F.col("x").alias("x1"), F.col("y").alias("y1")), at.select(F.col("id").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    cross_lines = lines.join(crossing.select(F.col("id").alias("a"), "area"), "a").join(p, "a").join(q, "b").select(F.concat(F.lit("intersection_"), F.col("area").cast("string")).alias("area"), "x1", "y1", "x2", "y2")
    every = vertices.select("id", "x", "y")
    zs, zd = zone.join(every, "id").select(F.col("id").alias("src"), F.col("tag").alias("area"), F.col("x").alias("x1"), F.col("y").alias("y1")), zone.join(every, "id").select(F.col("id").alias("dst"), F.col("tag").alias("area"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    own = assigned.join(zone.select("id", F.col("tag").alias("area")), "id").select("area", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    zone_lines = statistics.join(zs, "src").join(zd, ["dst", "area"]).select("area", "x1", "y1", "x2", "y2").unionByName(own)
    rings = areas.area_rings(cross_lines, 20.0, 10.0).select("*", F.lit(INTERSECTION).alias("source"), F.lit(None).cast("string").alias("name"))
    rings = rings.unionByName(areas.area_rings(zone_lines, 20.0).select("*", F.lit(TAG).alias("source"), F.col("area").alias("name")))
    rings = roads.area_heights(graph.settled(rings), member, shown)
    by_vertex = member.groupBy("id").agg(F.sort_array(F.collect_set("area")).alias("areas"))
    pois = None
    if state.diggers is not None:
        pois = equipment.points_of_interest(state.diggers, state.dumps, state.locations, state.latest_tags)
    return RoadMap(shown.join(by_vertex, "id", "left"), edges, rings, member, pois, equipment.metadata(state.points))

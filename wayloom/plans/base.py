"""The tables that analyses of one input share."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster, connect, equipment, graph, pairs, suppress, tags
from ..settings import Settings
from ..sources.derive import gps_points


def fixed(c: Column, digits: int = 6) -> Column:
    """Rounded half up by the same arithmetic in every engine."""
    scale = F.lit(10.0**digits)
    return F.floor(c * scale + F.lit(0.5)) / scale


def stable(assigned: DataFrame) -> DataFrame:
    """Cluster statistics that do not depend on the order of rows."""
    s = cluster.cluster_stats(assigned).select("id", fixed(F.col("orientation")).alias("orientation"), fixed(F.col("z_variance")).alias("z_variance"), "weight")
    micro = lambda c: F.sum(F.floor(F.col(c) * 1e6 + 0.5))
    m = assigned.groupBy("id").agg(*(fixed(micro(c) / F.lit(1e6) / F.count("*")).alias(c) for c in "xyz"))
    return m.join(s, "id").select("id", "x", "y", "z", "orientation", "z_variance", "weight")


class World:
    """Points, pairs, grid clusters, links and equipment of one folder; each is a lazy plan, made when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, settings: Settings = Settings()):
        self.spark, self.sf_dir, self.settings = spark, sf_dir, settings

    def hold(self, *names: str) -> None:
        """Computes what zones read many times once, before it is first asked for: pairs, links, and the named small tables of edges and clusters."""
        kept = ("vehicle", "seq", "a_point_id", "b_point_id", "a_tag", "b_tag", "a_ts", "b_ts", "dist", "rev")
        self.edges = graph.settled(self.edges.select(*kept))
        self.links = graph.settled(self.links)
        for name in names:
            setattr(self, name, graph.settled(getattr(self, name)))

    @cached_property
    def points(self) -> DataFrame:
        return gps_points(self.spark, self.sf_dir)

    @cached_property
    def edges(self) -> DataFrame:
        return pairs.edges(self.points, self.settings)

    @cached_property
    def assigned(self) -> DataFrame:
        return cluster.grid_clusters(self.points, self.settings)

    @cached_property
    def vertices(self) -> DataFrame:
        """Cluster statistics with six decimals, from sums of whole micrometres: the order of sums changes nothing."""
        return stable(self.assigned)

    @cached_property
    def links(self) -> DataFrame:
        return connect.linked(self.edges, self.assigned)

    @cached_property
    def statistics(self) -> DataFrame:
        return connect.statistics(self.links)

    @cached_property
    def no_zone(self) -> DataFrame:
        return self.spark.createDataFrame([], "id bigint, tag string")

    @cached_property
    def live(self) -> DataFrame:
        """Direct edges of weight enough."""
        return self.statistics.filter(F.col("weight") >= self.settings.minimum_edge_weight)

    def _equipment(self, rest: int, prefix: str, values: list[str], rows: DataFrame | None = None) -> DataFrame:
        own = (rows if rows is not None else self.points).filter(F.col("vehicle") % 10 == rest)
        named = own.select(F.concat(F.lit(prefix), F.col("vehicle").cast("string")).alias("name"), "x", "y", "z", F.col("tag").alias("location"), F.col("timestamp").alias("ts"), "seq")
        return equipment.latest(named, "name", values)

    @cached_property
    def diggers(self) -> DataFrame:
        return self._equipment(0, "D", ["x", "y", "z"])

    @cached_property
    def dumps(self) -> DataFrame:
        return self._equipment(1, "P", ["x", "y", "z"])

    @cached_property
    def locations(self) -> DataFrame:
        return self._equipment(0, "D", ["location"], self.points.filter("tag is not null"))

    @cached_property
    def tags(self) -> DataFrame:
        rows = self.points.filter("tag is not null").select("tag", "x", "y", "z", F.col("timestamp").alias("ts"), "point_id")
        return equipment.latest_first(rows, "tag", ["x", "y", "z"], seq="point_id")

    @cached_property
    def tagged_links(self) -> DataFrame:
        """Links with the tag of their pair after propagation."""
        return self.links.join(tags.propagated(self.edges, self.settings), ["a_point_id", "b_point_id"], "left")

    @cached_property
    def votes(self) -> DataFrame:
        return tags.majority(self.tagged_links, self.settings)

    @cached_property
    def vote_zone(self) -> DataFrame:
        """Zones before trimming: the ends of edges with a majority tag."""
        v = self.votes
        return v.select(F.col("src").alias("id"), "tag").unionByName(v.select(F.col("dst").alias("id"), "tag")).groupBy("id").agg(F.max("tag").alias("tag"))

    @cached_property
    def zone(self) -> DataFrame:
        """Zones after trimming."""
        return tags.zones(self.votes, tags.seeds(self.assigned))

    @cached_property
    def road_edges(self) -> DataFrame:
        """Live edges without those of small disconnected parts."""
        return suppress.without(self.live, suppress.disconnected(self.live, self.settings))

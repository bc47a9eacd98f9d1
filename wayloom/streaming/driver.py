"""Streams of messages into state tables that are kept in parts.

The state is a set of tables whose rows lie in parts: points and links by day of event time, the small tables whole. A batch reads
and writes the parts that its messages touch, and then a manifest names the parts of each table, so a reader always sees a whole
version and the cost of a batch follows the batch. Parts that neither the newest nor the version before names are deleted.

Messages are keyed: a batch may be run again without harm. Where several messages speak of one thing, event time decides, then source,
then arrival, as if they were merged in that order (sources.native.merged). Late messages are never dropped, only counted. From live sources messages are held
back while another source is silent, until they are `grace` seconds older than the newest one. Maintenance runs by counts of messages:
clusters are published every `assign_points_every`, connections every `update_connections_every`, and old points go every
`prune_points_every`; `finish` runs the last passes when a stream has ended, `idle` what is due while nothing comes. History is replayed with an
availableNow trigger, live input with a processing-time trigger: the same code."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.metrics import distance2d, point, reversing
from ..operators import cluster, connect, equipment, pairs, prune, spatial
from ..plans.roadmap import RoadMap, State, road_map
from ..settings import Settings
from ..sources.native import MESSAGE

POINTS = "point_id bigint, vehicle string, timestamp bigint, dense_ts bigint, seq bigint, x double, y double, z double, orientation double, speed double, tag string"
LINKS = "a_point_id bigint, b_point_id bigint, a_ts double, b_ts double"
LATEST = "kind string, name string, value string, x double, y double, z double, ts double, source int, seq bigint"
STATS = "messages bigint, late bigint, newest double, since_prune bigint, since_assign bigint, since_update bigint"
CLUSTERS = "id bigint, x double, y double, z double, orientation double, z_variance double, weight bigint"
CONNECTIONS = "src bigint, dst bigint, weight bigint, first_src bigint, last_dst bigint, last_traversal bigint"
TABLES = {"points": POINTS, "links": LINKS, "latest": LATEST, "stats": STATS, "held": MESSAGE, "sources": "source int, newest double", "clusters": CLUSTERS, "connections": CONNECTIONS}
#: Seconds of event time in a part, and the tables that are cut by them, with the column that does it.
PART_SECONDS = 86400
CUT = {"points": "timestamp", "links": "b_ts"}
COUNTERS = ("since_prune", "since_assign", "since_update")


def part_of(ts: str) -> Column:
    return F.floor(F.col(ts) / PART_SECONDS).cast("bigint")


@dataclass
class Store:
    """State tables under a folder: data/<table>/v=<version>/part=<part>, and manifests that name the parts of each version."""

    spark: SparkSession
    folder: str

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _names(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []

    def _removed(self, path: str) -> None:
        fs, where = self._fs(path)
        fs.delete(where, True)

    def versions(self) -> list[int]:
        """The versions whose manifests are whole."""
        every = [int(n.removeprefix("v=")) for n in self._names(f"{self.folder}/manifest") if n.startswith("v=")]
        return sorted(v for v in every if "_SUCCESS" in self._names(f"{self.folder}/manifest/v={v}"))

    def version(self) -> int:
        return max(self.versions(), default=-1)

    def _manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        if v < 0:
            return {"batch": -1, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/manifest/v={v}").first()[0])

    def batch(self) -> int:
        """The last batch that the newest version holds."""
        return self._manifest()["batch"]

    def parts(self, version: int | None = None) -> dict[str, dict[str, str]]:
        """The folders of each table's parts."""
        return self._manifest(version)["tables"]

    def read(self, name: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """A table, or some of its parts."""
        paths = [p for k, p in self.parts(version).get(name, {}).items() if only is None or int(k) in only]
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*paths)

    def write(self, tables: dict[str, DataFrame], only: dict[str, list[int]] | None = None, batch: int | None = None) -> None:
        """Writes tables as a new version, with batch as the last one it holds; of those in `only` the named parts are replaced, and the others stay as they are."""
        manifest = self._manifest()
        now, version = manifest["tables"], self.version() + 1
        for name, df in tables.items():
            at = f"{self.folder}/data/{name}/v={version}"
            df.withColumn("part", part_of(CUT[name]) if name in CUT else F.lit(0)).write.mode("overwrite").partitionBy("part").parquet(at)
            kept = {k: p for k, p in now.get(name, {}).items() if only and name in only and int(k) not in only[name]}
            now[name] = kept | {n.removeprefix("part="): f"{at}/{n}" for n in self._names(at) if n.startswith("part=")}
        before = self.versions()
        said = json.dumps({"batch": manifest["batch"] if batch is None else batch, "tables": now})
        self.spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest/v={version}")
        live = {p for v in before[-1:] for t in self.parts(v).values() for p in t.values()} | {p for t in now.values() for p in t.values()}
        for v in before[:-1]:
            for p in {p for t in self.parts(v).values() for p in t.values()} - live:
                self._removed(p)
            self._removed(f"{self.folder}/manifest/v={v}")


def _stored(batch: DataFrame) -> DataFrame:
    """The points of a batch, both ends of pairs; the id of a point is a hash of its vehicle, second and place. `at` is the order of messages."""
    cols = ("x", "y", "z", "orientation", "speed")
    order = F.struct("ts", "source", "seq")
    to = batch.filter("type in ('GPS_POINT', 'GPS_TAG', 'GPS_PAIR')").select("name", "ts", *cols, F.when(F.col("type") == "GPS_TAG", F.col("tag")).alias("tag"), order.alias("at"))
    back = batch.filter("type = 'GPS_PAIR'").select("name", F.col("from_ts").alias("ts"), *(F.col(f"from_{c}").alias(c) for c in cols), F.lit(None).cast("string").alias("tag"), order.alias("at"))
    rows = to.unionByName(back).withColumn("timestamp", F.col("ts").cast("bigint")).withColumn("point_id", point_id("name", "timestamp", "x", "y", "z"))
    first = F.min_by(F.struct("name", "timestamp", *cols), F.struct("at", *cols))
    one = rows.groupBy("point_id").agg(first.alias("v"), F.max_by("tag", F.when(F.col("tag").isNotNull(), F.struct("at", "tag"))).alias("tag"))
    return one.select("point_id", F.col("v.name").alias("vehicle"), "v.timestamp", F.col("v.timestamp").alias("dense_ts"), F.col("v.timestamp").alias("seq"), *(f"v.{c}" for c in cols), "tag").select([f.split()[0] for f in POINTS.split(", ")])


def point_id(name: str, ts: str, x: str, y: str, z: str):
    return F.xxhash64(name, F.col(ts).cast("bigint"), x, y, z)


def _matched(old: DataFrame, new: DataFrame, settings: Settings) -> DataFrame:
    """(point_id, stored_id): the points of a batch that are, within epsilon, ones that are stored or that come first; chains of two steps end at the first."""
    near = old.join(new.select("vehicle", "timestamp").distinct(), ["vehicle", "timestamp"], "left_semi").select(old.columns)
    every = near.withColumn("rank", F.lit(0)).unionByName(new.join(old.select("point_id"), "point_id", "left_anti").withColumn("rank", F.lit(1)))
    same = spatial.deduped(every.withColumn("ts", F.col("timestamp")), settings.match_epsilon, rank="rank", equal=("vehicle",)).filter("point_id != stored_id")
    same = same.join(new.select("point_id"), "point_id", "left_semi")
    again = same.select(F.col("point_id").alias("stored_id"), F.col("stored_id").alias("first"))
    return same.join(again, "stored_id", "left").select("point_id", F.coalesce("first", "stored_id").alias("stored_id"))


def _latest(store: Store, batch: DataFrame) -> DataFrame:
    """The latest state of equipment and tags after a batch."""
    kinds = {"DIGGER_POSITION": "digger", "DUMP_POSITION": "dump", "EQUIPMENT_LOCATION": "location", "BUCKET_POSITION": "bucket", "GPS_TAG": "tag"}
    kind = F.create_map(*(F.lit(v) for kv in kinds.items() for v in kv))[F.col("type")]
    state = batch.filter(F.col("type").isin(*kinds)).select(kind.alias("kind"), F.when(F.col("type") == "GPS_TAG", F.col("tag")).otherwise(F.col("name")).alias("name"), F.col("tag").alias("value"), "x", "y", "z", "ts", "source", "seq")
    both = store.read("latest").unionByName(state)
    # of equal seconds the first tag stays, any other state is replaced by what comes later
    first = F.when(F.col("kind") == "tag", F.struct(F.floor("ts").alias("a"), (-F.col("ts")).alias("b"), (-F.col("source")).alias("c"), (-F.col("seq")).alias("d"))).otherwise(F.struct(F.floor("ts").alias("a"), F.col("ts").alias("b"), F.col("source").alias("c"), F.col("seq").alias("d")))
    best = both.groupBy("kind", "name").agg(F.max_by(F.struct("value", "x", "y", "z", "ts", "source", "seq"), first).alias("v"))
    return best.select("kind", "name", "v.*")


def upserted(store: Store, batch: DataFrame, settings: Settings, batch_id: int | None = None, held: DataFrame | None = None) -> None:
    """Writes the state after a batch as a new version, with what is held back; only parts that the batch touches are read and written."""
    days = batch.select(F.explode(F.array(part_of("ts"), part_of("from_ts"))).alias("d")).filter("d is not null").distinct().collect()  # days of event time
    touched = sorted(r["d"] for r in days)
    was = store.read("stats")
    latest = _latest(store, batch)
    old, new = store.read("points", only=touched), _stored(batch)
    same = _matched(old, new, settings)
    if settings.auto_tag_gps_points_based_on_equipment_proximity:
        of = lambda k: latest.filter(F.col("kind") == k)
        near = equipment.proximity_tags(new.filter("tag is null"), of("digger").select("name", "x", "y"), of("dump").select("name", "x", "y"), of("location").select("name", F.col("value").alias("location")), settings)
        new = new.join(near.select("point_id", F.col("tag").alias("near")), "point_id", "left").withColumn("tag", F.coalesce("tag", "near")).select(new.columns)
    rows = new.join(same, "point_id", "left").withColumn("point_id", F.coalesce("stored_id", "point_id")).select(new.columns).withColumn("age", F.lit(1))
    both = old.withColumn("age", F.lit(0)).unionByName(rows)
    values = [c for c in old.columns if c not in ("point_id", "tag")]
    points = both.groupBy("point_id").agg(F.min_by(F.struct(*values), F.struct("age", *values)).alias("v"), F.max_by("tag", F.when(F.col("tag").isNotNull(), F.struct("age", "tag"))).alias("tag")).select("point_id", *(f"v.{c}" for c in values), "tag").select(old.columns)
    p = batch.filter("type = 'GPS_PAIR'")
    link = p.select(point_id("name", "from_ts", "from_x", "from_y", "from_z").alias("a_point_id"), point_id("name", "ts", "x", "y", "z").alias("b_point_id"), F.col("from_ts").alias("a_ts"), F.col("ts").alias("b_ts"))
    for end in ("a_point_id", "b_point_id"):
        link = link.join(same.withColumnRenamed("point_id", end), end, "left").withColumn(end, F.coalesce("stored_id", end)).drop("stored_id")
    links = store.read("links", only=touched).unionByName(link.select("a_point_id", "b_point_id", "a_ts", "b_ts")).groupBy("a_point_id", "b_point_id").agg(F.min(F.struct("a_ts", "b_ts")).alias("v")).select("a_point_id", "b_point_id", "v.*")
    buckets = batch.filter("type = 'BUCKET_POSITION'").select("x", "y", (F.col("ts") - settings.minimum_point_age_for_removal_by_bucket).alias("before"))
    if not buckets.isEmpty():
        others = store.read("points").join(points.select("point_id"), "point_id", "left_anti")
        gone = equipment.in_circles(points.unionByName(others), buckets, settings.bucket_radius)
        more = [r["d"] for r in others.join(gone, "point_id", "left_semi").select(part_of("timestamp").alias("d")).distinct().collect()]  # days
        points = points.unionByName(others.filter(part_of("timestamp").isin(more))) if more else points
        points = points.join(gone, "point_id", "left_anti").select(old.columns)
    else:
        more = []
    sums = was.unionByName(_late(batch, was, settings)).agg(*(F.max(c).alias(c) if c == "newest" else F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in was.columns))
    sources = store.read("sources").unionByName(batch.groupBy("source").agg(F.max("ts").alias("newest"))).groupBy("source").agg(F.max("newest").alias("newest"))
    tables = {"points": points, "links": links, "latest": latest, "stats": sums, "sources": sources}
    store.write(tables if held is None else tables | {"held": held}, {"points": touched + more, "links": touched}, batch_id)


def _late(batch: DataFrame, stats: DataFrame, settings: Settings) -> DataFrame:
    """One row of counts: messages, and those far behind the newest time before them: that before the batch, or of their source in it. They are counted, not dropped."""
    newest = stats.agg(F.max("newest").alias("top"))
    own = F.max("ts").over(Window.partitionBy("source").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = batch.select("ts", own.alias("own")).join(F.broadcast(newest))  # one row
    late = F.count_if(F.col("ts") < F.greatest("top", "own") - settings.disorder_threshold)
    n = F.count("*")
    return rows.agg(n.alias("messages"), late.alias("late"), F.max("ts").alias("newest"), *(n.alias(c) for c in COUNTERS))


def pruned(tables: dict[str, DataFrame], settings: Settings) -> dict[str, DataFrame]:
    """The points and links without the points that pruning lets go."""
    points, links = tables["points"], tables["links"]
    assigned = cluster.grid_clusters(points, settings)
    weights = connect.statistics(connect.linked(road_edges(points, links, settings), assigned))
    gone = prune.candidates(assigned, weights, equipment.metadata(points), settings)
    left = points.join(gone, "point_id", "left_anti").select(points.columns)
    return {"points": left, "links": links.join(gone.withColumnRenamed("point_id", "a_point_id"), "a_point_id", "left_anti").join(gone.withColumnRenamed("point_id", "b_point_id"), "b_point_id", "left_anti").select(links.columns)}


def road_edges(points: DataFrame, links: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Links with both points' columns, measured and filtered. Times before truncation decide about speed."""
    side = lambda s: points.select(F.col("vehicle").alias("vehicle") if s == "a" else F.lit(None).alias("v2"), F.col("seq").alias("seq") if s == "a" else F.lit(None).alias("s2"), *(F.col(c).alias(f"{s}_{c}") for c in ("point_id", "x", "y", "z", "orientation", "speed", "tag")))
    rows = links.join(side("a"), "a_point_id").join(side("b").drop("v2", "s2"), "b_point_id")
    rows = rows.withColumn("dt", F.col("b_ts") - F.col("a_ts")).withColumn("dist", distance2d(point("a_"), point("b_"))).withColumn("rev", reversing(point("a_"), point("b_")))
    rows = rows.filter(pairs.verdict(settings).isNull() & (F.col("a_point_id") != F.col("b_point_id")))
    return rows.withColumns({"a_ts": F.col("a_ts").cast("bigint"), "b_ts": F.col("b_ts").cast("bigint")})


def released(store: Store, batch: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(ready, held) of a live batch and what was held before it: ready is what no known source can precede any more, its newest message being as late, and
    what is `grace` seconds older than the newest message of all."""
    every = store.read("held").unionByName(batch.select(store.read("held").columns))
    known = store.read("sources").unionByName(every.groupBy("source").agg(F.max("ts").alias("newest"))).groupBy("source").agg(F.max("newest").alias("newest"))
    slowest, newest = known.agg(F.min("newest"), F.max("newest")).first()
    if newest is None:
        return every, every.limit(0)
    upto = max(slowest, newest - settings.grace)
    return every.filter(F.col("ts") <= upto), every.filter(F.col("ts") > upto)


def maintained(store: Store, settings: Settings, every: bool = False) -> list[str]:
    """Runs what is due by the counts of messages, or `every` task with messages since its last run; gives the names of what ran."""
    due = {"since_prune": settings.prune_points_every, "since_assign": settings.assign_points_every, "since_update": settings.update_connections_every}
    counts = store.read("stats").first()
    ran = [c for c in COUNTERS if counts and counts[c] >= (1 if every else due[c])]
    if "since_prune" in ran:  # with its own assignment and connections
        ran = list(COUNTERS)
    if "since_update" in ran and "since_assign" not in ran:
        ran.append("since_assign")
    if not ran:
        return []
    tables = {"points": store.read("points"), "links": store.read("links")}
    if "since_prune" in ran and not settings.disable_point_pruning:
        tables = pruned(tables, settings)
    out = dict(tables) if "since_prune" in ran and not settings.disable_point_pruning else {}
    assigned = cluster.merged(cluster.grid_clusters(tables["points"], settings), settings)
    out["clusters"] = cluster.cluster_stats(assigned)
    if "since_update" in ran:
        out["connections"] = connect.statistics(connect.linked(road_edges(tables["points"], tables["links"], settings), assigned))
    out["stats"] = store.read("stats").withColumns({c: F.lit(0).cast("bigint") for c in ran})
    store.write(out)
    return ran


def apply_batch(store: Store, batch: DataFrame, batch_id: int, settings: Settings = Settings(), live: bool = False) -> None:
    """One micro-batch: hold back if live, upsert, and maintain when it is due. A batch that is there already is left alone."""
    if batch_id <= store.batch():
        return
    ready, held = released(store, batch, settings) if live else (batch, None)
    ready = ready.persist()
    upserted(store, ready, settings, batch_id, held)
    ready.unpersist()
    maintained(store, settings)


def start(messages: DataFrame, folder: str, settings: Settings = Settings(), live: bool = False, checkpoint: str | None = None) -> StreamingQuery:
    """Runs a stream of messages (sources.native.MESSAGE) into the store at `folder`; history ends by itself, live does not."""
    store = Store(messages.sparkSession, folder)
    writer = messages.writeStream.foreachBatch(lambda df, i: apply_batch(store, df, i, settings, live)).option("checkpointLocation", checkpoint or f"{folder}/checkpoint")
    return (writer.trigger(processingTime="1 second") if live else writer.trigger(availableNow=True)).start()


def idle(store: Store, settings: Settings = Settings()) -> list[str]:
    """While nothing comes: all maintenance that messages since its last run ask for."""
    return maintained(store, settings, every=True)


def finish(store: Store, settings: Settings = Settings()) -> RoadMap:
    """When a stream has ended: what is held back is taken in, all maintenance runs, and the map of the last passes is given."""
    held = store.read("held")
    if not held.isEmpty():
        upserted(store, held, settings, None, held.limit(0))
    idle(store, settings)
    return current_road_map(store, settings)


def state(store: Store, settings: Settings = Settings()) -> State:
    """The current tables as the input of a road map."""
    points, latest = store.read("points"), store.read("latest").withColumn("ts", F.col("ts").cast("bigint"))
    of = lambda k: latest.filter(F.col("kind") == k)
    at = ("name", "x", "y", "z", "ts")
    return State(points, road_edges(points, store.read("links"), settings), of("digger").select(*at), of("dump").select(*at), of("location").select("name", F.col("value").alias("location"), "ts"), of("tag").select(F.col("name").alias("tag"), "x", "y", "z", "ts"))


def current_road_map(store: Store, settings: Settings = Settings()) -> RoadMap:
    """The road map of the newest whole version; asking changes nothing."""
    return road_map(state(store, settings), settings)


def watermarked_counts(messages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Messages per minute and type, emitted once the grace has passed; of several sources the slowest decides."""
    timed = messages.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", f"{settings.grace} seconds")
    return timed.groupBy(F.window("at", "1 minute"), "type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("minute"), "type", "n")


def pending_tags(pairs_: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(vehicle, a_ts, b_ts, tag): forward spread of tags over pairs as they come, a vehicle's open tags being its state.

    pairs_: streaming (vehicle, a_ts, b_ts, dist, tag) with the tag of the pair's first point. A tag's open record ends with its
    time or distance. A vehicle that sends no more is forgotten by event time, `propagation_time_to_live` after its last pair, so history
    replays as live input ran. (The road map finds tags of all pairs, backwards too, from the stored state; this gives them at once.)"""
    reach, horizon, ttl = settings.event_backtrack_distance, settings.event_backtrack_time, settings.propagation_time_to_live

    def run(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        tag, until, left = held.get if held.exists else (None, 0.0, 0.0)
        out, last = [], 0.0
        for g in batches:
            for a, b, d, t in g.sort_values("a_ts")[["a_ts", "b_ts", "dist", "tag"]].itertuples(index=False):
                last = max(last, b)
                if t is not None and t == t:
                    tag, until, left = t, a + horizon, reach
                if tag is not None and b <= until and d <= left:
                    left -= d
                    out.append((key[0], a, b, tag))
                else:
                    tag = None
        if tag is None:
            if held.exists:
                held.remove()
        else:
            held.update((tag, until, left))
            held.setTimeoutTimestamp(max(int((last + ttl) * 1000), held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["vehicle", "a_ts", "b_ts", "tag"])

    timed = pairs_.withColumn("at", F.timestamp_seconds("a_ts")).withWatermark("at", f"{settings.grace} seconds")
    return timed.groupBy("vehicle").applyInPandasWithState(run, "vehicle string, a_ts double, b_ts double, tag string", "tag string, until double, left double", "append", "EventTimeTimeout")

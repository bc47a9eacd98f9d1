"""URL filters by a temporal list join: dated list entries become validity intervals, and an as-of join holds every
capture against the entries that were active when it was fetched.

A list event is (kind, entry, action, since): kind 'host' (that host), 'domain' (the host and all below it) or 'prefix'
(host and the beginning of the path, in whole segments, of any number); action 'add' or 'remove'. An entry is active from
an 'add' to the next 'remove'; of events at one time the removal counts. Each entry's history is one row of sorted bounds,
so a capture meets an entry once however often it changed, and the last bound before the fetch decides.

Hosts are compared in lower case and without a last dot, paths as they are, without empty segments, query and fragment.
An address ([v6] or a.b.c.d) is its own only domain. What a capture meets depends on its URL and time alone, so rows that
share an id, or have none, are told apart by these. Captures whose URL is null or has no host, or whose time is null, meet
no entry and are allowed. Repeated captures give repeated rows. Events with nulls are ignored. An empty list allows
everything. Extra columns are ignored.

A list counted below BROADCAST_ROWS entries and intervals is broadcast. A larger one is joined by entry, and the entries that more
than HOT_ROWS captures ask for (a common host, 'com') are cut into that many parts on both sides. Answers go back to the
captures in SALTS parts, by where a row was read, so a URL that makes up much of the input is not one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small_side, written

#: scheme, user information, host, port, path (query and fragment are no part of an entry).
HOST = r"^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)"
ADDRESS = r"^(\[.*|[0-9]+(\.[0-9]+){3})$"
#: Asked rows of one entry in one part of a join with a large list.
HOT_ROWS = 1_000_000
#: Parts in which answers go back to captures.
SALTS = 8


def host_of(url: Column) -> Column:
    """The host in lower case without a last dot, or null."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def _segments(path: Column) -> Column:
    return F.array_remove(F.split(path, "/"), "")


def entry_of(kind: Column, entry: Column) -> Column:
    """An entry as captures are compared with it: host in lower case without a last dot, then whole segments of the path."""
    segments = _segments(entry)
    host = F.regexp_replace(F.lower(F.get(segments, F.lit(0))), r"\.$", "")
    return F.when(kind == "prefix", F.concat_ws("/", host, F.slice(segments, F.lit(2), F.greatest(F.lit(1), F.size(segments))))).otherwise(F.regexp_replace(F.lower(entry), r"\.$", ""))


def intervals(events: DataFrame) -> DataFrame:
    """(kind, entry, starts, ends): the sorted validity intervals of each entry; the last end is null while it is active."""
    own = events.select("kind", entry_of(F.col("kind"), F.col("entry")).alias("entry"), "action", "since").filter("kind is not null and entry is not null and since is not null and action in ('add', 'remove')")
    one = own.groupBy("kind", "entry", "since").agg(F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("off"))
    w = Window.partitionBy("kind", "entry").orderBy("since")
    turns = one.withColumn("was", F.lag("off", 1, 1).over(w)).filter("off != was")  # repeated additions and removals change nothing
    spans = turns.withColumn("until", F.lead("since").over(w)).filter("off = 0")
    listed = spans.groupBy("kind", "entry").agg(F.sort_array(F.collect_list(F.struct("since", "until"))).alias("s"))
    return listed.select("kind", "entry", F.col("s.since").alias("starts"), F.col("s.until").alias("ends"))


def _asked(captures: DataFrame, url: str, at: str, deepest: int) -> DataFrame:
    """(url, at, kind, entry): what each capture can meet: its host, the domains above it, its path's beginnings up to the list's longest."""
    rows = captures.select(F.col(url).alias("url"), F.col(at).alias("at"), host_of(F.col(url)).alias("host")).filter("host is not null and at is not null")
    named = lambda kind, e: F.struct(F.lit(kind).alias("kind"), e.alias("entry"))
    labels = F.when(F.col("host").rlike(ADDRESS), F.array("host")).otherwise(F.split("host", r"\."))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: named("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    segments = _segments(F.regexp_extract("url", PATH, 1))
    n = F.least(F.lit(deepest), F.size(segments))
    host = F.array(named("host", F.col("host")), named("prefix", F.col("host")))
    prefixes = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: named("prefix", F.concat("host", F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/"))))).otherwise(F.slice(host, 1, 0))
    return rows.select("url", "at", F.explode(F.concat(host, domains, prefixes)).alias("e")).select("url", "at", "e.kind", "e.entry")


def _met(asked: DataFrame, spans: DataFrame, most: int) -> DataFrame:
    """asked with the intervals of its entries. spans is a written table."""
    size = spans.agg(F.count("*") + F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()[0]
    if size <= most:
        return asked.join(F.broadcast(spans), ["kind", "entry"])  # counted: entries and intervals together
    load = asked.groupBy("kind", "entry").count().filter(F.col("count") > HOT_ROWS)
    hot, _ = written(load.join(spans, ["kind", "entry"], "left_semi").select("kind", "entry", F.ceil(F.col("count") / HOT_ROWS).cast("int").alias("parts")), "hot")
    hot = small_side(hot, hot.count())  # at most one row for HOT_ROWS asked rows
    parts = F.coalesce("parts", F.lit(1))
    a = asked.join(hot, ["kind", "entry"], "left").withColumn("part", F.pmod(F.xxhash64("url", "at"), parts)).drop("parts")
    b = spans.join(hot, ["kind", "entry"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("parts")
    return a.distinct().join(b, ["kind", "entry", "part"]).drop("part")  # one URL and time often asked are one row


def temporal_join(captures: DataFrame, events: DataFrame, url: str = "url", key: str = "page_id", at: str = "fetched_at", most: int = BROADCAST_ROWS) -> DataFrame:
    """(key, url, host, at, n_active, active, since, blocked) of each capture; `active` lists kind:entry, sorted; `since` is the latest start."""
    spans, _ = written(intervals(events), "intervals")
    deepest = spans.filter("kind = 'prefix'").agg(F.max(F.size(F.split("entry", "/")))).first()[0]
    met = _met(_asked(captures, url, at, max(0, (deepest or 1) - 1)), spans, most)  # longer beginnings than the list's longest match nothing
    last = F.size(F.filter("starts", lambda s: s <= F.col("at")))  # the as-of place: the last interval that began
    met = met.select("url", "at", F.concat_ws(":", "kind", "entry").alias("name"), F.get("starts", last - 1).alias("since"), F.get("ends", last - 1).alias("until"))
    active = met.filter("since is not null and (until is null or at < until)")
    said = active.groupBy("url", "at").agg(F.sort_array(F.collect_set("name")).alias("names"), F.max("since").alias("since"))
    said = said.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = captures.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(at).alias("at"), host_of(F.col(url)).alias("host")).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    out = rows.join(said, ["url", "at", "salt"], "left")
    return out.select(F.col("id").alias(key), F.col("url").alias(url), "host", F.col("at").alias(at), F.coalesce(F.size("names"), F.lit(0)).cast("bigint").alias("n_active"), F.coalesce(F.array_join("names", ","), F.lit("")).alias("active"), "since", F.col("names").isNotNull().alias("blocked"))

"""The three header-less CSV inputs, and messages as one typed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.metrics import center_angle

#: Columns in file order (fixed formats): speed and orientation change places between the first two.
VEHICLE_POSITIONS = "name string, timestamp double, x double, y double, z double, speed double, orientation double"
TAGGED_POSITIONS = "name string, timestamp double, x double, y double, z double, orientation double, speed double, tag string"
ENDPOINT_POSITIONS = "name string, timestamp double, x double, y double, z double, orientation double"
#: Message types (fixed values) and the columns that all messages have.
TYPES = ("GPS_POINT", "GPS_TAG", "GPS_PAIR", "DIGGER_POSITION", "BUCKET_POSITION", "DUMP_POSITION", "EQUIPMENT_LOCATION")
MESSAGE = "source int, seq bigint, ts double, type string, name string, x double, y double, z double, orientation double, speed double, tag string, from_ts double, from_x double, from_y double, from_z double, from_orientation double, from_speed double"


def _read(spark: SparkSession, path: str, schema: str, stream: bool) -> DataFrame:
    reader = (spark.readStream if stream else spark.read).schema(schema).option("header", "false").option("mode", "FAILFAST")
    return reader.csv(path).withColumn("orientation", center_angle(F.col("orientation")))


def read_positions(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return _read(spark, path, VEHICLE_POSITIONS, stream)


def read_tags(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Adds tag_type: 1 for LOAD*, 2 for DUMP*; any other tag is an error."""
    bad = F.raise_error(F.concat(F.lit("unknown tag: "), F.coalesce("tag", F.lit("null"))))
    kind = F.when(F.col("tag").startswith("LOAD"), 1).when(F.col("tag").startswith("DUMP"), 2).otherwise(bad.cast("int"))
    return _read(spark, path, TAGGED_POSITIONS, stream).withColumn("tag_type", kind)


def read_endpoints(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Load and dump places; other names are left out."""
    return _read(spark, path, ENDPOINT_POSITIONS, stream).filter(F.col("name").startswith("LOAD") | F.col("name").startswith("DUMP"))


def file_order(df: DataFrame) -> DataFrame:
    """Adds seq, the place of a row in the order of files and lines; gaps are of no account."""
    return df.withColumn("seq", F.monotonically_increasing_id())


def _message(df: DataFrame, source: int, type_: str, **columns) -> DataFrame:
    fields = [f.split() for f in MESSAGE.split(", ")]
    given = {"source": F.lit(source), "type": F.lit(type_)} | columns
    return df.select(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields))


def pair_messages(positions: DataFrame, source: int = 0) -> DataFrame:
    """Each vehicle's position with the one before in file order, timed by the later one; the first gives none. positions: with seq."""
    w = Window.partitionBy("name").orderBy("seq")
    cols = ("timestamp", "x", "y", "z", "orientation", "speed")
    rows = positions.withColumn("was", F.lag(F.struct(*cols)).over(w)).filter("was is not null")
    return _message(rows, source, "GPS_PAIR", seq=F.col("seq"), ts=F.col("timestamp"), name=F.col("name"), x=F.col("x"), y=F.col("y"), z=F.col("z"), orientation=F.col("orientation"), speed=F.col("speed"), from_ts=F.col("was.timestamp"), from_x=F.col("was.x"), from_y=F.col("was.y"), from_z=F.col("was.z"), from_orientation=F.col("was.orientation"), from_speed=F.col("was.speed"))


def tag_messages(tagged: DataFrame, source: int = 1) -> DataFrame:
    return _message(tagged, source, "GPS_TAG", **{c: F.col(c) for c in ("seq", "name", "x", "y", "z", "orientation", "speed", "tag")}, ts=F.col("timestamp"))


def endpoint_messages(places: DataFrame, source: int = 2) -> DataFrame:
    """A position and a location, named like itself, of each place."""
    own = {"seq": F.col("seq"), "ts": F.col("timestamp"), "name": F.col("name"), "x": F.col("x"), "y": F.col("y"), "z": F.col("z")}
    dump = F.col("name").startswith("DUMP")
    at = _message(places.filter(dump), source, "DUMP_POSITION", **own).unionByName(_message(places.filter(~dump), source, "DIGGER_POSITION", **own))
    return at.unionByName(_message(places, source, "EQUIPMENT_LOCATION", **own, tag=F.col("name")))


def merged(messages: DataFrame) -> DataFrame:
    """All messages by time; of equal times the source that was added first, then arrival."""
    return messages.orderBy("ts", "source", "seq")

"""Positions of vehicles derived from the `events` table: three rings of road, two lanes each, with tags and outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: {ep} is the event's epoch second, {st} the text type; the same text runs in Spark and DuckDB.
POINTS_SQL = """
WITH r AS (SELECT event_id, user_id, event_type, value, {ep} AS timestamp,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM {events}),
s AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS dir,
    ((seq*37 + user_id*11) % 2400) * (2*pi()/2400) AS th0, (value - floor(value))*16 - 8 AS jit FROM r),
q AS (SELECT *, dir*th0 AS th, CASE WHEN dir=1 THEN 370 ELSE 394 END + jit AS rad FROM s),
u AS (SELECT *, degrees(th) + 90*dir AS h FROM q)
SELECT event_id AS point_id, user_id AS vehicle, timestamp, CAST(1704067200 + seq*5 AS BIGINT) AS dense_ts, CAST(seq AS BIGINT) AS seq,
  round(300*(user_id % 3) + (CASE WHEN seq % 29 = 0 THEN 500 ELSE 0 END) + rad*cos(th), 6) AS x,
  round(rad*sin(th), 6) AS y, round(100 + 5*sin(th), 6) AS z,
  round(h - 360*floor((h + 180)/360), 6) AS orientation,
  CAST(CASE WHEN event_type='error' THEN -2 ELSE 8 END AS DOUBLE) AS speed,
  CASE WHEN event_type='purchase' AND th0 < 0.8 THEN concat('LOAD_', CAST(user_id % 3 AS {st}))
       WHEN event_type='signup' AND th0 > 3.0 AND th0 < 3.8 THEN concat('DUMP_', CAST(user_id % 3 AS {st})) END AS tag
FROM u
"""


def gps_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, vehicle, timestamp, dense_ts, seq, x, y, z, orientation, speed, tag)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(POINTS_SQL.replace("{ep}", "unix_timestamp(ts)").replace("{st}", "STRING"), events=events)

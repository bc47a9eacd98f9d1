"""Writers of road maps, and snapshots of a state."""

from __future__ import annotations

import json
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import roads
from ..plans.roadmap import INTERSECTION, RoadMap, State
from ..settings import Settings

TABLES = ("points", "edges", "diggers", "dumps", "locations", "latest_tags")


def csv_rows(m: RoadMap) -> DataFrame:
    """(geometry, type, name, z_variance): roads, then areas by polygon."""
    road = roads.summaries(m.edges, m.vertices).select(
        F.col("wkt").alias("geometry"), F.lit("aa_road").alias("type"),
        F.concat_ws("->", F.col("source").cast("string"), F.col("target").cast("string")).alias("name"), F.col("z_variance").cast("string").alias("z_variance"),
    )
    kind = F.when(F.col("source") == INTERSECTION, "intersection").otherwise("area")
    area = m.areas.select(roads.polygon("ring").alias("geometry"), kind.alias("type"), F.coalesce("name", F.lit("")).alias("name"), F.lit("").alias("z_variance"))
    return road.unionByName(area)


def write_csv(m: RoadMap, folder: str) -> None:
    csv_rows(m).write.option("header", "true").csv(folder)


def dxf_lines(points: list[tuple[float, float, float]], layer: str, colour: int, closed: bool) -> list[str]:
    """A polyline of the plain exchange format (release 12): pairs of a group code and a value."""
    out = ["0", "POLYLINE", "8", layer, "62", str(colour), "66", "1", "70", "9" if closed else "8", "10", "0.0", "20", "0.0", "30", "0.0"]
    for x, y, z in points:
        out += ["0", "VERTEX", "8", layer, "10", f"{x:.3f}", "20", f"{y:.3f}", "30", f"{z:.3f}", "70", "32"]
    return [*out, "0", "SEQEND"]


#: Layers and their colours (fixed values).
LAYERS = (("areas", 140), ("roads", 1))


def write_dxf(m: RoadMap, file: str) -> None:
    """One drawing with areas and roads; rows stream to the driver one partition at a time, as one file has one writer."""
    head = ["0", "SECTION", "2", "TABLES", "0", "TABLE", "2", "LAYER", "70", str(len(LAYERS))]
    for name, colour in LAYERS:
        head += ["0", "LAYER", "2", name, "70", "0", "62", str(colour), "6", "CONTINUOUS"]
    placed = graph_lines(m)
    with Path(file).open("w") as f:
        f.write("\n".join([*head, "0", "ENDTAB", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES"]) + "\n")
        for r in m.areas.select("ring").toLocalIterator():
            f.write("\n".join(dxf_lines([(p["x"], p["y"], p["z"] or 0.0) for p in r["ring"]], "areas", 140, True)) + "\n")
        for r in placed.toLocalIterator():
            f.write("\n".join(dxf_lines([(p["x"], p["y"], p["z"]) for p in r["line"]], "roads", 1, False)) + "\n")
        f.write("0\nENDSEC\n0\nEOF\n")


def graph_lines(m: RoadMap) -> DataFrame:
    """(line): the places of each road in order."""
    placed = roads.chains(m.edges).select("road", "step", "src", "dst")
    v = m.vertices.select("id", "x", "y", "z")
    first = placed.filter("step = 0").select("road", F.lit(-1).alias("step"), F.col("src").alias("id"))
    nodes = first.unionByName(placed.select("road", "step", F.col("dst").alias("id"))).join(v, "id")
    return nodes.groupBy("road").agg(F.sort_array(F.collect_list(F.struct("step", "x", "y", "z"))).alias("line")).select("line")


def save_snapshot(state: State, folder: str, settings: Settings = Settings()) -> None:
    """A state as Parquet tables and its settings as one row of JSON."""
    spark = state.points.sparkSession
    for name in TABLES:
        if (df := getattr(state, name)) is not None:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark.createDataFrame([(json.dumps(asdict(settings)),)], "settings string").write.mode("overwrite").text(f"{folder}/settings")


def load_snapshot(spark: SparkSession, folder: str, use_settings: bool = True) -> tuple[State, Settings]:
    """A saved state. With use_settings its own settings, else the defaults. Tables that were not saved are None."""
    found = {n: _table(spark, f"{folder}/{n}") for n in TABLES}
    if found["points"] is None or found["edges"] is None:
        raise ValueError(f"no snapshot in {folder}")
    settings = Settings(**json.loads(spark.read.text(f"{folder}/settings").first()["value"])) if use_settings else Settings()
    return State(**found), settings


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.parquet(path) if there else None

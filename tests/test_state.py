import random

import pytest
from pyspark.sql import functions as F

from wayloom.operators import cluster, pairs, prune
from wayloom.plans import roadmap
from wayloom.plans.base import World
from wayloom.settings import Settings
from wayloom.sources import export, native
from wayloom.streaming import driver

LOOSE = Settings(minimum_road_network_component_size=2)


def drive(name, passes, y=0.0, step=10.0, n=30, start=1000.0, heading=0.0):
    """Rows of vehicle_positions.csv: straight passes along x."""
    rows = []
    for p in range(passes):
        for i in range(n):
            x = i * step if heading == 0.0 else (n - i) * step
            rows.append((f"{name}{p}", start + 1000 * p + i, x, y, 100.0, 8.0, heading))
    return rows


def write(path, rows):
    path.mkdir(exist_ok=True)
    for k in range(0, len(rows), 40):
        (path / f"part-{k:05d}.csv").write_text("\n".join(",".join(map(str, r)) for r in rows[k : k + 40]) + "\n")
    return str(path)


def test_csv_sources(spark, tmp_path):
    p = write(tmp_path / "v", [("a", 1.0, 0, 0, 0, 5, 540), ("a", 2.0, 5, 0, 0, 5, -190), ("b", 1.5, 9, 9, 0, 5, 0)])
    rows = native.file_order(native.read_positions(spark, p))
    assert sorted(r["orientation"] for r in rows.collect()) == [-180.0, 0.0, 170.0]
    got = native.pair_messages(rows).collect()
    assert len(got) == 1 and (got[0]["from_ts"], got[0]["ts"], got[0]["speed"]) == (1.0, 2.0, 5.0)
    good = write(tmp_path / "t", [("a", 1.0, 0, 0, 0, 10, 5, "LOAD_1"), ("a", 2.0, 0, 0, 0, 10, 5, "DUMP")])
    assert sorted(r["tag_type"] for r in native.read_tags(spark, good).collect()) == [1, 2]
    bad = write(tmp_path / "bad", [("a", 1.0, 0, 0, 0, 10, 5, "OTHER")])
    with pytest.raises(Exception, match="unknown tag"):
        native.read_tags(spark, bad).collect()
    places = write(tmp_path / "e", [("LOAD_1", 1.0, 0, 0, 0, 0), ("X", 1.0, 0, 0, 0, 0), ("DUMP_2", 1.0, 0, 0, 0, 0)])
    kinds = sorted((r["type"], r["name"]) for r in native.endpoint_messages(native.file_order(native.read_endpoints(spark, places))).collect())
    assert kinds == [("DIGGER_POSITION", "LOAD_1"), ("DUMP_POSITION", "DUMP_2"), ("EQUIPMENT_LOCATION", "DUMP_2"), ("EQUIPMENT_LOCATION", "LOAD_1")]


def test_merge_order(spark):
    m = spark.createDataFrame([(1, 5, 10.0), (0, 9, 10.0), (0, 1, 3.0)], "source int, seq bigint, ts double")
    assert [tuple(r) for r in native.merged(m).collect()] == [(0, 1, 3.0), (0, 9, 10.0), (1, 5, 10.0)]


def test_stream_equals_batch(spark, tmp_path):
    path = write(tmp_path / "in", drive("a", 3))
    rows = native.file_order(native.read_positions(spark, path))
    m = native.pair_messages(rows).repartition(3)
    m.write.parquet(str(tmp_path / "messages"))
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "messages"))
    q = driver.start(stream, str(tmp_path / "store"), LOOSE)
    q.awaitTermination(120)
    assert q.exception() is None
    store = driver.Store(spark, str(tmp_path / "store"))
    assert store.batch() >= 1  # several micro-batches
    once = driver.Store(spark, str(tmp_path / "once"))
    driver.apply_batch(once, m, 0, LOOSE)
    key = lambda s: sorted(map(str, s.read("points").drop("seq").collect()))
    assert key(store) == key(once) and store.read("links").count() == once.read("links").count() == 3 * 29
    before = store.version()
    driver.apply_batch(store, m, store.batch(), LOOSE)  # run again: no change
    assert store.version() == before
    got = driver.current_road_map(store, LOOSE)
    assert [r["weight"] for r in got.edges.collect()] and {r["weight"] for r in got.edges.collect()} == {3}


def folder_bytes(path):
    return sum(f.stat().st_size for f in path.rglob("*") if f.is_file())


def test_stream_with_disorder_tags_and_near_points(spark, tmp_path):
    """Shuffled messages of positions, tags and places, and points shaken by less than epsilon, in many batches over two days: the state is that of one batch."""
    rng = random.Random(3)
    rows = drive("a", 3) + drive("b", 2, y=12.0, heading=-180.0, start=86_000.0)
    shaken = [(n, t, x + 0.00004, y - 0.00003, z, s, h) for n, t, x, y, z, s, h in rows[::5]]
    read = lambda r: native.file_order(spark.createDataFrame(r, native.VEHICLE_POSITIONS).coalesce(1))
    m = native.pair_messages(read(rows)).unionByName(native.pair_messages(read(shaken), source=3))
    tags = [("a0", 1000.0 + i, 10.0 * i, 0.0, 100.0, 0.0, 8.0, t) for i, t in ((3, "LOAD_1"), (20, "DUMP_1"))]
    m = m.unionByName(native.tag_messages(native.file_order(spark.createDataFrame(tags, native.TAGGED_POSITIONS).coalesce(1))))
    places = [("LOAD_1", 1000.0, 30.0, 5.0, 100.0, 0.0), ("DUMP_1", 1000.0, 200.0, 5.0, 100.0, 0.0)]
    m = m.unionByName(native.endpoint_messages(native.file_order(spark.createDataFrame(places, native.ENDPOINT_POSITIONS).coalesce(1))))
    every = m.collect()
    rng.shuffle(every)
    once = driver.Store(spark, str(tmp_path / "once"))
    driver.apply_batch(once, spark.createDataFrame(every, m.schema), 0, LOOSE)
    store = driver.Store(spark, str(tmp_path / "many"))
    for i in range(8):
        driver.apply_batch(store, spark.createDataFrame(every[i::8], m.schema), i, LOOSE)
    stored = lambda s: {(r["vehicle"], r["timestamp"], round(r["x"], 3), round(r["y"], 3), r["tag"]) for r in s.read("points").collect()}
    assert stored(store) == stored(once) and len(stored(once)) == len(rows) == once.read("points").count() == store.read("points").count()
    assert {r[4] for r in stored(once)} == {None, "LOAD_1", "DUMP_1"}
    named = lambda s: s.read("links").join(s.read("points").selectExpr("point_id a_point_id", "vehicle v", "timestamp t"), "a_point_id").join(s.read("points").selectExpr("point_id b_point_id", "timestamp u"), "b_point_id")
    links = lambda s: sorted(tuple(r) for r in named(s).select("v", "t", "u").collect())
    assert links(store) == links(once)
    latest = lambda s: sorted((r["kind"], r["name"], r["x"]) for r in s.read("latest").collect())
    assert latest(store) == latest(once)
    assert len(store.parts()["points"]) == 2  # two days
    counts = store.read("stats").first()
    assert counts["messages"] == len(every) and counts["late"] > 0
    assert len(store.versions()) == 2 and folder_bytes(tmp_path / "many") < 3 * folder_bytes(tmp_path / "once")  # this version and the one before


def test_a_batch_touches_its_days_only(spark, tmp_path):
    store = driver.Store(spark, str(tmp_path / "s"))
    day = lambda d: native.pair_messages(native.file_order(spark.createDataFrame(drive(f"v{d}", 1, start=1000.0 + 86400 * d), native.VEHICLE_POSITIONS).coalesce(1)))
    for d in range(3):
        driver.apply_batch(store, day(d), d, LOOSE)
    assert [p.split("/v=")[1].split("/")[0] for _, p in sorted(store.parts()["points"].items())] == ["0", "1", "2"]
    driver.apply_batch(store, day(1).withColumn("name", F.lit("other")), 3, LOOSE)
    assert [p.split("/v=")[1].split("/")[0] for _, p in sorted(store.parts()["points"].items())] == ["0", "3", "2"]
    assert store.read("points").count() == 4 * 30


def test_live_messages_wait_for_slow_sources(spark, tmp_path):
    store = driver.Store(spark, str(tmp_path / "s"))
    rows = native.pair_messages(native.file_order(spark.createDataFrame(drive("a", 1, n=300), native.VEHICLE_POSITIONS).coalesce(1)))
    slow = native.pair_messages(native.file_order(spark.createDataFrame(drive("b", 1, y=50.0, n=50), native.VEHICLE_POSITIONS).coalesce(1)), source=1)
    driver.apply_batch(store, rows.unionByName(slow), 0, LOOSE, live=True)
    newest = 1000 + 299
    assert store.read("points").agg(F.max("timestamp")).first()[0] == newest - LOOSE.grace  # the slow source ended long before that
    assert store.read("held").agg(F.min("ts")).first()[0] > newest - LOOSE.grace
    late = native.pair_messages(native.file_order(spark.createDataFrame([("b0", 1049.0, 490.0, 50.0, 100.0, 8.0, 0.0), ("b0", 1250.0, 500.0, 50.0, 100.0, 8.0, 0.0)], native.VEHICLE_POSITIONS).coalesce(1)), source=1)
    driver.apply_batch(store, late, 1, LOOSE, live=True)
    assert store.read("points").agg(F.max("timestamp")).first()[0] == 1250
    m = driver.finish(store, LOOSE)
    assert store.read("held").isEmpty() and store.read("points").agg(F.max("timestamp")).first()[0] == newest
    assert m.edges.count() >= 0 and store.read("clusters").count() > 0 and driver.idle(store, LOOSE) == []


def test_maintenance_by_counts_and_nearness_tags(spark, tmp_path):
    often = Settings(minimum_road_network_component_size=2, assign_points_every=20, update_connections_every=50, auto_tag_gps_points_based_on_equipment_proximity=True)
    store = driver.Store(spark, str(tmp_path / "s"))
    places = [("LOAD_1", 900.0, 30.0, 5.0, 100.0, 0.0), ("DUMP_1", 900.0, 230.0, 5.0, 100.0, 0.0)]
    driver.apply_batch(store, native.endpoint_messages(native.file_order(spark.createDataFrame(places, native.ENDPOINT_POSITIONS).coalesce(1))), 0, often)
    assert store.read("clusters").isEmpty()
    rows = native.pair_messages(native.file_order(spark.createDataFrame(drive("a", 1), native.VEHICLE_POSITIONS).coalesce(1)))
    driver.apply_batch(store, rows, 1, often)
    assert store.read("clusters").count() > 0 and store.read("connections").isEmpty()
    got = {r["timestamp"] - 1000: r["tag"] for r in store.read("points").collect()}
    assert got == {i: "DUMP_1" if abs(10 * i - 230) ** 2 + 25 < 75**2 else "LOAD_1" if abs(10 * i - 30) ** 2 + 25 < 75**2 else None for i in range(30)}
    driver.apply_batch(store, rows.withColumn("name", F.lit("c")), 2, often)
    assert store.read("connections").count() > 0 and store.read("stats").first()["since_update"] == 0
    bucket = spark.createDataFrame([(2, 1, 1000.0 + 1805, "BUCKET_POSITION", "D", 0.0, 0.0, 100.0)], "source int, seq bigint, ts double, type string, name string, x double, y double, z double")
    message = spark.createDataFrame([], native.MESSAGE).unionByName(bucket, allowMissingColumns=True)
    before = store.read("points").count()
    driver.apply_batch(store, message, 3, often)
    assert before - store.read("points").count() == 4  # two vehicles' points at 0 and 10 m, half an hour older


def test_road_map_straight_and_export(spark, tmp_path):
    store = driver.Store(spark, str(tmp_path / "s"))
    rows = native.file_order(spark.createDataFrame(drive("a", 3) + drive("b", 2, y=12.0, heading=-180.0), native.VEHICLE_POSITIONS).coalesce(1))
    driver.apply_batch(store, native.pair_messages(rows), 0, LOOSE)
    state = driver.state(store)
    m = roadmap.road_map(state, LOOSE)
    lines = export.csv_rows(m).collect()
    assert sum(r["type"] == "aa_road" for r in lines) == 2 and all(r["geometry"].startswith("LINESTRING Z (") for r in lines if r["type"] == "aa_road")
    export.write_dxf(m, str(tmp_path / "map.dxf"))
    text = (tmp_path / "map.dxf").read_text()
    assert text.count("\nPOLYLINE\n") == 2 and text.endswith("EOF\n")
    export.save_snapshot(state, str(tmp_path / "snap"), LOOSE)
    again, settings = export.load_snapshot(spark, str(tmp_path / "snap"))
    assert settings == LOOSE and again.points.count() == state.points.count()
    with pytest.raises(ValueError, match="no snapshot"):
        export.load_snapshot(spark, str(tmp_path / "nothing"))


def test_leader_properties(spark, small):
    p = World(spark, small).points
    a = cluster.leader_clusters(p).collect()
    assert len(a) == p.count() == len({r["point_id"] for r in a})
    b = cluster.leader_clusters(p.repartition(7, "x")).collect()
    assert {tuple(r) for r in a} == {tuple(r) for r in b}  # partitioning changes nothing
    assert {r["id"] for r in a} <= {r["point_id"] for r in a}


def test_counts_add_up(spark, small):
    w = World(spark, small)
    assert w.links.count() == w.statistics.agg(F.sum("weight")).first()[0]
    assert pairs.violations(w.edges).isEmpty()


def test_prune_ages(spark):
    day = 86400
    pts = [(1, 1, 0, 0, 5), (2, 1, 10, 1, 6), (3, 1, 8 * day, 2, 7)]
    assigned = spark.createDataFrame(pts, "point_id bigint, vehicle bigint, timestamp bigint, seq bigint, id bigint")
    weights = spark.createDataFrame([(5, 6, 3)], "src bigint, dst bigint, weight bigint")
    now = lambda t: spark.createDataFrame([(t,)], "latest bigint")
    flags = lambda t: {r["point_id"]: r["flag"] for r in prune.flagged(assigned, weights, now(t)).collect()}
    assert flags(6 * 3600) == {1: False, 2: False, 3: False}
    assert flags(2 * day)[1] is False  # little driven, so it may be older
    assert flags(4 * day)[1] is True and flags(8 * day)[2] is True


def test_pending_tags_stream(spark, tmp_path):
    rows = [("v", float(i), float(i + 1), 20.0, "LOAD_1" if i == 2 else None) for i in range(12)]
    df = spark.createDataFrame(rows, "vehicle string, a_ts double, b_ts double, dist double, tag string")
    df.filter("a_ts < 5").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.filter("a_ts >= 5").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = driver.pending_tags(stream).writeStream.format("memory").queryName("tags_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(r["a_ts"] for r in spark.table("tags_out").collect())
    assert got == [2.0, 3.0, 4.0, 5.0, 6.0]  # five pairs of 20 m


def test_road_map_merges_and_finds_waypoints(spark, tmp_path):
    jumps = [(f"j{p}", 9000.0 + 1000 * p + 6 * i, 15.0 + 60 * i, 28.5, 100.0, 10.0, 0.0) for p in range(3) for i in range(5)]
    rows = drive("a", 2, y=28.5) + drive("b", 2, y=31.5) + jumps  # two rows of clusters 3 m apart, and pairs of 60 m
    store = driver.Store(spark, str(tmp_path / "m"))
    driver.apply_batch(store, native.pair_messages(native.file_order(spark.createDataFrame(rows, native.VEHICLE_POSITIONS).coalesce(1))), 0, LOOSE)
    m = roadmap.road_map(driver.state(store), LOOSE)
    at = {r["id"]: (r["x"], r["y"]) for r in m.vertices.collect()}
    assert at and all((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 > 15**2 for p in at.values() for q in at.values() if p != q)
    weight = {(at[r["src"]][0], at[r["dst"]][0]): r["weight"] for r in m.edges.collect()}
    assert all(0 < b - a < 45 for a, b in weight)  # none jumps over a cluster
    assert [weight[e] for e in sorted(weight)][:8] == [7] * 8  # pairs of all count on the edges in between

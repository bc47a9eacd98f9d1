import random

from pyspark.sql import functions as F

from wayloom.operators import areas, graph, roads, suppress, tags
from wayloom.settings import Settings


def union_find(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == union_find(edges)


def chain_rows(spark, edges):
    return {(r["src"], r["dst"]): ((r["road"]["s"], r["road"]["d"]), r["step"]) for r in roads.chains(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}


def test_roads_line_fork_and_ring(spark):
    line = [(i, i + 1) for i in range(1, 8)]
    assert chain_rows(spark, line) == {(i, i + 1): ((1, 2), i - 1) for i in range(1, 8)}
    fork = [(1, 2), (2, 3), (3, 4), (3, 5), (5, 6)]
    got = chain_rows(spark, fork)
    assert got[(1, 2)] == ((1, 2), 0) and got[(2, 3)] == ((1, 2), 1) and got[(3, 4)] == ((3, 4), 0) and got[(5, 6)] == ((3, 5), 1)
    ring = [(1, 2), (2, 3), (3, 4), (4, 1), (10, 11)]
    got = chain_rows(spark, ring)
    assert [got[e][0] for e in ring[:4]] == [(1, 2)] * 4 and [got[e][1] for e in ring[:4]] == [0, 1, 2, 3]  # once, from its smallest edge


def test_disconnected_parts(spark):
    edges = [(i, i + 1, 5) for i in range(11)] + [(i, i + 1, 5) for i in range(100, 103)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint, weight bigint")
    gone = {tuple(r) for r in suppress.disconnected(df).collect()}
    assert gone == {(i, i + 1) for i in range(100, 103)}


def test_redundant_shortcut(spark):
    edges = [(0, 1, 9), (1, 2, 9), (2, 3, 9), (1, 5, 2), (5, 3, 2), (3, 4, 9)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint, weight bigint")
    none = spark.createDataFrame([], "id bigint, tag string")
    assert {tuple(r) for r in suppress.redundant(df, none).collect()} == {(1, 5), (5, 3)}
    led = spark.createDataFrame([*edges, (5, 77, 3)], "src bigint, dst bigint, weight bigint")  # the side way leads elsewhere
    assert (1, 5) not in {tuple(r) for r in suppress.redundant(led, none).collect()}


def test_redundant_by_parts_is_that_of_the_whole(spark):
    """Parts of starts that share clusters against one pass over the whole connected graph, in which most parts hang together by roads."""
    rng = random.Random(21)
    edges, n = {}, 0
    for _ in range(25):
        k = rng.randrange(4, 9)
        for _ in range(rng.randrange(k, 2 * k)):
            a, b = rng.sample(range(n, n + k), 2)
            edges[a, b] = rng.randrange(2, 9)
        for i in range(6):  # a road of six edges to the next lot
            edges[n + k - 1 + i, n + k + i] = 5
        n += k + 6
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src bigint, dst bigint, weight bigint")
    zoned = set(rng.sample(range(n), n // 10))
    zone = spark.createDataFrame([(v, "L") for v in sorted(zoned)], "id bigint, tag string")
    want = set(suppress.redundant_part(edges, zoned, Settings()))
    assert {tuple(r) for r in suppress.redundant(df, zone).collect()} == want and len(want) > 20


def brute_leaders(xs, ys, hs, s):
    """Sequential leader clustering by loops over all leaders, and rounds over all pairs."""
    import math

    wrap = lambda a: (a + 180) % 360 - 180
    far = lambda m, i: math.sqrt((m[0] - xs[i]) ** 2 + (m[1] - ys[i]) ** 2 + (s.angular_weight * wrap(m[2] - hs[i])) ** 2)
    means, owner, founder = [], [], []
    for i in range(len(xs)):
        best = min(((far(m, i), k) for k, m in enumerate(means)), default=(math.inf, -1))
        if best[0] <= s.cluster_radius:
            m = means[best[1]]
            m[3] += 1
            m[0] += (xs[i] - m[0]) / m[3]
            m[1] += (ys[i] - m[1]) / m[3]
            m[2] = wrap(m[2] + wrap(hs[i] - m[2]) / m[3])
            owner.append(best[1])
        else:
            owner.append(len(means))
            founder.append(i)
            means.append([xs[i], ys[i], hs[i], 1])
    for _ in range(s.final_assign_rounds):
        own = [[i for i, o in enumerate(owner) if o == k] for k in range(len(founder))]
        rad = [math.radians(h) for h in hs]
        means = [[sum(xs[i] for i in g) / len(g), sum(ys[i] for i in g) / len(g), math.degrees(math.atan2(sum(math.sin(rad[i]) for i in g), sum(math.cos(rad[i]) for i in g)))] if g else None for g in own]
        new = []
        for i in range(len(xs)):
            best = min((far(m, i), k) for k, m in enumerate(means) if m)
            new.append(best[1] if best[0] <= s.cluster_radius else owner[i])
        if new == owner:
            break
        owner = new
    return [founder[o] for o in owner]


def test_leaders_are_brute_force():
    import numpy as np

    from wayloom.operators import cluster

    rng = np.random.default_rng(6)
    for n, width in ((0, 1), (1, 1), (300, 120), (400, 600)):
        xs, ys, hs = rng.uniform(-width, width, n), rng.uniform(-width, width, n), rng.uniform(-180, 180, n).round(1)
        assert cluster.lead(xs, ys, hs, Settings()).tolist() == brute_leaders(xs.tolist(), ys.tolist(), hs.tolist(), Settings()) if n else True


def test_trim_and_growth():
    assert tags.trimmed([(1, 2), (2, 3), (3, 4), (4, 5)], {3}) == {3}
    assert tags.trimmed([(1, 2), (2, 1)], set()) == {1, 2}
    got = tags.grown_part({1: "A", 3: "A"}, {"A": "A"}, [(1, 2), (2, 3), (3, 4), (0, 1)], Settings())
    assert got[2] == "A"


def test_outline_area():
    import numpy as np

    ring = areas.outlines(np.array([[0.0, 0.0, 100.0, 0.0]]), 20.0, 10.0, 1.0)
    assert len(ring) == 1
    p = ring[0]
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, [*p[1:], p[0]], strict=True)) / 2
    assert abs(area - (100 * 20 + 3.1416 * 100)) < 150  # within a cell of the outline


def test_crossing_is_one_intersection(spark):
    # two lanes that meet at 0: a split at 1 and a join at 2 on the opposite lanes
    edges = [(10, 1), (1, 11), (1, 12), (20, 2), (21, 2), (2, 22)]
    v = [(1, 0.0, 0.0, 0.0), (2, 0.0, -10.0, -179.0), *((i, 500.0 + i, 900.0 * (i % 7), 0.0) for i in (10, 11, 12, 20, 21, 22))]
    e = spark.createDataFrame(edges, "src bigint, dst bigint")
    vertices = spark.createDataFrame(v, "id bigint, x double, y double, orientation double")
    none = spark.createDataFrame([], "id bigint, tag string")
    got = {(r["area"], r["id"]) for r in areas.intersections(e, vertices, none).collect()}
    assert got == {(1, 1), (1, 2)}


def test_area_height(spark):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(None).cast("double").alias("z")) for x, y in ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0))))
    a = spark.createDataFrame([("p",), ("empty",)], "area string").withColumn("ring", ring)
    m = spark.createDataFrame([("p", 1), ("p", 2), ("empty", 3)], "area string, id bigint")
    v = spark.createDataFrame([(1, 5.0, 5.0, 100.0), (2, 50.0, 5.0, 300.0), (3, 99.0, 99.0, 1.0)], "id bigint, x double, y double, z double")
    got = roads.area_heights(a, m, v).collect()
    assert len(got) == 1 and {p["z"] for p in got[0]["ring"]} == {100.0}


def test_useful_parts_of_runs():
    # entry 1 -> 2, digger at 4, exit 5 -> 6; a truck enters, loads and leaves in one run; (3, 2) was only driven backwards
    zone = {v: "L" for v in (2, 3, 4, 5)}
    pose = {v: (30.0 * v, 0.0, 0.0) for v in range(1, 7)}
    live, travel = [(1, 2), (3, 4), (5, 6)], [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6)]
    run = [(2, 20), (2, 21), (3, 30), (4, 40), (5, 50)]
    got, points = areas.useful_part(zone, live, pose, [("L", run)], {}, {4}, Settings(), travel)
    assert got == [(2, 3, "H"), (3, 4, "H"), (4, 5, "H")] and points == {20, 21, 30, 40, 50}
    got, points = areas.useful_part(zone, live, pose, [], {}, {4}, Settings(), travel)
    assert got == [(2, 3, "D"), (3, 4, "D"), (4, 5, "D")] and not points  # over suppressed and reversed edges
    back = areas.subwalks([(2, 20), (5, 50)], 2, {5}, {(5, 2): (5, 4, 3, 2)})
    assert list(back) == [(5, (2, 3, 4, 5), [20, 50], 1)]


def test_useful_ways_in_zones(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    vertices = df([(v, 30.0 * v, 0.0, 0.0) for v in range(1, 7)], "id bigint, x double, y double, orientation double")
    zone = df([(v, "L") for v in (2, 3, 4, 5)], "id bigint, meta string")
    links = df([(1, 2, False), (3, 2, True), (3, 4, False), (4, 5, False), (5, 6, False)], "src bigint, dst bigint, rev boolean")
    live = df([(1, 2), (3, 4), (5, 6)], "src bigint, dst bigint")
    chained = df([("a", 1, i, 10 + i, 11 + i) for i in range(5)], "vehicle string, chain bigint, seq bigint, a_point_id bigint, b_point_id bigint")
    at = df([(10 + i, 1 + i) for i in range(6)], "point_id bigint, id bigint")
    none = df([], "id bigint, partner bigint")
    found = areas.useful_ways(live, vertices, zone, areas.zone_runs(areas.chain_points(chained).join(at, "point_id"), zone), none, df([(4,)], "id bigint"), links)
    found = graph.settled(found)
    assert {tuple(r) for r in areas.needed_edges(found).collect()} == {(2, 3, "H"), (3, 4, "H"), (4, 5, "H")}
    assert {r["src"] for r in found.filter("kind = 'P'").collect()} == {11, 12, 13, 14}

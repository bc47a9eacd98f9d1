"""Tests of the findings of round 2."""

import random
from types import SimpleNamespace

from wayloom.operators import equipment
from wayloom.plans import queries
from wayloom.settings import Settings


def test_points_of_one_place_are_one_whatever_their_speed(spark):
    columns = "point_id bigint, dense_ts bigint, seq bigint, vehicle bigint, x double, y double, z double, speed double, orientation double"
    rows = [(1, 5, 1, 1, 10.0, 0.0, 1.0, 8.0, 90.0), (2, 5, 1, 2, 10.00005, 0.0, 1.0, -2.0, 90.0), (3, 6, 2, 1, 10.0, 0.0, 1.0, 8.0, 90.0)]
    got = queries.dedupe_points(SimpleNamespace(points=spark.createDataFrame(rows, columns), settings=Settings())).collect()
    assert {(r["point_id"], r["stored_id"]) for r in got} == {(1, 1), (2, 1), (3, 3)}


def test_crowded_equipment_leaves_few_sites_to_a_cell(spark):
    rng = random.Random(5)
    place = lambda n: (n, rng.uniform(-60, 60), rng.uniform(-60, 60))
    dumps = [place(f"P{i:04d}") for i in range(600)]
    diggers = [place(f"D{i:04d}") for i in range(200)] + [("D9999", 300.0, 0.0), ("D9998", 305.0, 0.0)]
    points = [place(i) for i in range(300)] + [(300 + i, rng.uniform(200, 400), rng.uniform(-90, 90)) for i in range(300)]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    named = "name string, x double, y double"
    got = equipment.proximity_tags(frame(points, "point_id bigint, x double, y double"), frame(diggers, named), frame(dumps, named), frame([(n, f"at {n}") for n, _, _ in diggers], "name string, location string"))
    want = {}
    for i, x, y in points:
        near = [(k, n) for k, some in ((0, diggers), (1, dumps)) for n, a, b in some if ((a - x) ** 2 + (b - y) ** 2) ** 0.5 < 75]
        if near:
            k, n = max(near)
            want[i] = (n, 2) if k else (f"at {n}", 1)
    assert {r["point_id"]: (r["tag"], r["type"]) for r in got.collect()} == want and {k for _, k in want.values()} == {1, 2}
    cells = frame([(i, j) for i in range(-6, 6) for j in range(-6, 6)], "cx bigint, cy bigint")
    sites = frame([(n, x, y, n, 1, 2) for n, x, y in dumps], "name string, x double, y double, tag string, rank int, type int")
    assert equipment.cell_sites(cells, sites, 75.0, 75.0 / 8).groupBy("cx", "cy").count().agg({"count": "max"}).first()[0] < 20  # of 600


def test_gravity_tasks_hold_each_point_once(spark, monkeypatch):
    """Connections of one place share the points around them: rows sent to tasks do not grow with the connections."""
    from wayloom.operators import paths
    from wayloom.settings import GRAVITY

    rng = random.Random(3)
    clusters = spark.createDataFrame([(i, 40.0 * (i % 6), 5.0 * (i // 6), 0.0) for i in range(24)], "id bigint, x double, y double, orientation double")
    points = spark.createDataFrame([(rng.uniform(0, 200), rng.uniform(-10, 30), rng.uniform(-20, 20)) for _ in range(400)], "x double, y double, orientation double")
    ends = [(a, b) for a in range(24) for b in range(24) if a % 6 < b % 6]
    seen = []
    whole = paths._Cells.__init__

    def counted(self, p):
        whole(self, p)
        seen.append(len(self.poses))

    got = {(r["src"], r["dst"]): r["path"] for r in paths.connect(spark.createDataFrame(ends, "src bigint, dst bigint"), clusters, Settings(), GRAVITY, points).collect()}
    assert set(got) == set(ends) and all(p[0] == s and p[-1] == d and len(set(p)) == len(p) for (s, d), p in got.items())
    pdf = points.toPandas().assign(id=0, cx=lambda f: f["x"] // 60, cy=lambda f: f["y"] // 60).astype({"cx": int, "cy": int}).sort_values(["cx", "cy"])
    monkeypatch.setattr(paths._Cells, "__init__", counted)
    box, ids = paths._Cells(pdf).box(0, 1, -1, 0)
    assert seen == [400] and len(box) == len(ids) == ((pdf["cx"] <= 1) & (pdf["cy"] <= 0)).sum()


def test_leader_groups_come_in_parts_of_batches():
    import pandas as pd

    from wayloom.operators import cluster

    batches = [pd.DataFrame({"g": g, "k": k}) for g, k in (([1, 1], [1, 2]), ([1, 2], [3, 4]), ([], []), ([2], [5]), ([3, 4], [6, 7]))]
    assert [[k for b in held for k in b["k"].tolist()] for held in cluster._by_group(iter(batches))] == [[1, 2, 3], [4, 5], [6], [7]]


def test_the_map_founds_its_clusters_by_leaders(spark, small, monkeypatch):
    import pytest

    from wayloom.operators import cluster
    from wayloom.plans.base import World

    class Founded(Exception):
        pass

    def found(points, settings):
        raise Founded

    monkeypatch.setattr(cluster, "leader_clusters", found)
    with pytest.raises(Founded):
        queries._map(World(spark, small))


def test_components_of_small_and_large_graphs_agree(spark):
    from wayloom.operators import graph

    rng = random.Random(2)
    rows = [(rng.randrange(90), rng.randrange(90)) for _ in range(70)]
    for named in (lambda v: v, lambda v: f"v{v:03d}"):
        edges = spark.createDataFrame([(named(a), named(b)) for a, b in [*rows, (100, 100)]], "a string, b string" if named(1) == "v001" else "a bigint, b bigint")
        one, many = ({r["node"]: r["label"] for r in graph.components(edges, small=n).collect()} for n in (1 << 20, 1))
        assert one == many and len(one) > 50
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0

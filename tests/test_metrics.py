import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayloom.functions.metrics import center_angle, circular_mean, distance, dubins_length, point, reversing
from wayloom.operators.paths import dubins, intermediate_ok, search
from wayloom.settings import CHORD, DUBINS, Settings


def test_center_angle(spark):
    rows = spark.createDataFrame([(-180.0, -180.0), (180.0, -180.0), (540.0, -180.0), (-190.0, 170.0), (0.0, 0.0), (359.0, -1.0)], "a double, want double")
    assert all(r["got"] == r["want"] for r in rows.withColumn("got", center_angle(F.col("a"))).collect())


@pytest.mark.parametrize(
    ("speeds", "headings", "to", "want"),
    [((0, 0), (0, 0), (1, 0), False), ((0, -1), (0, 0), (1, 0), True), ((1, -1), (0, 180), (1, 0), False), ((1, -1), (180, 0), (1, 0), True), ((1, -2), (0, 0), (1, 0), True), ((2, -1), (0, 0), (1, 0), False)],
)
def test_reversing(spark, speeds, headings, to, want):
    row = spark.createDataFrame([(0.0, 0.0, float(headings[0]), float(speeds[0]), float(to[0]), float(to[1]), float(headings[1]), float(speeds[1]))], "a_x double, a_y double, a_orientation double, a_speed double, b_x double, b_y double, b_orientation double, b_speed double")
    assert row.select(reversing(point("a_"), point("b_")).alias("r")).first()["r"] is want


def test_dubins_column_matches_numpy_and_bounds(spark):
    rng = random.Random(3)
    rows = [tuple(rng.uniform(-50, 50) if i % 3 != 2 else rng.uniform(-180, 180) for i in range(6)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a_x double, a_y double, a_orientation double, b_x double, b_y double, b_orientation double")
    got = df.select("*", dubins_length(point("a_"), point("b_"), 10.0).alias("d")).collect()
    for r in got:
        a, b = np.array(r[:3]), np.array(r[3:6])
        assert r["d"] == pytest.approx(float(dubins(a, b, 10.0)), abs=1e-6)
        assert r["d"] >= math.hypot(b[0] - a[0], b[1] - a[1]) - 1e-9
        back = float(dubins(np.array([*b[:2], b[2] + 180]), np.array([*a[:2], a[2] + 180]), 10.0))
        assert r["d"] == pytest.approx(back, abs=1e-6)


def test_distance_wraps(spark):
    df = spark.createDataFrame([(0.0, 0.0, 179.0, 3.0, 0.0, -179.0)], "a_x double, a_y double, a_orientation double, b_x double, b_y double, b_orientation double")
    assert df.select(distance(point("a_"), point("b_")).alias("d")).first()["d"] == pytest.approx(math.sqrt(13))


def test_circular_mean(spark):
    df = spark.createDataFrame([(170.0,), (-170.0,)], "h double")
    assert abs(abs(df.agg(circular_mean("h").alias("m")).first()["m"]) - 180) < 1e-9


def brute(poses, method, s):
    """All simple paths."""
    import itertools

    n = len(poses)
    best = None
    for k in range(n - 1):
        for mid in itertools.permutations(range(1, n - 1), k):
            p = [0, *mid, n - 1]
            step = (lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) if method == CHORD else (lambda a, b: float(dubins(a, b, s.dubins_turning_radius)) ** 2)
            c = sum(step(poses[a], poses[b]) for a, b in zip(p, p[1:], strict=False))
            if best is None or c < best[0] - 1e-9:
                best = (c, p)
    return best


def test_search_is_least(spark):
    rng = np.random.default_rng(5)
    s = Settings()
    for _ in range(20):
        mid = np.column_stack([rng.uniform(5, 95, 4), rng.uniform(-20, 20, 4), rng.uniform(-20, 20, 4)])
        poses = np.vstack([[0, 0, 0], mid, [100, 0, 0]])
        c, p = brute(poses, DUBINS, s)
        got = search(poses, s, DUBINS)
        assert got[0] == 0 and got[-1] == 5
        assert sum(float(dubins(poses[a], poses[b], 10.0)) ** 2 for a, b in zip(got, got[1:], strict=False)) == pytest.approx(c)


def test_chord_search_is_least_and_closes_what_does_not_fit():
    """Where every pose fits, the way of least squared chords; a pose that heads elsewhere is closed when it is reached, so no way leads on from it."""
    rng = np.random.default_rng(8)
    s = Settings()
    for _ in range(20):
        mid = np.column_stack([rng.uniform(5, 60, 4), rng.uniform(-3, 3, 4), rng.uniform(-10, 10, 4)])
        poses = np.vstack([[0, 0, 0], mid, [100, 0, 0]])
        assert all(intermediate_ok(a, poses[-1], b, s.angular_threshold) for a in poses[:-1] for b in mid)
        assert search(poses, s, CHORD) == brute(poses, CHORD, s)[1]
        poses[2, 2] = 150.0
        assert search(poses, s, CHORD) == [i if i < 2 else i + 1 for i in brute(np.delete(poses, 2, axis=0), CHORD, s)[1]]

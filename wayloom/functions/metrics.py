"""Distances, headings and driving direction as columns. A point is a dict-like of columns x, y, orientation, speed."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = Callable[[str], Column]


def point(prefix: str = "", suffix: str = "") -> Point:
    """The columns of a point whose names have a prefix or suffix."""
    return lambda name: F.col(f"{prefix}{name}{suffix}")


def center_angle(a: Column) -> Column:
    """The angle in [-180, 180)."""
    return a - F.lit(360.0) * F.floor((a + F.lit(180.0)) / F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """The least absolute difference of two headings."""
    return F.abs(center_angle(a - b))


def distance2d(a: Point, b: Point) -> Column:
    dx, dy = b("x") - a("x"), b("y") - a("y")
    return F.sqrt(dx * dx + dy * dy)


def distance(a: Point, b: Point, angular_weight: float = 1.0) -> Column:
    """Plane distance and weighted difference of headings together."""
    dx, dy = b("x") - a("x"), b("y") - a("y")
    t = F.lit(angular_weight) * center_angle(b("orientation") - a("orientation"))
    return F.sqrt(dx * dx + dy * dy + t * t)


def bearing(a: Point, b: Point) -> Column:
    """Direction from a to b, counter-clockwise from East."""
    return F.degrees(F.atan2(b("y") - a("y"), b("x") - a("x")))


def reversing(a: Point, b: Point) -> Column:
    """Whether the vehicle drove backwards from a to b: by the speeds' signs, else by headings against the bearing, else by the mean speed."""
    sa, sb = a("speed"), b("speed")
    ra, rb = center_angle(bearing(a, b) - a("orientation")), center_angle(bearing(a, b) - b("orientation"))
    ahead = lambda r: (r >= -90) & (r <= 90)
    behind = lambda r: (r <= -90) | (r >= 90)
    return (
        F.when((sa >= 0) & (sb >= 0), False)
        .when((sa <= 0) & (sb <= 0), True)
        .when(ahead(ra) & behind(rb), False)
        .when(behind(ra) & ahead(rb), True)
        .otherwise(sa + sb < 0)
    )


def dubins_length(a: Point, b: Point, radius: float) -> Column:
    """The shortest path of bounded curvature between two poses: the least of the six words of circle arcs and straights."""
    two_pi = F.lit(2 * math.pi)
    mod = lambda t: t - two_pi * F.floor(t / two_pi)
    dx, dy = b("x") - a("x"), b("y") - a("y")
    d = F.sqrt(dx * dx + dy * dy) / F.lit(radius)
    phi = F.atan2(dy, dx)
    p, q = mod(F.radians(a("orientation")) - phi), mod(F.radians(b("orientation")) - phi)
    sa, sb, ca, cb, c = F.sin(p), F.sin(q), F.cos(p), F.cos(q), F.cos(p - q)
    none = F.lit(None).cast("double")
    root = lambda s: F.when(s >= 0, F.sqrt(s))

    s = root(2 + d * d - 2 * c + 2 * d * (sa - sb))
    t = F.atan2(cb - ca, d + sa - sb)
    lsl = mod(t - p) + s + mod(q - t)
    s = root(2 + d * d - 2 * c + 2 * d * (sb - sa))
    t = F.atan2(ca - cb, d - sa + sb)
    rsr = mod(p - t) + s + mod(t - q)
    s = root(-2 + d * d + 2 * c + 2 * d * (sa + sb))
    t = F.atan2(-ca - cb, d + sa + sb) - F.atan2(F.lit(-2.0), s)
    lsr = mod(t - p) + s + mod(t - q)
    s = root(-2 + d * d + 2 * c - 2 * d * (sa + sb))
    t = F.atan2(ca + cb, d - sa - sb) - F.atan2(F.lit(2.0), s)
    rsl = mod(p - t) + s + mod(q - t)
    k = (6 - d * d + 2 * c + 2 * d * (sa - sb)) / 8
    m = F.when(F.abs(k) <= 1, mod(two_pi - F.acos(k)))
    t = mod(p - F.atan2(ca - cb, d - sa + sb) + m / 2)
    rlr = t + m + mod(p - q - t + m)
    k = (6 - d * d + 2 * c + 2 * d * (sb - sa)) / 8
    m = F.when(F.abs(k) <= 1, mod(two_pi - F.acos(k)))
    t = mod(-p - F.atan2(ca - cb, d + sa - sb) + m / 2)
    lrl = t + m + mod(mod(q) - p - t + m)
    return F.least(lsl, rsr, lsr, rsl, rlr, lrl, none) * F.lit(radius)


def circular_mean(angle: str) -> Column:
    """The mean heading of a group."""
    return center_angle(F.degrees(F.atan2(F.sum(F.sin(F.radians(angle))), F.sum(F.cos(F.radians(angle))))))

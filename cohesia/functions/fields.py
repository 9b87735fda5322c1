"""Column expressions on vertex and edge fields."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.joins import clip


def r4(col, digits: int = 4) -> Column:
    """Rounded double with a single zero (no -0.0), for value comparison."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def ramp(x: Column, lo: float = 1.0, hi: float = 1.32) -> Column:
    if hi <= lo:
        raise ValueError("ramp needs hi > lo")
    return clip((x - F.lit(lo)) / F.lit(hi - lo), 0.0, 1.0)


def grid_region(u: Column, v: Column, na: int = 3, nb: int = 3) -> Column:
    top = 1.0 - 1e-12
    a = F.floor(clip(u, 0.0, top) * na)
    b = F.floor(clip(v, 0.0, top) * nb)
    return (b * na + a).cast("long")


def field_bin(x: Column, n: int) -> Column:
    """1-based equal-width bin on [0,1]; values are truncated, then clamped."""
    return (clip(F.floor(x * n), 0, n - 1) + 1).cast("long")


def bin_centre(b: Column, n: int) -> Column:
    return (b - F.lit(0.5)) / F.lit(float(n))


def scale(cols: list[str], k: float) -> list[Column]:
    return [(F.col(c) * F.lit(k)).alias(c) for c in cols]


def spherical_chart(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """(azimuth, polar angle) of a unit-sphere point, both scaled to [0,1]."""
    alpha = (F.atan2(y, x) + F.lit(math.pi)) / F.lit(2 * math.pi)
    beta = F.acos(clip(z, -1.0, 1.0)) / F.lit(math.pi)
    return alpha, beta


def unit3(x: Column, y: Column, z: Column, fallback=(1.0, 0.0, 0.0), floor: float = 1e-12) -> list[Column]:
    n = F.sqrt(x * x + y * y + z * z)
    ok = n > F.lit(floor)
    return [F.when(ok, c / n).otherwise(F.lit(f)) for c, f in zip((x, y, z), fallback)]


def cross3(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def dot3(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def relative_error(estimate: Column, exact: Column, floor: float = 1e-12) -> Column:
    return F.when(F.abs(exact) >= F.lit(floor), F.abs(estimate - exact) / F.abs(exact))


def radius_for_degree(n: Column, dim: int, degree: float) -> Column:
    """Radius whose d-ball holds `degree` of n unit-cube points on average."""
    ball = math.pi ** (dim / 2) / math.gamma(dim / 2 + 1)
    return F.pow(F.lit(degree) / (n * F.lit(ball)), F.lit(1.0 / dim))

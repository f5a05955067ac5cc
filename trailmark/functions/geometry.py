"""Column functions for angles, positions and unit quaternions (x, y, z, w)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_degrees(a: Column) -> Column:
    """To [-180, 180)."""
    return a - 360 * F.floor((a + 180) / 360)


def separation_degrees(a: Column, b: Column) -> Column:
    return F.abs(wrap_degrees(a - b))


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) ** 2 for x, y in zip(a[1:], b[1:], strict=True)), (a[0] - b[0]) ** 2))


def yaw_degrees(x: Column, y: Column, z: Column, w: Column) -> Column:
    return F.degrees(F.atan2(2 * (w * y + x * z), 1 - 2 * (y * y + z * z)))


def rotation_matrix(x: Column, y: Column, z: Column, w: Column) -> Column:
    """Rows of the rotation, flat."""
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    )


def rotation_error_degrees(p: list[Column], q: list[Column]) -> Column:
    """Angle between two rotations."""
    dot = F.abs(sum((a * b for a, b in zip(p[1:], q[1:], strict=True)), p[0] * q[0]))
    return F.degrees(2 * F.acos(F.least(dot, F.lit(1.0))))


def heading_quaternion(h: Column) -> Column:
    return F.array(F.lit(0.0), F.sin(h / 2), F.lit(0.0), F.cos(h / 2))


def bearing_degrees(x: Column, z: Column, heading: Column) -> Column:
    """Bearing of (x, z) seen under a heading, in [-180, 180)."""
    return wrap_degrees(F.degrees(F.atan2(-x, -z)) - heading)


def panorama_pixel(bearing: Column, pitch: Column, width: int, height: int) -> tuple[Column, Column]:
    """(column, row) of a direction in an equirectangular image."""
    col = F.pmod(F.bround((bearing + 180) / 360 * width).cast("int"), F.lit(width))
    row = F.least(F.greatest(F.bround((90 - pitch) / 180 * height).cast("int"), F.lit(0)), F.lit(height - 1))
    return col, row


def lonlat_to_xyz(lon: Column, lat: Column) -> Column:
    return F.array(F.cos(lat) * F.sin(lon), F.sin(lat), F.cos(lat) * F.cos(lon))


def bucket(v: Column, bounds: tuple[float, ...]) -> Column:
    """Number of bounds that are not above the value."""
    return sum((F.when(v >= b, 1).otherwise(0) for b in bounds[1:]), F.when(v >= bounds[0], 1).otherwise(0))


def clamp(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def to_grid(v: Column, low: float, size: float) -> Column:
    """Cell of a coordinate; truncates toward zero."""
    return ((v - low) / size).cast("int")


def neg_log_softmax(logits: Column, i: Column) -> Column:
    """-log softmax of entry ``i`` (from 0), shifted by the maximum."""
    m = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, v: s + F.exp(v - m))
    return F.ln(total) + m - F.get(logits, i)


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def zero_unless_finite(v: Column) -> Column:
    return F.when(finite(v), v).otherwise(0.0)

"""Column functions for cameras, poses and images given as arrays (row by row, values 0..255)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def project(x: Column, y: Column, z: Column, focal: float, cx: float, cy: float) -> Column:
    """M9: pinhole pixel (u, v) of a point in front of the camera, which looks along -z; null behind it."""
    return F.when(z < 0, F.array(cx + focal * x / -z, cy - focal * y / -z))


def unproject(u: Column, v: Column, depth: Column, focal: float, cx: float, cy: float) -> Column:
    """M9: the point at a pixel and depth."""
    return F.array((u - cx) * depth / focal, (cy - v) * depth / focal, -depth)


def quaternion_of_matrix(m: Column) -> Column:
    """Unit quaternion (x, y, z, w), w >= 0, of a flat rotation matrix; the largest part is solved for first."""
    a, b, c, d, e, f, g, h, i = (m[k] for k in range(9))
    r = lambda t: F.sqrt(F.greatest(t, F.lit(0.0))) * 2
    w, x, y, z = r(1 + a + e + i), r(1 + a - e - i), r(1 - a + e - i), r(1 - a - e + i)
    q = (
        F.when(a + e + i > 0, F.array((h - f) / w, (c - g) / w, (d - b) / w, w / 4))
        .when((a >= e) & (a >= i), F.array(x / 4, (b + d) / x, (c + g) / x, (h - f) / x))
        .when(e >= i, F.array((b + d) / y, y / 4, (f + h) / y, (c - g) / y))
        .otherwise(F.array((c + g) / z, (f + h) / z, z / 4, (d - b) / z))
    )
    return F.when(F.get(q, F.lit(3)) < 0, F.transform(q, lambda v: -v)).otherwise(q)


def angle_axis_matrix(angle: Column, x: Column, y: Column, z: Column) -> Column:
    """Flat rotation matrix of an angle (radians) about a unit axis."""
    s, c = F.sin(angle), F.cos(angle)
    k = 1 - c
    return F.array(c + x * x * k, x * y * k - z * s, x * z * k + y * s, y * x * k + z * s, c + y * y * k, y * z * k - x * s, z * x * k - y * s, z * y * k + x * s, c + z * z * k)


def rigid_inverse(m: Column, t: Column) -> tuple[Column, Column]:
    """Rotation and translation of the inverse of x -> m x + t."""
    turned = F.array(*(m[k] for k in (0, 3, 6, 1, 4, 7, 2, 5, 8)))
    moved = F.array(*(-(m[k] * t[0] + m[k + 3] * t[1] + m[k + 6] * t[2]) for k in range(3)))
    return turned, moved


def homogeneous(p: Column) -> Column:
    return F.concat(p, F.array(F.lit(1.0)))


def latitude_rows(height: int, low: Column, high: Column) -> tuple[Column, Column]:
    """First row and number of rows of an equirectangular image between two latitudes in degrees."""
    first = F.floor((90 - high) / 180 * height)
    return first.cast("int"), (F.ceil((90 - low) / 180 * height) - first).cast("int")


def visible_share(depths: Column, expected: Column, tolerance: float) -> Column:
    """M6: share of a patch's finite depths that are not nearer than expected by more than the tolerance; 0 for no depth."""
    good = F.filter(depths, lambda d: d.isNotNull() & ~F.isnan(d) & (d > 0))
    seen = F.filter(good, lambda d: d >= expected - tolerance)
    return F.when(F.size(good) > 0, F.size(seen) / F.size(good)).otherwise(0.0)


def dark_shares(pixels: Column, width: int, height: int, threshold: int) -> dict[str, Column]:
    """Shares of dark values in the whole image and in its top and bottom fifth."""
    dark = lambda part: F.aggregate(part, F.lit(0), lambda s, v: s + (v < threshold).cast("int")) / F.greatest(F.size(part), F.lit(1))
    band = max(1, height // 5) * width
    return {"dark": dark(pixels), "top": dark(F.slice(pixels, F.lit(1), F.lit(band))), "bottom": dark(F.slice(pixels, F.size(pixels) - band + 1, F.lit(band)))}


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two images."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def pixel_grid(width: int, height: int) -> Column:
    """array<struct<x,y>> of all pixels, row by row."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.struct(x.alias("x"), y.alias("y")))))


def cap_true(mask: Column, most: int, *seed: Column) -> Column:
    """A boolean array with at most ``most`` of its true entries, those of least hash, left true."""
    marked = F.transform(mask, lambda m, i: F.when(m, F.xxhash64(i, *seed)))
    cut = F.get(F.array_sort(F.filter(marked, lambda h: h.isNotNull())), F.lit(most - 1))
    return F.transform(marked, lambda h: h.isNotNull() & (cut.isNull() | (h <= cut)))


def level(v: Column) -> Column:
    """The gray level that stands for a component of a vector: 400 times its size in single precision, half to even.

    With an integer as factor Spark would multiply in double precision, which puts some products on the other side of a half.
    """
    return F.bround(F.abs(v) * F.lit(400).cast("float")).cast("int")

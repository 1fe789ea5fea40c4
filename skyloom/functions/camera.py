"""Pinhole cameras and similarity transforms.

Rotations are arrays of rows, vectors are arrays of three doubles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Camera models with one focal length.
ONE_FOCAL = ("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL", "SIMPLE_RADIAL_FISHEYE")


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def rows(matrix: Column) -> list[list[Column]]:
    return [[matrix[i][j] for j in range(3)] for i in range(3)]


def intrinsics(model: Column, params: Column) -> Column:
    """struct(fx, fy, cx, cy) of a camera model's parameters; distortion is dropped.

    Unknown models with four parameters or more are read as two focal lengths,
    with fewer they are an error.
    """
    name, n = F.upper(model), F.size(params)
    one = F.struct(params[0].alias("fx"), params[0].alias("fy"), params[1].alias("cx"), params[2].alias("cy"))
    two = F.struct(params[0].alias("fx"), params[1].alias("fy"), params[2].alias("cx"), params[3].alias("cy"))
    wrong = F.raise_error(F.concat(F.lit("unsupported camera model: "), model)).cast("struct<fx:double,fy:double,cx:double,cy:double>")
    return F.when(name.isin(*ONE_FOCAL) & (n >= 3), one).when(n >= 4, two).otherwise(wrong)


def project_point(k: Column, rotation: Column, center: Column, xyz: Sequence[Column]) -> Column:
    """struct(u, v, z) of a world point; u and v are null where z is zero."""
    r = rows(rotation)
    moved = [p - center[i] for i, p in enumerate(xyz)]
    x, y, z = (dot(r[i], moved) for i in range(3))
    u = F.try_divide(k["fx"] * x, z) + k["cx"]
    v = F.try_divide(k["fy"] * y, z) + k["cy"]
    return F.struct(u.alias("u"), v.alias("v"), z.alias("z"))


def pixel(value: Column) -> Column:
    """Nearest pixel, halves to even."""
    return F.rint(value).cast("long")


def visible(u: Column, v: Column, z: Column, width: Column, height: Column) -> Column:
    return (z > 0) & pixel(u).between(0, width - 1) & pixel(v).between(0, height - 1)


def back_project(u: Column, v: Column, depth: Column, k: Column, rotation: Column, center: Column) -> list[Column]:
    """World point of a pixel at a depth along the optical axis."""
    cam = [(u - k["cx"]) / k["fx"] * depth, (v - k["cy"]) / k["fy"] * depth, depth]
    r = rows(rotation)
    return [dot([r[j][i] for j in range(3)], cam) + center[i] for i in range(3)]


def clip_depth(depth: Column, xyz: Sequence[Column], lower: Sequence[Column], upper: Sequence[Column]) -> Column:
    """depth where it is positive and its point lies in the half-open box, else 0."""
    keep = depth > 0
    for p, lo, hi in zip(xyz, lower, upper, strict=True):
        keep = keep & (p >= lo) & (p < hi)
    return F.when(keep, depth).otherwise(F.lit(0.0))


def similarity_apply(sim: Column, xyz: Sequence[Column]) -> list[Column]:
    """scale * R * p + t for sim = struct(scale, rotation, translation)."""
    r = rows(sim["rotation"])
    return [sim["scale"] * dot(r[i], list(xyz)) + sim["translation"][i] for i in range(3)]


def similarity_matrix(sim: Column) -> Column:
    """4 x 4 matrix of a similarity."""
    r = rows(sim["rotation"])
    upper = [F.array(*(sim["scale"] * r[i][j] for j in range(3)), sim["translation"][i]) for i in range(3)]
    return F.array(*upper, F.array(*(F.lit(x) for x in (0.0, 0.0, 0.0, 1.0))))


def translation_of(rotation: Column, center: Column) -> Column:
    """t = -R c"""
    return F.array(*(-dot(r, [center[j] for j in range(3)]) for r in rows(rotation)))


def center_of(rotation: Column, translation: Column) -> Column:
    """c = -R^T t"""
    r = rows(rotation)
    return F.array(*(-dot([r[j][i] for j in range(3)], [translation[j] for j in range(3)]) for i in range(3)))


def rotate_into(rotation: Column, alignment: Column) -> Column:
    """R A^T: an extrinsic rotation seen from the aligned frame."""
    a, b = rows(rotation), rows(alignment)
    return F.array(*(F.array(*(dot(a[i], b[j]) for j in range(3))) for i in range(3)))


def depth_value(a: Column, b: Column, relative: Column, masked: Column) -> Column:
    """Metric depth a * relative + b; 0 where it is not positive or masked."""
    value = a * relative + b
    return F.when(masked | (value <= 0) | value.isNull(), F.lit(0.0)).otherwise(value)

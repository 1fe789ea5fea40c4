"""Views: poses joined to keyframes, masks, depth and rasters, by the image's name.

A raster of a view is a table of pixels (name, u, v, value), so its look-ups
are equi-joins and its size is no matter of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.camera import back_project, clip_depth, depth_value
from ..functions.scalar import basename


def keyframe_poses(poses: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Poses with their keyframe's columns; keyframes without a position are dropped, and a missing altitude is 0."""
    known = keyframes.where("lat is not null and lon is not null").withColumn("name", basename(F.col("path"))).withColumn("alt", F.coalesce("alt", F.lit(0.0)))
    return poses.join(known, "name")


def masked_views(poses: DataFrame, keyframes: DataFrame, masks: DataFrame, index: str = "index") -> DataFrame:
    """Poses with their keyframe's columns, and those of the mask with the keyframe's index, or nulls; masked tells which."""
    named = keyframes.withColumn("name", basename(F.col("path")))
    return poses.join(named, "name").join(masks.withColumn("masked", F.lit(True)), index, "left").withColumn("masked", F.coalesce("masked", F.lit(False)))


def dense_views(poses: DataFrame, keyframes: DataFrame, depths: DataFrame, index: str = "index") -> DataFrame:
    """Poses with a keyframe and a depth raster: their columns together; a view that lacks either is dropped."""
    return poses.join(keyframes.withColumn("name", basename(F.col("path"))), "name").join(depths, index)


def raster_lookup(seen: DataFrame, raster: DataFrame, value: str) -> DataFrame:
    """seen (name, col, row, ...) with the raster's value (name, u, v, value) at its pixel; pixels without one are dropped."""
    pixels = raster.select("name", F.col("u").cast("long").alias("col"), F.col("v").cast("long").alias("row"), value)
    return seen.join(pixels, ["name", "col", "row"])


def metric_depth(relative: DataFrame, fits: DataFrame, masks: DataFrame) -> DataFrame:
    """(name, u, v, depth, and what else relative has): relative depth by each view's line (name, a, b); 0 where it is not positive or masked.

    Views without a line, or whose line is not to be trusted (``metric`` is false), stay relative.
    """
    covered = masks.select("name", "u", "v").distinct().withColumn("__masked", F.lit(True))
    trusted = fits.where("metric") if "metric" in fits.columns else fits
    lines = trusted.select("name", F.col("a").alias("__a"), F.col("b").alias("__b"))
    met = relative.join(lines, "name", "left").join(covered, ["name", "u", "v"], "left")
    value = depth_value(F.coalesce("__a", F.lit(1.0)), F.coalesce("__b", F.lit(0.0)), F.col("rel"), F.coalesce("__masked", F.lit(False)))
    return met.select("name", "u", "v", value.alias("depth"), *(c for c in relative.columns if c not in ("name", "u", "v", "rel", "depth")))


def world_points(depth: DataFrame, views: DataFrame, lower: list[Column | float] | None = None, upper: list[Column | float] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(name, x, y, z, cx, cy, cz, and what else depth has): points of positive depth, within a half-open box if given.

    depth: name, u, v, depth; views: name, k, rotation, center; both by the keys, if there are any.
    """
    met = depth.join(views.select(*keys, "name", "k", "rotation", "center"), [*keys, "name"])
    xyz = back_project(F.col("u").cast("double"), F.col("v").cast("double"), F.col("depth"), F.col("k"), F.col("rotation"), F.col("center"))
    placed = met.select("name", *(p.alias(c) for p, c in zip(xyz, "xyz", strict=True)), *(F.get("center", F.lit(i)).alias(f"c{c}") for i, c in enumerate("xyz")), *(c for c in depth.columns if c != "name"))
    if lower is not None and upper is not None:
        side = lambda v: v if isinstance(v, Column) else F.lit(float(v))
        placed = placed.withColumn("depth", clip_depth(F.col("depth"), [F.col(c) for c in "xyz"], [side(v) for v in lower], [side(v) for v in upper]))
    return placed.where("depth > 0")


def registration(keyframes: DataFrame, poses: DataFrame, run: str) -> DataFrame:
    """(run, n_keyframes, n_registered, rate): keyframes whose image got a pose."""
    got = poses.select("name").distinct().withColumn("__got", F.lit(1))
    named = keyframes.withColumn("name", basename(F.col("path"))).join(got, "name", "left")
    return named.groupBy(run).agg(F.count(F.lit(1)).alias("n_keyframes"), F.count("__got").alias("n_registered"), (F.count("__got") / F.count(F.lit(1))).alias("rate"))


def local_frame(points: DataFrame, columns: tuple[str, ...] = ("x", "y", "z")) -> tuple[DataFrame, DataFrame]:
    """(points less their mean, one row with the mean)."""
    mean = points.agg(*(F.avg(c).alias(f"__{c}") for c in columns))
    moved = points.crossJoin(F.broadcast(mean))
    return moved.select(*(c for c in points.columns if c not in columns), *((F.col(c) - F.col(f"__{c}")).alias(c) for c in columns)), mean.select(*(F.col(f"__{c}").alias(c) for c in columns))


def from_local_frame(points: DataFrame, mean: DataFrame) -> DataFrame:
    """The inverse of ``local_frame``."""
    own = mean.select(*(F.col(c).alias(f"__{c}") for c in mean.columns))
    return points.crossJoin(F.broadcast(own)).select(*(c for c in points.columns if c not in mean.columns), *((F.col(c) + F.col(f"__{c}")).alias(c) for c in mean.columns))

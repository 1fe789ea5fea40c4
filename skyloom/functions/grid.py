"""Raster grids: north-up, row 0 at the top."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grid_shape(extent: Column, resolution: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(extent / F.lit(float(resolution)))).cast("int")


def cell_column(x: Column, x_min: Column, resolution: float) -> Column:
    return F.floor((x - x_min) / F.lit(float(resolution))).cast("int")


def cell_row(y: Column, y_max: Column, resolution: float) -> Column:
    return F.floor((y_max - y) / F.lit(float(resolution))).cast("int")


def in_grid(row: Column, column: Column, height: Column, width: Column) -> Column:
    """Points on the far edges fall out where the extent is a multiple of the resolution."""
    return (row >= 0) & (row < height) & (column >= 0) & (column < width)


def meshing_voxel(extent: Column, depth: int, dense_voxel: Column, override: Column, margin: float = 1.1) -> Column:
    """Voxel for meshing: the override if positive, else the octree's leaf, but no finer than the dense cloud."""
    leaf = extent * F.lit(margin) / F.lit(float(2**depth))
    return F.when(override > 0, override).otherwise(F.greatest(leaf, dense_voxel))

"""Rasters as sparse tables (row, col, value): surface, colour and ground grids, voxels."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import cell_column, cell_row, in_grid
from ..functions.scalar import to_byte


@dataclass(frozen=True)
class Extent:
    x_min: float
    y_min: float
    x_max: float
    y_max: float
    resolution: float

    @property
    def width(self) -> int:
        return max(1, -int(-(self.x_max - self.x_min) // self.resolution))

    @property
    def height(self) -> int:
        return max(1, -int(-(self.y_max - self.y_min) // self.resolution))


def finite(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return out


def bounds(points: DataFrame) -> DataFrame:
    """One row: count, and smallest and largest x, y, z by one scan of the three columns."""
    return points.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def extent_of(points: DataFrame, resolution: float) -> Extent:
    """Bounds to the driver: four numbers.  A cloud without points is an error."""
    r = bounds(points.where(finite("x", "y", "z"))).first()
    if r["n"] == 0:
        raise ValueError("no points to grid")
    return Extent(r["x_min"], r["y_min"], r["x_max"], r["y_max"], resolution)


def cells(points: DataFrame, extent: Extent) -> DataFrame:
    row = cell_row(F.col("y"), F.lit(extent.y_max), extent.resolution)
    col = cell_column(F.col("x"), F.lit(extent.x_min), extent.resolution)
    placed = points.withColumn("row", row).withColumn("col", col)
    return placed.where(in_grid(F.col("row"), F.col("col"), F.lit(extent.height), F.lit(extent.width)))


def elevation_grid(points: DataFrame, extent: Extent, agg: str = "max") -> DataFrame:
    """(row, col, z, n): the largest, smallest or mean z of each cell with points.

    Partial aggregation makes a cell one row per task before the shuffle,
    however many points it has.
    """
    how = {"max": F.max, "min": F.min, "mean": F.avg}
    if agg not in how:
        raise ValueError(f"unknown aggregate: {agg}")
    return cells(points.where(finite("x", "y", "z")), extent).groupBy("row", "col").agg(how[agg]("z").alias("z"), F.count(F.lit(1)).alias("n"))


def ortho_grid(points: DataFrame, extent: Extent, scale: Column | float = 1.0) -> DataFrame:
    """(row, col, r, g, b): mean colour of each cell, cut off to whole numbers."""
    scale = F.lit(scale) if isinstance(scale, float) else scale
    means = [to_byte(F.sum(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col(c) * scale)).cast("double")) / F.count(c)).alias(c) for c in "rgb"]
    return cells(points.where(finite("x", "y")), extent).groupBy("row", "col").agg(*means)


def coverage(grid: DataFrame, extent: Extent) -> DataFrame:
    """One row: the share of cells that have points."""
    return grid.agg((F.count(F.lit(1)) / F.lit(float(extent.width * extent.height))).alias("coverage"))


def dense(grid: DataFrame, extent: Extent, value: str = "z") -> DataFrame:
    """Every cell of the raster; empty ones have null."""
    spark = grid.sparkSession
    every = spark.range(extent.height * extent.width).select(F.expr(f"cast(id div {extent.width} as int)").alias("row"), F.expr(f"cast(id % {extent.width} as int)").alias("col"))
    return every.join(grid.select("row", "col", value), ["row", "col"], "left")


def opening(grid: DataFrame, extent: Extent, window: int, value: str = "z") -> DataFrame:
    """Morphological opening, (row, col, dtm): k x k minimum, then k x k maximum.

    Empty cells count as the grid's maximum.  Frames end at the raster's
    edge, which equals padding with the edge's value.  An even window reaches
    one further back than ahead, in both passes.  The passes are separable,
    so each cell meets 4k others and not k squared.
    """
    top = grid.agg(F.max(value).alias("__top"))
    out = dense(grid, extent, value).crossJoin(F.broadcast(top)).select("row", "col", F.coalesce(value, "__top").alias("dtm"))
    if window <= 1:
        return out
    back, ahead = window // 2, window - 1 - window // 2
    for how in (F.min, F.max):
        for along, across in (("col", "row"), ("row", "col")):
            out = out.withColumn("dtm", how("dtm").over(Window.partitionBy(across).orderBy(along).rangeBetween(-back, ahead)))
    return out


#: Values that a bracket may still hold when it is settled by sorting them.
FEW = 10_000


def percentiles(df: DataFrame, column: str, shares: list[float], bins: int = 4096) -> list[float | None]:
    """Exact interpolated percentiles; nulls and NaN do not count.

    Counts of equal bins tell in which ones the wanted ranks lie, again and again within
    these, until they hold few values, which are then sorted; no task ever sees all values.
    A round looks at all brackets in one scan.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where(finite("v"))
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not n:
        return [None] * len(shares)
    ranks = sorted({r for s in shares for r in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))})
    found: dict[int, float] = {}
    open_: list[tuple[float, float, int, int, list[int]]] = [(low, high, 0, n, ranks)]  # first and last value, rows before, rows, ranks sought
    while open_:
        wide, narrow = [], []
        for lo, hi, before, rows, sought in open_:
            if lo == hi:
                found.update(dict.fromkeys(sought, lo))
            else:
                # Halved before they are subtracted: the difference of two finite numbers need not be one.
                step = (hi / 2 - lo / 2) / bins * 2
                (narrow if rows <= FEW or not lo + step > lo else wide).append((lo, hi, step, before, sought))
        open_ = []
        if narrow:
            inside = [F.col("v").between(lo, hi) for lo, hi, *_ in narrow]
            which = F.coalesce(*(F.when(c, F.lit(i)) for i, c in enumerate(inside)))
            got: dict[int, list[tuple[float, int]]] = {}
            # A bracket of many rows that is not wide holds neighbouring numbers only: few distinct ones.
            for r in values.withColumn("i", which).where("i is not null").groupBy("i", "v").count().orderBy("i", "v").collect():
                got.setdefault(r.i, []).append((r.v, r["count"]))
            for i, (_, _, _, before, sought) in enumerate(narrow):
                for v, rows in got[i]:
                    found.update({r: v for r in sought if before <= r < before + rows})
                    before += rows
        if wide:
            inside = [F.col("v").between(lo, hi) for lo, hi, *_ in wide]
            which = F.coalesce(*(F.when(c, F.lit(i)) for i, c in enumerate(inside)))
            at = F.coalesce(*(F.when(c, F.least(F.floor((F.col("v") / 2 - lo / 2) / (step / 2)), F.lit(bins - 1))) for c, (lo, _, step, *_) in zip(inside, wide, strict=True)))
            got = {}
            for r in values.withColumns({"i": which, "at": at}).where("i is not null").groupBy("i", "at").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("v").alias("n")).orderBy("i", "at").collect():  # at most a row for each bin
                got.setdefault(r.i, []).append((r.a, r.b, r.n))
            for i, (_, _, _, before, sought) in enumerate(wide):
                for a, b, rows in got[i]:
                    if own := [r for r in sought if before <= r < before + rows]:
                        open_.append((a, b, before, rows, own))
                    before += rows
    out = []
    for s in shares:
        place = s * (n - 1)
        a, b = found[math.floor(place)], found[math.ceil(place)]
        out.append(a if a == b else (math.ceil(place) - place) * a + (place - math.floor(place)) * b)
    return out


def z_band(points: DataFrame, margin: float, low: float = 1.0, high: float = 99.0) -> DataFrame:
    """One row: percentiles of the finite heights widened by the margin; without points all heights are allowed."""
    a, b = percentiles(points, "z", [low / 100, high / 100])
    return points.sparkSession.createDataFrame([(float("-inf") if a is None else a - margin, float("inf") if b is None else b + margin)], "z_lo double, z_hi double")


def clip_band(points: DataFrame, band: DataFrame) -> DataFrame:
    """Points of the half-open band."""
    return points.crossJoin(F.broadcast(band)).where((F.col("z") >= F.col("z_lo")) & (F.col("z") < F.col("z_hi"))).drop("z_lo", "z_hi")


def voxel_downsample(points: DataFrame, voxel: float, origin: tuple[float, float, float] | None = None, means: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Mean of each voxel: vx, vy, vz, the means, and n.  The grid starts half a voxel before the smallest point."""
    if origin is None:
        r = bounds(points).first()
        if r["n"] == 0:
            origin = (0.0, 0.0, 0.0)
        else:
            origin = tuple(r[f"{c}_min"] - voxel / 2 for c in "xyz")
    ids = [F.floor((F.col(c) - o) / F.lit(float(voxel))).alias(f"v{c}") for c, o in zip("xyz", origin, strict=True)]
    return points.groupBy(*ids).agg(*(F.avg(c).alias(c) for c in means), F.count(F.lit(1)).alias("n"))


def density_crop(vertices: DataFrame, quantile: float, density: str = "density") -> DataFrame:
    """Vertices whose density reaches the quantile."""
    (least,) = percentiles(vertices, density, [quantile])
    return vertices.where(F.col(density) >= F.lit(least))


def sample_grid(points: DataFrame, grid: DataFrame, extent: Extent, value: str = "z") -> DataFrame:
    """points with the raster's value at their cell; points off the raster or on empty cells are dropped."""
    placed = cells(points, extent)
    return placed.join(grid.select("row", "col", F.col(value).alias("grid_z")).where(finite("grid_z")), ["row", "col"])


def checkpoint_error(sampled: DataFrame, measured: str = "grid_z", truth: str = "alt") -> DataFrame:
    """One row: n, rmse, mae and bias of a raster at check-points."""
    e = F.col(measured) - F.col(truth)
    return sampled.agg(F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"))


def height_mesh(grid: DataFrame, extent: Extent, value: str = "z") -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of a height field: two triangles for each square of four cells with values.

    This triangulates a raster; ``poisson_mesh`` reconstructs the surface of a cloud.
    """
    vertex = (F.col("row") * extent.width + F.col("col")).cast("long")
    vertices = grid.select(vertex.alias("vertex"), (F.lit(extent.x_min) + (F.col("col") + 0.5) * extent.resolution).alias("x"), (F.lit(extent.y_max) - (F.col("row") + 0.5) * extent.resolution).alias("y"), F.col(value).alias("z"))
    known = grid.select("row", "col")
    corner = known
    for name, dr, dc in (("e", 0, 1), ("s", 1, 0), ("se", 1, 1)):
        other = known.select((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.lit(True).alias(name))
        corner = corner.join(other, ["row", "col"])
    at = lambda dr, dc: ((F.col("row") + dr) * extent.width + F.col("col") + dc).cast("long")
    faces = corner.select(F.explode(F.array(F.struct(at(0, 0).alias("a"), at(1, 0).alias("b"), at(0, 1).alias("c")), F.struct(at(0, 1).alias("a"), at(1, 0).alias("b"), at(1, 1).alias("c")))).alias("f"))
    return vertices, faces.select("f.*")

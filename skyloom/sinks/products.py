"""Data products: point clouds, rasters, and the accounting of what could be exported."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import color_scale, to_byte, widened_color
from ..operators.raster import Extent
from ..sources.ply import PlyDataSource

NODATA = -9999.0


def byte_colors(points: DataFrame) -> DataFrame:
    """points with colours as bytes; whether they are shares of 1 is told from the largest of all."""
    top = points.agg(F.max(F.greatest("r", "g", "b")).cast("double").alias("__top"))
    scaled = points.crossJoin(F.broadcast(top))
    return scaled.select(*(c for c in points.columns if c not in ("r", "g", "b")), *(to_byte(F.col(c) * color_scale(F.col("__top"))).alias(c) for c in "rgb"))


def las_colors(points: DataFrame) -> DataFrame:
    """points with 16-bit colours."""
    top = points.agg(F.max(F.greatest("r", "g", "b")).alias("__top"))
    return points.crossJoin(F.broadcast(top)).select(*(c for c in points.columns if c not in ("r", "g", "b")), *(widened_color(F.col(c), F.col("__top")).alias(c) for c in "rgb"))


def write_ply(points: DataFrame, path: str) -> None:
    """A binary file; colours that are shares of 1 become bytes."""
    points.sparkSession.dataSource.register(PlyDataSource)
    if all(c in points.columns for c in "rgb"):
        points = byte_colors(points)
    columns = [F.col(c).cast("double").alias(c) for c in "xyz"]
    colors = [F.col(c).cast("short").alias(c) if c in points.columns else F.lit(None).cast("short").alias(c) for c in "rgb"]
    points.select(*columns, *colors).write.format("ply").mode("append").save(path)


def read_ply(spark: SparkSession, path: str, chunk: int | None = None) -> DataFrame:
    spark.dataSource.register(PlyDataSource)
    reader = spark.read.format("ply")
    return (reader.option("chunk", chunk) if chunk else reader).load(path)


def write_raster(grid: DataFrame, extent: Extent, path: str, epsg: int | None = None) -> None:
    """A sparse raster as Parquet, partitioned by bands of rows, with its placement in every row group's constants."""
    meta = {"x_min": extent.x_min, "y_max": extent.y_max, "resolution": extent.resolution, "width": extent.width, "height": extent.height, "epsg": epsg}
    out = grid.withColumn("band", F.floor(F.col("row") / 1024).cast("int"))
    for k, v in meta.items():
        out = out.withColumn(k, F.lit(v))
    out.repartition("band").write.mode("overwrite").partitionBy("band").parquet(path)


def raster_array(grid: DataFrame, extent: Extent, value: str = "z", most: int = 100_000_000) -> np.ndarray:
    """A raster as one array for small products; larger ones than ``most`` cells are an error."""
    if extent.width * extent.height > most:
        raise ValueError("raster too large for one array")
    out = np.full((extent.height, extent.width), NODATA, dtype=np.float32)
    for r in grid.select("row", "col", value).toLocalIterator():
        out[r[0], r[1]] = r[2]
    return out


def export(formats: list[str], writers: dict[str, Callable[[], str]]) -> list[tuple[str, bool, str | None, str | None]]:
    """(format, ok, path, reason) of each wanted format; those without a writer, or whose writer fails, are reported with the reason."""
    out = []
    for name in dict.fromkeys(f.lower() for f in formats):
        if name not in writers:
            out.append((name, False, None, "no writer for this format"))
            continue
        try:
            out.append((name, True, writers[name](), None))
        except Exception as e:  # an export that fails must not end the others
            out.append((name, False, None, f"{type(e).__name__}: {e}"))
    return out


def export_rows(spark: SparkSession, run: str, results: list[tuple[str, bool, str | None, str | None]]) -> DataFrame:
    return spark.createDataFrame([(run, *r) for r in results], "run string, format string, ok boolean, path string, reason string")

"""Exchange files: LAS 1.4 clouds, GeoTIFF rasters, GLB meshes.

Clouds are written by all tasks, in two phases like PLY.  Rasters and meshes
are single small files made on the driver; larger ones than the stated bounds
are an error, and stay Parquet.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.raster import Extent, bounds
from ..sources.ply import append_file
from .products import NODATA, las_colors, raster_array

MOST_VERTICES = 20_000_000
#: Sizes of the LAS 1.4 header and of point format 7.
LAS_HEADER, LAS_POINT = 375, 36
POINT = np.dtype([("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("kind", "u1"), ("user", "u1"), ("angle", "<i2"), ("source", "<u2"), ("time", "<f8"), ("r", "<u2"), ("g", "<u2"), ("b", "<u2")])


@dataclass
class Body(WriterCommitMessage):
    path: str
    count: int
    low: tuple[float, float, float]
    high: tuple[float, float, float]


class LasWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        self.scale = float(options.get("scale", 0.001))
        self.offset = [float(options.get(f"{c}_offset", 0.0)) for c in "xyz"]

    def write(self, rows) -> Body:
        import uuid

        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        part = f"{self.path}.{uuid.uuid4().hex}.part"
        count, low, high = 0, [float("inf")] * 3, [float("-inf")] * 3
        with open(part, "wb") as f:
            for batch in rows:
                if not batch.num_rows:
                    continue
                body = np.zeros(batch.num_rows, dtype=POINT)
                body["returns"] = 0x11
                for i, (c, o) in enumerate(zip("xyz", self.offset, strict=True)):
                    steps = np.rint((batch.column(c).to_numpy(zero_copy_only=False) - o) / self.scale)
                    body[c] = steps
                    low[i], high[i] = min(low[i], float(steps.min() * self.scale + o)), max(high[i], float(steps.max() * self.scale + o))
                for c in "rgb":
                    body[c] = np.nan_to_num(batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64))
                body.tofile(f)
                count += batch.num_rows
        return Body(part, count, tuple(low), tuple(high))

    def commit(self, messages) -> None:
        full = [m for m in messages if m is not None and m.count]
        n = sum(m.count for m in full)
        low = [min((m.low[i] for m in full), default=0.0) for i in range(3)]
        high = [max((m.high[i] for m in full), default=0.0) for i in range(3)]
        head = struct.pack("<4sHH16sBB32s32sHHHIIBH", b"LASF", 0, 16, b"", 1, 4, b"", b"skyloom", 1, 2024, LAS_HEADER, LAS_HEADER, 0, 7, LAS_POINT)
        head += struct.pack("<I5I", 0, *[0] * 5) + struct.pack("<6d", *[self.scale] * 3, *self.offset)
        head += struct.pack("<6d", *(v for i in range(3) for v in (high[i], low[i]))) + struct.pack("<QQIQ15Q", 0, 0, 0, n, n, *[0] * 14)
        tmp = f"{self.path}.tmp"
        with open(tmp, "wb") as out:
            out.write(head)
            for m in full:
                append_file(out, m.path)
        os.replace(tmp, self.path)
        self.abort(messages)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class LasDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return "x double, y double, z double, r int, g int, b int"

    def writer(self, schema, overwrite) -> LasWriter:
        return LasWriter(self.options)


def write_las(points: DataFrame, path: str, scale: float = 0.001) -> None:
    """A cloud with 16-bit colours; coordinates are whole steps of the scale from the cloud's smallest corner."""
    points.sparkSession.dataSource.register(LasDataSource)
    box = bounds(points).first()
    colors = las_colors(points) if "r" in points.columns else points.select("x", "y", "z", *(F.lit(0).alias(c) for c in "rgb"))
    writer = colors.select(*(F.col(c).cast("double").alias(c) for c in "xyz"), *(F.col(c).cast("int").alias(c) for c in "rgb")).write.format("las").mode("append").option("scale", scale)
    for c in "xyz":
        writer = writer.option(f"{c}_offset", float(np.floor(box[f"{c}_min"] or 0.0)))
    writer.save(path)


def write_geotiff(grid: DataFrame, extent: Extent, path: str, epsg: int, value: str = "z") -> None:
    """A single-band float raster, deflated in strips, north up, with NODATA where cells are empty."""
    _write_tiff(raster_array(grid, extent, value).astype("<f4")[:, :, None], extent, path, epsg)


def write_rgb_geotiff(grid: DataFrame, extent: Extent, path: str, epsg: int) -> None:
    """A raster of colours: three bands of bytes, and a fourth that is 0 where cells are empty and 255 elsewhere."""
    bands = [raster_array(grid, extent, c) for c in "rgb"]
    empty = bands[0] == NODATA
    _write_tiff(np.dstack([np.where(empty, 0, np.clip(b, 0, 255)).astype(np.uint8) for b in bands] + [np.where(empty, 0, 255).astype(np.uint8)]), extent, path, epsg)


def _write_tiff(array: np.ndarray, extent: Extent, path: str, epsg: int) -> None:
    """[row, column, band], floats or bytes."""
    bands, floats = array.shape[2], array.dtype.kind == "f"
    rows = max(1, min(extent.height, (1 << 22) // max(1, extent.width * bands * array.itemsize)))
    strips = [zlib.compress(array[i : i + rows].tobytes()) for i in range(0, extent.height, rows)]
    keys = (1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg)
    tags = [
        (256, "I", [extent.width]), (257, "I", [extent.height]), (258, "H", [8 * array.itemsize] * bands), (259, "H", [8]), (262, "H", [1 if bands == 1 else 2]), (273, "I", [0] * len(strips)), (277, "H", [bands]), (278, "I", [rows]),
        (279, "I", [len(s) for s in strips]), (284, "H", [1]), *([] if bands < 4 else [(338, "H", [2])]), (339, "H", [3 if floats else 1] * bands), (33550, "d", [extent.resolution, extent.resolution, 0.0]), (33922, "d", [0.0, 0.0, 0.0, extent.x_min, extent.y_max, 0.0]), (34735, "H", list(keys)), *([(42113, "s", f"{NODATA:g}".encode() + b"\0")] if floats else []),
    ]
    size = {"H": (3, 2), "I": (4, 4), "d": (12, 8), "s": (2, 1)}
    directory = 8
    free = directory + 2 + 12 * len(tags) + 4
    placed = {}
    for number, kind, items in tags:
        n = len(items) * size[kind][1]
        if n > 4:
            placed[number] = free
            free += n + n % 2
    at, offsets = free, []
    for s in strips:
        offsets.append(at)
        at += len(s)
    if at >= 1 << 32:
        raise ValueError("raster too large for a TIFF")
    out = bytearray(free)
    out[:8] = struct.pack("<2sHI", b"II", 42, directory)
    struct.pack_into("<H", out, directory, len(tags))
    for i, (number, kind, items) in enumerate(tags):
        items = offsets if number == 273 else items
        raw = bytes(items) if kind == "s" else struct.pack(f"<{len(items)}{kind}", *items)
        entry = struct.pack("<HHI", number, size[kind][0], len(items)) + (struct.pack("<I", placed[number]) if number in placed else raw.ljust(4, b"\0"))
        out[directory + 2 + 12 * i : directory + 14 + 12 * i] = entry
        if number in placed:
            out[placed[number] : placed[number] + len(raw)] = raw
    with open(f"{path}.tmp", "wb") as f:
        f.write(bytes(out))
        for s in strips:
            f.write(s)
    os.replace(f"{path}.tmp", path)


def write_glb(vertices: DataFrame, faces: DataFrame, path: str, most: int = MOST_VERTICES) -> None:
    """A binary glTF mesh; coordinates are relative to their mean, which is kept as the node's translation."""
    rows = vertices.orderBy("vertex").limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError("mesh too large for one file")
    order = {v: i for i, v in enumerate(rows["vertex"].tolist())}
    xyz = rows[["x", "y", "z"]].to_numpy(np.float64).reshape(-1, 3)
    center = xyz.mean(axis=0) if len(xyz) else np.zeros(3)
    points = (xyz - center).astype("<f4")
    corners = faces.select("a", "b", "c").limit(2 * most + 1).toPandas()
    if len(corners) > 2 * most:
        raise ValueError("mesh too large for one file")
    index = corners.to_numpy().reshape(-1)
    index = np.fromiter((order[v] for v in index.tolist()), dtype="<u4", count=len(index))
    blob = points.tobytes() + index.tobytes()
    box = (points.min(axis=0).tolist(), points.max(axis=0).tolist()) if len(points) else ([0.0] * 3, [0.0] * 3)
    doc = {
        "asset": {"version": "2.0", "generator": "skyloom"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0, "translation": center.tolist()}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}], "buffers": [{"byteLength": len(blob)}],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": points.nbytes, "target": 34962}, {"buffer": 0, "byteOffset": points.nbytes, "byteLength": index.nbytes, "target": 34963}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": len(points), "type": "VEC3", "min": box[0], "max": box[1]}, {"bufferView": 1, "componentType": 5125, "count": len(index), "type": "SCALAR"}],
    }
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    blob += b"\0" * (-len(blob) % 4)
    with open(f"{path}.tmp", "wb") as f:
        f.write(struct.pack("<4sII", b"glTF", 2, 12 + 8 + len(text) + 8 + len(blob)))
        f.write(struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(blob), b"BIN\0") + blob)
    os.replace(f"{path}.tmp", path)

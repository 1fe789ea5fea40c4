"""Pixels of PNG images, arrays of NPY files, and what a video's header says.

Images come from Spark's ``binaryFile`` reader, one row each, and are decoded
in Arrow batches: inflated, then unfiltered along diagonals, on which no pixel
hangs on another, so that each step is one operation on whole arrays.  All
depths and colour kinds are read, interlaced images are not; deeper
samples keep their high byte, alpha is left out.  A broken image is an error, or, if
asked, a row that says so.

Arrays are read in ranges of bytes through a data source, so one large array
is many tasks.  A video's boxes are walked by seeking from head to head: no
task reads a video's pictures, and no codec is needed.  Arrays and videos lie on a
mount that all workers see.
"""

from __future__ import annotations

import ast
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The signature; samples a pixel by colour kind.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
IMAGE = "path string, width int, height int, error string, rgb binary"
#: Pixels handed to Spark in one batch.
BATCH = 500_000


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("broken chunk")
        yield kind, body
        at += 12 + size


def unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes, each led by the kind of its filter, without their filters.

    A pixel of ``step`` bytes hangs on those to the left, above, and left above.
    All of one diagonal depend on the two diagonals before it only.
    """
    kinds = lines[:, 0]
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    body = lines[:, 1:]
    h, w = len(body), body.shape[1] // step
    out = np.zeros((h + 1, w + 1, step), dtype=np.int16)
    out[1:, 1:] = body.reshape(h, w, step)
    if not kinds.any():
        return body.copy()
    if set(np.unique(kinds)) <= {0, 2}:  # only rows above count
        first = np.flatnonzero(kinds == 0)
        cut = np.unique(np.concatenate([[0], first, [h]]))
        parts = [np.cumsum(body[a:b], axis=0, dtype=np.uint8) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return np.concatenate(parts)
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        p, q, r = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        nearest = np.where((p <= q) & (p <= r), a, np.where(q <= r, b, c))
        k = kinds[y][:, None]
        guess = np.where(k == 1, a, np.where(k == 2, b, np.where(k == 3, (a + b) >> 1, np.where(k == 4, nearest, 0))))
        out[y + 1, x + 1] = (out[y + 1, x + 1] + guess) & 255
    return out[1:, 1:].reshape(h, w * step).astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, 3) bytes."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG image")
    head, palette, packed, ended = None, None, [], False
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
    if head is None or not ended:
        raise ValueError("image ends early")
    w, h, depth, color, _, _, interlaced = head
    if interlaced or color not in SAMPLES:
        raise ValueError("interlaced images are not read" if interlaced else "unknown colour kind")
    n = SAMPLES[color]
    line = (w * n * depth + 7) // 8
    flat = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(flat) != h * (line + 1):
        raise ValueError("wrong number of bytes")
    raw = unfiltered(flat.reshape(h, line + 1), max(1, n * depth // 8))
    if depth == 16:
        samples = raw.reshape(h, w, n, 2)[..., 0]
    elif depth == 8:
        samples = raw.reshape(h, w, n)
    else:  # several samples a byte, first in the high bits
        bits = np.unpackbits(raw, axis=1)[:, : w * depth].reshape(h, w, depth)
        samples = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[..., None]
        if color == 0:
            samples = (samples.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    if color == 3:
        if palette is None or samples.max(initial=0) >= len(palette):
            raise ValueError("colour beyond the palette")
        return palette[samples[..., 0]]
    return np.repeat(samples[..., :1], 3, axis=2) if n < 3 else np.ascontiguousarray(samples[..., :3])


def encode_png(rgb: np.ndarray) -> bytes:
    """A PNG of (height, width, 3) bytes, rows as differences to those above."""
    h, w, _ = rgb.shape
    lines = rgb.reshape(h, w * 3)
    lines = np.concatenate([lines[:1], lines[1:] - lines[:-1]])
    body = np.concatenate([np.full((h, 1), 2, np.uint8), lines], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body, 6)) + chunk(b"IEND", b"")


def decode_images(files: DataFrame, strict: bool = True) -> DataFrame:
    """(path, width, height, error, rgb) of (path, content); unless strict, a broken or null image is a row with an error."""

    def one(path, content):
        try:
            if content is None:
                raise ValueError("no image")
            image = decode_png(bytes(content))
            return path, image.shape[1], image.shape[0], None, image.tobytes()
        except (ValueError, zlib.error, struct.error) as fault:
            if strict:
                raise ValueError(f"{path}: {fault}") from fault
            return path, None, None, str(fault), None

    def run(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):  # one image at a time is held
                yield pd.DataFrame([one(path, content)], columns=["path", "width", "height", "error", "rgb"]).astype({"width": "Int32", "height": "Int32"})

    return files.select("path", "content").mapInPandas(run, IMAGE)


def pixel_rows(images: DataFrame) -> DataFrame:
    """(path, u, v, r, g, b) of decoded images: column, row and colours, in batches of bounded size."""

    def run(batches):
        for b in batches:
            for path, w, rgb in zip(b["path"], b["width"], b["rgb"], strict=True):
                flat = np.frombuffer(rgb, np.uint8).reshape(-1, 3)
                for a in range(0, len(flat), BATCH):
                    part, at = flat[a : a + BATCH].astype(np.int16), np.arange(a, min(a + BATCH, len(flat)))
                    yield pd.DataFrame({"path": path, "u": (at % w).astype(np.int32), "v": (at // w).astype(np.int32), "r": part[:, 0], "g": part[:, 1], "b": part[:, 2]})

    return images.where("rgb is not null").select("path", "width", "rgb").mapInPandas(run, "path string, u int, v int, r short, g short, b short")


def read_pixels(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Pixel rows of all PNG images of a folder, or of one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,PNG}").load(path)
    return pixel_rows(decode_images(files, strict))


def images_of_pixels(pixels: DataFrame, key: str = "path") -> DataFrame:
    """(key, content): a PNG for each key of pixel rows; a group is one image's pixels.

    The image reaches to its largest column and row; pixels that no row gives
    are black, of repeated ones the largest (r, g, b) stays; colours are held within a byte.
    """
    byte = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.coalesce(F.col(c), F.lit(0)))).cast("short").alias(c)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["r", "g", "b"], kind="stable")
        u, v = group["u"].to_numpy(), group["v"].to_numpy()
        image = np.zeros((v.max() + 1, u.max() + 1, 3), np.uint8)
        image[v, u] = group[["r", "g", "b"]].to_numpy().astype(np.uint8)
        return pd.DataFrame({key: [group[key].iloc[0]], "content": [encode_png(image)]})

    rows = pixels.where("u >= 0 and v >= 0").select(key, F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), byte("r"), byte("g"), byte("b"))
    return rows.groupBy(key).applyInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, content binary")


def write_files(contents: DataFrame, folder: str, name: str = "path") -> DataFrame:
    """(name, bytes) of files written by the tasks, each put in place whole; names are those of one folder."""
    import uuid

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for n, content in zip(b[name], b["content"], strict=True):
                if os.path.basename(n) != n or n in ("", ".", ".."):
                    raise ValueError(f"not a plain file name: {n}")
                tmp = os.path.join(folder, f".{uuid.uuid4().hex}.part")
                with open(tmp, "wb") as f:
                    f.write(content)
                os.replace(tmp, os.path.join(folder, n))
                yield pd.DataFrame({name: [n], "bytes": [len(content)]})

    folder = folder.removeprefix("file://")
    return contents.select(name, "content").mapInPandas(run, f"`{name}` string, bytes long")


# Arrays

CHUNK = 8_000_000


def npy_header(path: str) -> tuple[np.dtype, bool, tuple[int, ...], int]:
    """(type, columns first, shape, bytes before the data)."""
    with open(path, "rb") as f:
        lead = f.read(8)
        if lead[:6] != b"\x93NUMPY":
            raise ValueError(f"not an array file: {path}")
        size = int.from_bytes(f.read(2 if lead[6] == 1 else 4), "little")
        said = ast.literal_eval(f.read(size).decode("utf-8" if lead[6] > 2 else "latin-1"))
        kind = np.dtype(said["descr"])
        if kind.kind not in "fiub":
            raise ValueError(f"not an array of numbers: {path}")
        return kind, said["fortran_order"], tuple(said["shape"]), f.tell()


@dataclass
class Range(InputPartition):
    path: str
    first: int
    count: int


class NpyReader(DataSourceReader):
    def __init__(self, options):
        path = options["path"].removeprefix("file://")
        self.paths = sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith(".npy")) if os.path.isdir(path) else [path]
        self.chunk = int(options.get("chunk", CHUNK))

    def partitions(self):
        out = []
        for p in self.paths:
            n = int(np.prod(npy_header(p)[2], dtype=np.int64))
            out += [Range(p, i, min(self.chunk, n - i)) for i in range(0, n, self.chunk)]
        return out

    def read(self, partition: Range | None) -> Iterator:
        import pyarrow as pa

        if partition is None:  # no ranges at all
            return
        kind, turned, shape, head = npy_header(partition.path)
        values = np.fromfile(partition.path, kind, partition.count, offset=head + partition.first * kind.itemsize)
        if len(values) != partition.count:
            raise ValueError(f"array ends early: {partition.path}")
        at = np.arange(partition.first, partition.first + partition.count)
        index = np.unravel_index(at, shape, order="F" if turned else "C") if shape else ()
        places = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(index, 1).ravel().astype(np.int64)), len(shape)).cast(pa.list_(pa.int64())) if shape else pa.array([[]] * len(at), pa.list_(pa.int64()))
        schema = pa.schema([("path", pa.string()), ("place", pa.list_(pa.int64())), ("value", pa.float64())])
        yield from pa.table([pa.array([partition.path] * len(at), pa.string()), places, pa.array(values.astype(np.float64))], schema=schema).to_batches(max_chunksize=100_000)


class NpyDataSource(DataSource):
    """(path, place, value): place has the index of each dimension."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "path string, place array<long>, value double"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)


def arrays_of_rows(rows: DataFrame, key: str, row: str, column: str, value: str) -> DataFrame:
    """(key, content): a two-dimensional array file of floats for each key; a group is one raster, cells without a row are NaN, of repeated cells the largest value stays."""
    import io

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(value, kind="stable", na_position="first")
        r, c = group[row].to_numpy(), group[column].to_numpy()
        out = np.full((r.max() + 1, c.max() + 1), np.nan, np.float32)
        out[r, c] = group[value].to_numpy()
        data = io.BytesIO()
        np.save(data, out)
        return pd.DataFrame({key: [group[key].iloc[0]], "content": [data.getvalue()]})

    picked = rows.where((F.col(row) >= 0) & (F.col(column) >= 0)).select(key, F.col(row).cast("int").alias(row), F.col(column).cast("int").alias(column), F.col(value).cast("float").alias(value))
    return picked.groupBy(key).applyInPandas(run, f"`{key}` {picked.schema[key].dataType.simpleString()}, content binary")


# Videos

VIDEO = "path string, width int, height int, fps double, duration double, n_frames long"


def boxes(f, first: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the bodies of the boxes between two places, by seeking only."""
    while first + 8 <= end:
        f.seek(first)
        head = f.read(16)
        size, kind, lead = int.from_bytes(head[:4], "big"), head[4:8], 8
        if size == 1:
            size, lead = int.from_bytes(head[8:16], "big"), 16
        elif size == 0:
            size = end - first
        if size < lead or first + size > end:
            raise ValueError("box reaches beyond its parent")
        yield kind, first + lead, first + size
        first += size


def _body(f, parent: tuple[int, int], *path: bytes, most: int = 1 << 26) -> bytes | None:
    """The body of the first box at a path, or None."""
    for kind in path:
        parent = next(((a, b) for k, a, b in boxes(f, *parent) if k == kind), None)
        if parent is None:
            return None
    f.seek(parent[0])
    return f.read(min(parent[1] - parent[0], most))


def _clock(body: bytes) -> tuple[int, int]:
    """(ticks a second, ticks) of a media or movie header."""
    return struct.unpack(">IQ", body[20:32]) if body[0] else struct.unpack(">II", body[12:20])


def probe(path: str) -> tuple[int, int, float, float, int]:
    """(width, height, frames a second, seconds, frames) of the first video track."""
    with open(path, "rb") as f:
        whole = (0, os.fstat(f.fileno()).st_size)
        movie = next(((a, b) for k, a, b in boxes(f, *whole) if k == b"moov"), None)
        if movie is None:
            raise ValueError(f"no movie header: {path}")
        for kind, a, b in boxes(f, *movie):
            handler = _body(f, (a, b), b"mdia", b"hdlr") if kind == b"trak" else None
            if handler is None or handler[8:12] != b"vide":
                continue
            size, media = _body(f, (a, b), b"tkhd"), _body(f, (a, b), b"mdia", b"mdhd")
            times = _body(f, (a, b), b"mdia", b"minf", b"stbl", b"stts")
            width, height = (v >> 16 for v in struct.unpack(">II", size[-8:]))
            runs = np.frombuffer(times[8 : 8 + 8 * int.from_bytes(times[4:8], "big")], ">u4").reshape(-1, 2).astype(np.int64)
            frames, ticks = int(runs[:, 0].sum()), int((runs[:, 0] * runs[:, 1]).sum())
            rate = _clock(media)[0]
            second, length = _clock(_body(f, movie, b"mvhd"))
            return width, height, frames * rate / ticks if ticks else 0.0, length / second if second else 0.0, frames
    raise ValueError(f"no video track: {path}")


def probe_videos(videos: DataFrame) -> DataFrame:
    """(path, width, height, fps, duration, n_frames) of a column path; input for ``runs.frame_rows``."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame([(p, *probe(p.removeprefix("file://").removeprefix("file:"))) for p in b["path"]], columns=["path", "width", "height", "fps", "duration", "n_frames"])

    return videos.select("path").mapInPandas(run, VIDEO)

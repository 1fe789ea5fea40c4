"""Point clouds in PLY files, as a Spark data source.

    spark.dataSource.register(PlyDataSource)
    spark.read.format("ply").load(path)          # x, y, z, r, g, b
    df.write.format("ply").mode("overwrite").save(path)

Binary files have fixed records, so they are read in ranges of ``chunk``
points, one task each; text files are read by one task.  A file that ends
early gives the points it has.  Writing is in two phases: tasks write bodies
batch by batch; the commit puts them behind a header with the count, the bytes
being copied by the file system, not through the driver's memory; an abort
removes them.  Paths are those of a file system that all workers mount.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "x double, y double, z double, r short, g short, b short"
CHUNK = 8_000_000
# Scalar types of the format.
TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
COLORS = (("red", "r"), ("green", "g"), ("blue", "b"))


@dataclass
class Header:
    format: str
    count: int
    properties: list[tuple[str, str]]
    size: int

    @property
    def record(self) -> np.dtype:
        order = ">" if "big" in self.format else "<"
        return np.dtype([(n, order + t) for n, t in self.properties])


def read_header(path: str) -> Header:
    form, count, props, element = "", 0, [], ""
    with open(path, "rb") as f:
        if f.readline().strip() != b"ply":
            raise ValueError(f"not a PLY file: {path}")
        while True:
            line = f.readline()
            if not line:
                raise ValueError(f"PLY header without an end: {path}")
            words = line.decode("ascii", "replace").split()
            if not words or words[0] == "comment":
                continue
            if words[0] == "format":
                form = words[1]
            elif words[0] == "element":
                element = words[1]
                if element == "vertex":
                    count = int(words[2])
            elif words[0] == "property" and element == "vertex":
                if words[1] == "list":
                    raise ValueError("list properties of vertices are not supported")
                props.append((words[2], TYPES[words[1]]))
            elif words[0] == "end_header":
                return Header(form, count, props, f.tell())


@dataclass
class Range(InputPartition):
    path: str
    first: int
    count: int


def files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith(".ply"))
    return [path]


class PlyReader(DataSourceReader):
    def __init__(self, options):
        self.paths = files(options["path"])
        self.chunk = int(options.get("chunk", CHUNK))

    def partitions(self):
        out = []
        for path in self.paths:
            h = read_header(path)
            step = h.count if h.format == "ascii" else self.chunk
            out += [Range(path, i, min(step, h.count - i)) for i in range(0, h.count, max(1, step))]
        return out

    def read(self, partition: Range | None) -> Iterator:
        import pyarrow as pa

        if partition is None:  # no ranges at all
            return
        h = read_header(partition.path)
        with open(partition.path, "rb") as f:
            if h.format == "ascii":
                f.seek(h.size)
                rows = [f.readline().split() for _ in range(partition.count)]
                rows = [r for r in rows if len(r) >= len(h.properties)]
                data = {n: np.array([float(r[i]) for r in rows]) for i, (n, _) in enumerate(h.properties)}
            else:
                f.seek(h.size + partition.first * h.record.itemsize)
                body = f.read(partition.count * h.record.itemsize)
                points = np.frombuffer(body[: len(body) // h.record.itemsize * h.record.itemsize], dtype=h.record)
                data = {n: points[n] for n, _ in h.properties}
        n = len(data["x"])
        columns = {c: pa.array(np.asarray(data[c], dtype=np.float64)) for c in "xyz"}
        for name, short in COLORS:
            columns[short] = pa.array(np.asarray(data[name], dtype=np.int16)) if name in data else pa.nulls(n, pa.int16())
        yield from pa.table(columns).to_batches(max_chunksize=100_000)


@dataclass
class Body(WriterCommitMessage):
    path: str
    count: int
    colored: bool


def append_file(out, path: str) -> None:
    """Append a file to an open one within the kernel."""
    out.flush()
    with open(path, "rb") as f:
        left = os.fstat(f.fileno()).st_size
        while left:
            done = os.copy_file_range(f.fileno(), out.fileno(), min(left, 1 << 30))
            if not done:
                raise OSError(f"file ends early: {path}")
            left -= done


class PlyWriter(DataSourceArrowWriter):
    """Colours are bytes; ``write_ply`` makes them so."""

    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")

    def write(self, rows) -> Body:
        import uuid

        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        part = f"{self.path}.{uuid.uuid4().hex}.part"
        count, colored = 0, None
        with open(part, "wb") as f:
            for batch in rows:
                if not batch.num_rows:
                    continue
                known = [batch.column(c).null_count < batch.num_rows for c in "rgb"]
                colored = all(known) if colored is None else colored
                if colored != all(known):
                    raise ValueError("some points have colours and some have none")
                body = np.zeros(batch.num_rows, dtype=[(c, "<f4") for c in "xyz"] + [(c, "u1") for c in "rgb" if colored])
                for c in body.dtype.names:
                    values = batch.column(c).to_numpy(zero_copy_only=False)
                    body[c] = values if c in "xyz" else np.clip(np.nan_to_num(values.astype(np.float64)), 0, 255)
                body.tofile(f)
                count += batch.num_rows
        return Body(part, count, bool(colored))

    def commit(self, messages) -> None:
        full = [m for m in messages if m is not None and m.count]
        colored = all(m.colored for m in full) and bool(full)
        if not colored and any(m.colored for m in full):
            self.abort(messages)
            raise ValueError("some points have colours and some have none")
        lines = ["ply", "format binary_little_endian 1.0", f"element vertex {sum(m.count for m in full)}", *(f"property float {c}" for c in "xyz"), *(f"property uchar {n}" for n, _ in COLORS if colored), "end_header"]
        tmp = f"{self.path}.tmp"
        with open(tmp, "wb") as out:
            out.write(("\n".join(lines) + "\n").encode())
            for m in full:
                append_file(out, m.path)
        os.replace(tmp, self.path)
        self.abort(messages)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class PlyDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PlyReader:
        return PlyReader(self.options)

    def writer(self, schema, overwrite) -> PlyWriter:
        return PlyWriter(self.options)

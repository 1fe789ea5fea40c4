"""Positions in binary MAVLink logs, as a Spark data source read in byte ranges.

    spark.dataSource.register(MavlinkDataSource)
    spark.read.format("mavlink").load(path)      # messages for telemetry.decode_mavlink

A message is wherever a start byte, a known kind, its length and its X.25
checksum agree, whatever lies before it.  That needs no place to start from, so
a log may be cut anywhere and every cut gives the same rows; junk, torn
and unknown messages are passed over.  A task takes the messages that start
in its range and reads on for as long as one message may be.  Both versions
of the protocol are read, with trailing zeros cut off and with signatures.

In a ground station's log eight bytes before a message give the microseconds since the
epoch; with ``stamped=false`` (a raw stream) the sender's own clock counts.
Paths are those of a file system that all workers mount; a folder means its
.tlog and .mavlink files.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "track_id string, ord long, type string, t double, lat long, lon long, alt long, relative_alt long, hdg long"
CHUNK = 64 << 20
STAMP = 8
# Start bytes, kinds (name, payload bytes, seed of the checksum) and payload layouts.
START_1, START_2 = 0xFE, 0xFD
KINDS = {24: ("GPS_RAW_INT", 30, 24), 33: ("GLOBAL_POSITION_INT", 28, 104)}
LAYOUTS = {
    24: np.dtype([("clock", "<u8"), ("lat", "<i4"), ("lon", "<i4"), ("alt", "<i4"), ("rest", "V10")]),
    33: np.dtype([("clock", "<u4"), ("lat", "<i4"), ("lon", "<i4"), ("alt", "<i4"), ("relative_alt", "<i4"), ("speed", "V6"), ("hdg", "<u2")]),
}
CLOCK = {24: 1e6, 33: 1e3}
LONGEST = 10 + 255 + 2


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint16)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ 0x8408, c >> 1).astype(np.uint16)
    return c


CRC = _crc_table()


def checksums(data: np.ndarray, first: np.ndarray, length: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """X.25 checksums of data[first : first + length] followed by a seed byte, for many ranges at once."""
    crc = np.full(len(first), 0xFFFF, dtype=np.uint16)
    for i in range(int(length.max(initial=0))):
        on = np.flatnonzero(length > i)
        crc[on] = (crc[on] >> 8) ^ CRC[(crc[on] ^ data[first[on] + i]) & 0xFF]
    return (crc >> 8) ^ CRC[(crc ^ seed) & 0xFF]


def messages(data: np.ndarray, most: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """kind: (places, payloads) of all sound messages that start before ``most``."""
    starts = np.flatnonzero((data[:most] == START_1) | (data[:most] == START_2))
    out = {}
    for version, head in ((START_1, 6), (START_2, 10)):
        here = starts[(data[starts] == version) & (starts + head + 2 <= len(data))]
        length = data[here + 1].astype(np.int64)
        kind = data[here + 5].astype(np.int64) if version == START_1 else data[here + 7] + (data[here + 8].astype(np.int64) << 8) + (data[here + 9].astype(np.int64) << 16)
        for k, (_, size, seed) in KINDS.items():
            fits = (kind == k) & (here + head + length + 2 <= len(data))
            fits &= (length == size) if version == START_1 else (length > 0)
            at, n = here[fits], length[fits]
            crc = checksums(data, at + 1, n + head - 1, np.full(len(at), seed, dtype=np.uint16))
            ends = at + head + n
            sound = (data[ends].astype(np.uint16) | (data[ends + 1].astype(np.uint16) << 8)) == crc
            at, n = at[sound], n[sound]
            body = np.zeros((len(at), size), dtype=np.uint8)
            for i in range(size):
                on = n > i
                body[on, i] = data[at[on] + head + i]
            old = out.get(k)
            out[k] = (at, body) if old is None else (np.concatenate([old[0], at]), np.concatenate([old[1], body]))
    return out


@dataclass
class Range(InputPartition):
    path: str
    first: int
    size: int


class MavlinkReader(DataSourceReader):
    def __init__(self, options):
        path = options["path"].removeprefix("file://")
        self.paths = sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith((".tlog", ".mavlink"))) if os.path.isdir(path) else [path]
        self.chunk = int(options.get("chunk", CHUNK))
        self.stamped = options.get("stamped", "true").lower() == "true"

    def partitions(self):
        return [Range(p, i, self.chunk) for p in self.paths for i in range(0, os.path.getsize(p), self.chunk)]

    def read(self, partition: Range | None) -> Iterator:
        import pyarrow as pa

        if partition is None:  # no ranges at all
            return
        before = min(STAMP, partition.first)
        with open(partition.path, "rb") as f:
            f.seek(partition.first - before)
            data = np.frombuffer(f.read(before + partition.size + LONGEST), dtype=np.uint8)
        schema = pa.schema([("track_id", pa.string()), ("ord", pa.int64()), ("type", pa.string()), ("t", pa.float64()), *((c, pa.int64()) for c in ("lat", "lon", "alt", "relative_alt", "hdg"))])
        for kind, (at, body) in messages(data, before + partition.size).items():
            at, body = at[at >= before], body[at >= before]
            fields = body.view(LAYOUTS[kind])[:, 0] if len(at) else np.zeros(0, LAYOUTS[kind])
            if self.stamped:
                stamped = at >= STAMP
                parts = data[np.maximum(at, STAMP)[:, None] + np.arange(-STAMP, 0)] if len(at) else np.zeros((0, STAMP), np.uint8)
                t = np.where(stamped, np.ascontiguousarray(parts).view(">u8")[:, 0] / 1e6, 0.0)
            else:
                t = fields["clock"] / CLOCK[kind]
            whole = lambda name: pa.array(fields[name].astype(np.int64)) if name in LAYOUTS[kind].names else pa.nulls(len(at), pa.int64())  # noqa: B023, E731
            columns = [pa.array([partition.path] * len(at), pa.string()), pa.array(at + partition.first - before), pa.array([KINDS[kind][0]] * len(at), pa.string()), pa.array(t), *(whole(c) for c in ("lat", "lon", "alt", "relative_alt", "hdg"))]
            yield from pa.table(columns, schema=schema).to_batches(max_chunksize=100_000)


class MavlinkDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mavlink"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MavlinkReader:
        return MavlinkReader(self.options)

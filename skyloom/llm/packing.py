"""Best-fit decreasing packing of tokenised documents, for all documents at once.

1. Each document's ids, and the end mark, are cut into full windows of
   ``capacity`` and one shorter rest.  Pieces are written to the shared folder
   with the task that made them and their rank among that task's pieces of the
   same length.
2. Best fit decreasing sees pieces by nothing but their length, so the driver
   needs the number of pieces of each length only (``capacity`` rows).  Open
   windows are kept in ranges of equal remaining capacity; a segment tree over
   the capacities finds the tightest open one, and a whole range is filled in
   one step.  The outcome is the packing of one sorted pass over all pieces,
   as rules: the pieces of length L with ranks from r on go to the windows
   from w on, at one offset.  Rules depend on the lengths, hardly on the
   number of pieces, and go to every task.
3. A piece's rank among all of its length is its rank in its task and the number
   of such pieces in the tasks before (a window over one row per task and
   length).  Its rule is found by bisection.

No task sees more than its share of pieces, whatever their lengths: equal
lengths and copies are ranked where they were made.

Only documents longer than a window are cut; the packing is close to full when
there are many pieces, since short rests fill the gaps of long ones.

Edge cases: null or empty text is its end mark alone; null ids stay null;
repeated rows are packed one by one; strings of special tokens in a text are
what the library makes of them by default; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, text_of
from .token_counts import SLICE, default_path
from .token_ids import byte_level_ids

CAPACITY = 2048
END = 1

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, nth long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces_of(text: str, path: str, capacity: int = CAPACITY, end: int | None = END) -> list[tuple[int, int, int, int]]:
    """(start, length, crc32, tokens of the document) of each piece of a text."""
    ids = byte_level_ids(text, path, specials=True) + (b"" if end is None else end.to_bytes(4, "little"))
    total = len(ids) // 4
    return [(at, min(capacity, total - at), zlib.crc32(ids[4 * at : 4 * (at + capacity)]), total) for at in range(0, total, capacity)]


def _cut(path: str, capacity: int, end: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE).to_pydict()
                out: list[tuple] = []
                for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                    for start, length, crc, total in pieces_of(text, path, capacity, end):
                        out.append((doc_id, start, length, crc, total, task, seen[length]))
                        seen[length] += 1
                columns = list(zip(*out, strict=True)) or [()] * 7
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"])

    return run


class OpenWindows:
    """Ranges (first window, windows, used) by remaining capacity, under a segment tree of what is there."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.size)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int, there: bool) -> None:
        at = self.size + room
        while at and self.tree[at] != there:
            self.tree[at] = there
            at //= 2
            there = self.tree[2 * at] or self.tree[2 * at + 1] if at else there

    def put(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.ranges[room].append((first, count))
            self._mark(room, True)

    def take(self, room: int) -> tuple[int, int]:
        out = self.ranges[room].pop()
        if not self.ranges[room]:
            self._mark(room, False)
        return out

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least`` that an open window has."""
        at = self.size + least
        if self.tree[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def rules(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first window, offset), by length and rank, of the packing of ``counts[length]`` pieces each."""
    open_windows, windows, out = OpenWindows(capacity), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = open_windows.tightest(length)
            # Without an open window there are as many new ones as it takes.
            first, count = (windows, -(-left // (capacity // length))) if room is None else open_windows.take(room)
            if room is None:
                room, windows = capacity, windows + count
            # A window that took a piece is the tightest for the next of this length, until none fits.
            each = room // length
            full = min(left // each, count)
            rest = min(left - full * each, each - 1) if full < count else 0
            for held, at, many in ((each, first, full), (rest, first + full, 1)):
                if held and many:
                    for i in range(held):
                        out.append((length, rank, at, capacity - room + i * length))
                        rank += many
                    open_windows.put(room - held * length, at, many)
                    left -= held * many
            taken = full + (rest > 0)
            open_windows.put(room, first + taken, count - taken)
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 4)


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, window, offset = shared.value.T
        keys = (length << 48) + first
        for batch in batches:
            of = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("length", "rank")}
            at = np.searchsorted(keys, (of["length"] << 48) + of["rank"], side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(window[at] + of["rank"] - first[at]), pa.array(offset[at])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int | None = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)
    cut = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_cut(path or default_path(), capacity, end), PIECES))
    by_task = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row per length
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = cut.join(starts, ["task", "length"]).withColumn("rank", F.col("nth") + F.col("first")).drop("task", "nth", "first")
    return ranked.mapInArrow(_place(spark.sparkContext.broadcast(rules(counts, capacity))), PLACED)

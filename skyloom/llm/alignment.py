"""Alignment of two tokenisers over a corpus: groups, links and how usual links are.

1. mapInPandas: both tokenisers encode each text (A the text behind one space,
   B the text, before which it puts a space itself).  The cumulative ends of
   both are merged: where both end, a group is closed.  A group links all its
   A tokens to all its B tokens.  A document's distinct links, with the number
   of times they occur in it, are written to the shared folder with its digest.
2. Spark counts, for each pair of ids, the documents that hold it linked
   (partial counts in each task), and takes each A id's highest count.  Both
   are joined back to the pairs; there are at most as many A ids as the
   vocabulary has, so the highest counts go to every task.
3. Per document, links meet the counts: those of the usual pairs (at most
   ``COMMON``, the ones above a count read off a histogram) at once in each
   task, the rest by a shuffle join.  No pair of the rest is usual, so no key
   of the join is hot.

Texts whose joined bytes differ from a space and the text on either side have
no tokens: zeros, no links, an empty digest.

Edge cases: null and empty texts have no tokens; null ids stay null; repeated
rows are counted and returned one by one; a group of any size is counted from
its distinct ids, not from its links; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, text_of
from .token_counts import STEPS, default_path
from .token_ids import byte_level_ids, byte_level_table, piece_ids, piece_table

#: Pairs that go to every task, 13 bytes each.
COMMON = 1_000_000
SLICE = 200
#: Ids of B are below this, so a pair of ids is one number.
SPAN = 1 << 20
#: A pair is below this power of two; what is above it in a sort key is the text.
DOC_SHIFT = 42

DOCUMENTS = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
SUMS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pair long, times long"


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Entries:
    """The bytes of all ids of a tokeniser, end to end, and the decimal form of each id."""

    def __init__(self, entries: list[bytes]):
        self.lengths = np.fromiter(map(len, entries), np.int64, len(entries))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[_spread(self.starts[ids], self.lengths[ids])]


@cache
def _entries(table, path: str) -> _Entries:
    return _Entries(table(path))


def _encoded(texts: list[bytes], ids: list[bytes], entries: _Entries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids end to end, their number in each text, and whether a text's joined bytes are the text's."""
    counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
    ends = np.r_[0, np.cumsum(entries.lengths[flat])][np.cumsum(counts)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    spelled, wanted = entries.spelled(flat), np.frombuffer(b"".join(texts), np.uint8)
    if len(spelled) == len(wanted) and (ends == np.cumsum(sizes)).all() and (spelled == wanted).all():
        return flat, counts, np.ones(len(texts), bool)
    to, starts = np.cumsum(sizes), ends - np.diff(ends, prepend=0)
    same = [bool(n == e - a and (spelled[a:e] == wanted[t - n : t]).all()) for a, e, n, t in zip(starts, ends, sizes, to, strict=True)]
    return flat, counts, np.array(same, bool)


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of A and B tokens before the end of each group, by a merge of the ascending ends."""
    at = np.searchsorted(ends_b, ends_a)
    both = np.flatnonzero(ends_b[at] == ends_a) if len(ends_a) else at
    return both + 1, at[both] + 1


WIDTH = 6
_POWERS = 10 ** np.arange(WIDTH - 1, -1, -1)


@cache
def _decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of the numbers below ``size``, to the right, and how many each has."""
    numbers = np.arange(size)[:, None]
    return (numbers // _POWERS % 10 + ord("0")).astype(np.uint8), np.maximum(1, (numbers >= _POWERS).sum(1))


def _digits(ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The decimal ids, each followed by its mark, as one array of bytes; and where each id's part ends."""
    digits, lengths = _decimals(10 ** math.ceil(math.log10(max(10, int(ids.max(initial=0)) + 1))))
    cells = np.empty((len(ids), WIDTH + 1), np.uint8)
    cells[:, :-1] = digits[ids]
    cells[:, -1] = marks
    sizes = lengths[ids]
    return cells[np.arange(WIDTH + 1) >= (WIDTH - sizes)[:, None]], np.cumsum(sizes + 1)


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for counts[i] numbers each."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - counts), counts)


#: Groups with more links than this are counted from their distinct ids.
WIDE = 4096


def _links(a: np.ndarray, b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray, na: np.ndarray, nb: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, times) of the links of all groups, distinct in each document."""
    wide = na * nb > WIDE
    narrow = np.flatnonzero(~wide)
    per = (na * nb)[narrow]
    one = per == 1
    single, more = narrow[one], narrow[~one]
    within = _spread(np.zeros(len(more), np.int64), per[~one])
    width = np.repeat(nb[more], per[~one])
    spread = np.repeat(np.arange(len(more)), per[~one])
    keys = np.sort(
        np.concatenate([
            (doc[single] << DOC_SHIFT) + a[from_a[single]] * SPAN + b[from_b[single]],
            (doc[more][spread] << DOC_SHIFT) + a[from_a[more][spread] + within // width] * SPAN + b[from_b[more][spread] + within % width],
        ])
    )
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    keys, times = keys[new], np.diff(np.r_[new, len(keys)])
    if wide.any():
        parts = [(keys, times)]
        for g in np.flatnonzero(wide):
            (ids_a, times_a), (ids_b, times_b) = (np.unique(x[s : s + n], return_counts=True) for x, s, n in ((a, from_a[g], na[g]), (b, from_b[g], nb[g])))
            parts.append(((doc[g] << DOC_SHIFT) + (ids_a[:, None] * SPAN + ids_b).ravel(), (times_a[:, None] * times_b).ravel()))
        all_keys, all_times = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys, of = np.unique(all_keys, return_inverse=True)
        times = np.zeros(len(keys), np.int64)
        np.add.at(times, of, all_times)
    return keys >> DOC_SHIFT, keys & ((1 << DOC_SHIFT) - 1), times


def aligned(texts: list[str | None], a_path: str, b_path: str) -> dict[str, list]:
    """Columns of counts, digests and distinct links of some texts."""
    spaced = [f" {t}" if t else "" for t in texts]
    wanted = [t.encode() for t in spaced]
    entries_a, entries_b = _entries(byte_level_table, a_path), _entries(piece_table, b_path)
    a, count_a, same_a = _encoded(wanted, [byte_level_ids(t, a_path, specials=False) for t in spaced], entries_a)
    b, count_b, same_b = _encoded(wanted, [piece_ids(t or "", b_path) for t in texts], entries_b)
    same = same_a & same_b
    if not same.all():
        a, b = a[np.repeat(same, count_a)], b[np.repeat(same, count_b)]
        count_a, count_b = count_a * same, count_b * same
    # Texts lie end to end; both sides end at a text's end, so no group crosses it.
    to_a, to_b = groups(np.cumsum(entries_a.lengths[a]), np.cumsum(entries_b.lengths[b]))
    na, nb = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
    from_a, from_b = to_a - na, to_b - nb
    end_a = np.cumsum(count_a)
    doc = np.searchsorted(end_a, from_a, side="right")
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    # The digest's text: for each group its A ids, then its B ids, each with the mark behind it.
    at_a, at_b = np.arange(len(a)) + np.repeat(from_b, na), np.arange(len(b)) + np.repeat(to_a, nb)
    both, marks = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    both[at_a], both[at_b] = a, b
    marks[to_a + from_b - 1], marks[to_a + to_b - 1] = ord("|"), ord(";")
    shown, shown_to = _digits(both, marks)
    bounds = np.r_[0, shown_to][np.r_[0, np.cumsum(count_a + count_b)]].tolist()
    text = shown.tobytes()
    link_doc, pair, times = _links(a, b, from_a, from_b, na, nb, doc)
    cuts = np.searchsorted(link_doc, np.arange(len(texts) + 1))
    links = np.r_[0, np.cumsum(na * nb)]
    return {
        "n_a": count_a.tolist(),
        "n_b": count_b.tolist(),
        "n_groups": np.diff(first).tolist(),
        "n_links": np.diff(links[first]).tolist(),
        "groups_sha256": [hashlib.sha256(text[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(bounds, bounds[1:], strict=False)],
        "pairs": [pair[x:y] for x, y in zip(cuts, cuts[1:], strict=False)],
        "times": [times[x:y] for x, y in zip(cuts, cuts[1:], strict=False)],
    }


def _align(a_path: str, b_path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 40
        for frame in frames:
            for at in range(0, len(frame), SLICE):
                some = frame.iloc[at : at + SLICE]
                out = aligned(some["text"].tolist(), a_path, b_path)
                yield pd.DataFrame({"doc_id": some["doc_id"].astype("Int64").to_numpy(), "row": np.arange(row, row + len(some)), **out})
                row += len(some)

    return run


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold a pair linked, and whether no other pair of its A id is in more."""
    counted = links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).withColumn("a", F.expr(f"pair div {SPAN}"))
    counted = stored(counted)
    highest = counted.groupBy("a").agg(F.max("n").alias("most"))  # at most the vocabulary's size
    return counted.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def common_pairs(counts: DataFrame, most: int = COMMON) -> pd.DataFrame:
    """The most frequent pairs, at most ``most`` of them, by pair."""
    step = F.floor(F.log2("n") * STEPS).cast("int")
    total, least = 0, None
    for found in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):  # at most 64 * STEPS rows
        total += found["count"]
        if total > most:
            break
        least = found["step"]
    return counts.where(F.lit(False) if least is None else step >= least).toPandas().sort_values("pair")


#: What a document's row carries on besides its links.
_KEPT = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def _meet(known):
    """A row per document with the sums over its usual links, and a row for each other link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for batch in batches:
            links = batch.column("pairs")
            doc = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(links).to_numpy(zero_copy_only=False))
            pair, times = (batch.column(name).flatten().to_numpy(zero_copy_only=False) for name in ("pairs", "times"))
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            hit = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            at, there = at[hit], np.flatnonzero(hit)
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], doc[there], times[there] * best[at])
            np.add.at(sums[1], doc[there], times[there] * n[at])
            summed = {name: batch.column(name) for name in _KEPT} | {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
            left = np.flatnonzero(~hit)
            parts = [(batch.num_rows, summed)]
            for i in range(0, len(left), 100_000):
                some = left[i : i + 100_000]
                parts.append((len(some), {"row": batch.column("row").take(pa.array(doc[some])), "pair": pa.array(pair[some]), "times": pa.array(times[some])}))
            for size, columns in parts:
                kinds = {name: pa.string() if name == "groups_sha256" else pa.int64() for name in (*_KEPT, "n_best", "count_sum", "pair", "times")}
                yield pa.RecordBatch.from_pydict({name: columns.get(name, pa.nulls(size, kind)) for name, kind in kinds.items()})

    return run


def alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, most_common: int = COMMON) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    links = stored(rows.mapInPandas(_align(a_path or default_path(), b_path or piece_path()), DOCUMENTS))
    counts = stored(pair_counts(links))
    usual = common_pairs(counts, most_common)
    known = spark.sparkContext.broadcast((usual["pair"].to_numpy(np.int64), usual["n"].to_numpy(np.int64), usual["best"].to_numpy(bool)))
    met = links.mapInArrow(_meet(known), SUMS)
    # Rows of documents meet no pair; each has a key of its own.
    key = F.coalesce("pair", -1 - F.col("row"))
    rest = met.withColumn("key", key).join(counts.select(F.col("pair").alias("key"), "n", "best"), "key", "left")
    sums = rest.groupBy("row").agg(
        *(F.max(c).alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")),
        F.sum(F.coalesce("n_best", F.when(F.col("best"), F.col("times")).otherwise(0))).alias("n_best"),
        F.sum(F.coalesce("count_sum", F.col("times") * F.col("n"))).alias("count_sum"),
        F.max("groups_sha256").alias("groups_sha256"),
    )
    return sums.drop("row")

"""Exact dedup by a minimal perfect hash over historical digests.

Texts are equal when identical after lower-casing A-Z.  The digest is SHA-256
of the normalised text.

1. History is reduced to one row per distinct digest (winner = largest id,
   number of rows).  Map-side aggregation meets copies before the shuffle, so
   a group holding a third of all rows moves as one row per task.
2. The distinct digests are cut by their own leading bits into parts of about
   ``KEYS_PER_PART`` keys.  Each part gets a minimal perfect hash
   (compress-hash-displace): a key's bucket has two displacements which send
   every key of the part to its own slot, with no slot free.  Digests are
   uniform and distinct, so parts are even whatever the texts are.
3. The slot table holds the full digest and the winner's id.  A digest that
   was never indexed also lands on some slot, hence the lookup compares all
   32 bytes; members are merged into their slot's group, the others are
   grouped on their own.

Edge cases: null text counts as empty; a null doc_id takes part in group_size
but is never a winner while an id is present; in a group of null ids only,
keep_id is null and one row stays; rows repeating both doc_id and text give
one output row each, of which one stays; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, id_crc, stored, text_of

KEYS_PER_PART = 2048
KEYS_PER_BUCKET = 4
#: Values of the first displacement.  Each deals a bucket's keys anew; only the
#: last buckets of a part need more than a few.
FIRST_DISPLACEMENTS = 1 << 16
PRIME = 2**31 - 1
#: Repeated rows are written out again in blocks of so many.
REPEATS = 10_000

INDEX_SCHEMA = "part long, bucket long, d0 long, d1 long, slot long, digest binary, winner long, members long, keys long"


def digest_of(text: str = "text"):
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(ascii_lower(text_of(text)), 256))


def _bits(start: int):
    """Twelve hexadecimal digits (48 bits) of the digest, as a long."""
    return F.conv(F.substring(F.hex("digest"), start, 12), 16, 10).cast("long")


def with_part(df: DataFrame, parts: int) -> DataFrame:
    return df.withColumn("part", _bits(1) % parts).withColumn("h0", _bits(13)).withColumn("h1", _bits(25)).withColumn("h2", _bits(37))


def displace(h0: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, two displacements and slot of each key: slot = ((h1 + d0*h2) mod PRIME + d1) mod n."""
    n = len(h0)
    bucket = h0 % max(1, -(-n // KEYS_PER_BUCKET))
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
    groups = np.split(order, starts[1:])
    groups.sort(key=lambda g: (-len(g), int(bucket[g[0]])))
    free = np.ones(n, dtype=bool)
    d0, d1, slot = (np.zeros(n, dtype=np.int64) for _ in range(3))
    a, b = h1 % PRIME, h2 % PRIME
    shifts = np.arange(n)
    cursor = 0
    for keys in groups:
        if len(keys) == 1:
            while not free[cursor]:
                cursor += 1
            first, second, at = 0, (cursor - a[keys[0]] % n) % n, np.array([cursor])
        else:
            for first in range(FIRST_DISPLACEMENTS):
                base = (a[keys] + first * b[keys]) % PRIME % n
                if len(set(base.tolist())) < len(keys):
                    continue
                fits = free[(base[:, None] + shifts[None, :]) % n].all(axis=0)
                if fits.any():
                    second = int(fits.argmax())
                    at = (base + second) % n
                    break
            else:
                raise ValueError("no displacement found: two digests agree on 96 bits")
        free[at] = False
        d0[keys], d1[keys], slot[keys] = first, second, at
    return bucket, d0, d1, slot


def _index_part(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("digest", ignore_index=True)
    bucket, d0, d1, slot = displace(*(pdf[c].to_numpy(np.int64) for c in ("h0", "h1", "h2")))
    return pd.DataFrame({"part": pdf["part"], "bucket": bucket, "d0": d0, "d1": d1, "slot": slot, "digest": pdf["digest"], "winner": pdf["winner"], "members": pdf["members"], "keys": len(pdf)})


def grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("members"))


def build_index(history: DataFrame) -> tuple[DataFrame, int]:
    """Slots of a minimal perfect hash over (digest, winner, members) rows with distinct digests; and the number of parts."""
    history = stored(history)
    parts = max(1, -(-history.count() // KEYS_PER_PART))
    keyed = with_part(history, parts)
    return stored(keyed.groupBy("part").applyInPandas(_index_part, INDEX_SCHEMA)), parts


def lookup(index: DataFrame, parts: int, digests: DataFrame) -> DataFrame:
    """digests with slot_digest (null where its bytes differ: a nonmember), slot_winner and slot_members."""
    seeds = index.groupBy("part", "bucket").agg(F.first("d0").alias("d0"), F.first("d1").alias("d1"))
    sizes = index.groupBy("part").agg(F.first("keys").alias("keys"))
    slots = index.select("part", "slot", F.col("digest").alias("slot_digest"), F.col("winner").alias("slot_winner"), F.col("members").alias("slot_members"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("keys") / KEYS_PER_BUCKET))
    found = with_part(digests, parts).join(sizes, "part", "left").withColumn("bucket", F.col("h0") % buckets).join(seeds, ["part", "bucket"], "left")
    spread = (F.col("h1") % PRIME + F.col("d0") * (F.col("h2") % PRIME)) % PRIME
    found = found.withColumn("slot", (spread % F.col("keys") + F.col("d1")) % F.col("keys")).join(slots, ["part", "slot"], "left")
    same = F.col("slot_digest") == F.col("digest")
    return found.select(*digests.columns, F.when(same, F.col("slot_digest")).alias("slot_digest"), F.when(same, F.col("slot_winner")).alias("slot_winner"), F.when(same, F.col("slot_members")).alias("slot_members"))


def groups(rows: DataFrame, history: DataFrame) -> DataFrame:
    """digest, winner, members over both tables of (doc_id, digest) rows."""
    index, parts = build_index(grouped(history))
    found = stored(lookup(index, parts, grouped(rows)))
    outside = found.where("slot_digest is null").select("digest", "winner", "members")
    met = found.where("slot_digest is not null").select("digest", F.greatest("winner", "slot_winner").alias("winner"), (F.col("members") + F.col("slot_members")).alias("members"))
    alone = index.join(met.select("digest"), "digest", "left_anti").select("digest", "winner", "members")
    return outside.unionByName(met).unionByName(alone)


def exact_dedup(docs: DataFrame, history_share: int = 2) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The rows whose crc32(doc_id) is divisible by ``history_share`` stand for
    what was stored before; their digests are indexed, the other rows look
    themselves up.
    """
    rows = stored(docs.select("doc_id", digest_of().alias("digest"), (id_crc() % history_share == 0).alias("old")))
    decided = groups(rows.where("not old"), rows.where("old"))
    # Only groups of several rows need the join; its hot keys are one row on this side, and adaptive execution splits the other.
    several = decided.where("members > 1").select(F.col("digest").alias("d"), "winner", "members")
    ranked = rows.join(several, F.col("digest") == F.col("d"), "left")
    keep_id = F.when(F.col("members").isNull(), F.col("doc_id")).otherwise(F.col("winner"))
    named = ranked.select("doc_id", keep_id.alias("keep_id"), F.coalesce("members", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("wins"), F.lower(F.hex("digest")).alias("text_sha256"))
    lost = named.where("not wins").withColumn("kept", F.lit(False))
    alone = named.where("wins and group_size = 1").withColumn("kept", F.lit(True))
    # One row a group, unless rows repeat the winning id as well: they are counted, and written out again with one kept.
    won = named.where("wins and group_size > 1").groupBy("doc_id", "keep_id", "group_size", "text_sha256").agg(F.count(F.lit(1)).alias("times"))
    won = won.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / REPEATS)))).withColumn("i", F.explode(F.sequence(F.col("block") * REPEATS, F.least((F.col("block") + 1) * REPEATS, "times") - 1))).withColumn("kept", F.col("i") == 0)
    out = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    return lost.select(*out).unionByName(alone.select(*out)).unionByName(won.select(*out))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns and whole rows.

    Texts are shuffled once.  Where rows repeat both the winning id and its
    text, any one of them stays; only then are these rows read again.
    """
    key = "__skyloom_digest"
    plain = [docs[c] for c in docs.columns]
    marked = docs.withColumn(key, digest_of())
    rows = stored(marked.select("doc_id", F.col(key).alias("digest"), (id_crc() % 2 == 0).alias("old")))
    several = stored(groups(rows.where("not old"), rows.where("old")).where("members > 1").select(F.col("digest").alias("__skyloom_d"), F.col("winner").alias("__skyloom_w")))
    wins = F.col("doc_id").eqNullSafe(F.col("__skyloom_w"))
    again = rows.join(several, F.col("digest") == F.col("__skyloom_d")).where(wins).groupBy("digest").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    again = stored(again.select(F.col("digest").alias("__skyloom_r")))
    known = several.join(again, F.col("__skyloom_d") == F.col("__skyloom_r"), "left")
    joined = marked.join(known, F.col(key) == F.col("__skyloom_d"), "left")
    kept = joined.where(F.col("__skyloom_d").isNull() | (F.col("__skyloom_r").isNull() & wins)).select(*plain)
    if again.isEmpty():
        return kept
    repeated = marked.join(several.join(again, F.col("__skyloom_d") == F.col("__skyloom_r")), F.col(key) == F.col("__skyloom_d")).where(wins)
    return kept.unionByName(repeated.dropDuplicates([key]).select(*plain))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""

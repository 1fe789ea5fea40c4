"""Mixing sources to target weights by Poisson replication.

A source s with target weight w(s) and size S(s) (UTF-8 bytes of its texts) is
wanted rate(s) = w(s) * budget / S(s) times, where the budget is
``epochs`` times the corpus.  Each document is repeated k times, k drawn from a
Poisson distribution with mean rate(s): a uniform number made from md5(seed,
doc_id) is sent through the inverse of the distribution function.  Copies are
dealt to the output's partitions by md5(seed, doc_id, copy) and ordered by it
within each: a random set in random order.  All draws depend on rows and the
seed alone, so a task that runs again gives the same rows.

Without given weights, w(s) is proportional to S(s) ** ``temper``.  Sources
that ``weights`` does not name get weight zero.

Rates are one row per source.  Sizes are summed map-side; a source with a
third of all rows is one row per task.  The rates are joined as a broadcast
only if there are at most ``MOST_SOURCES``, else by a shuffle whose hot keys
adaptive execution splits.

Edge cases: null source is a source of its own; null text counts as empty; a
source whose texts are all empty has nothing to repeat by size and gets rate
``epochs``; documents without an id
draw by the md5 of their text instead; rows that repeat an id draw
the same count; documents' own columns named mix_copy, mix_copies or mix_key
give way to the new ones; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

SEED = "skyloom-mix-1"
TEMPER = 0.5
EPOCHS = 1.0
#: A rate row is a name and a double; so many stay below a few MB if names do below a hundred bytes.
MOST_SOURCES = 20_000
MOST_NAME = 200
#: The inverse is tabulated up to this count; rates are split into equal parts of at most MOST_RATE, each drawn on its own.
MOST_COUNT, MOST_RATE = 40, 8.0


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 48 bits of an md5 hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def _id() -> Column:
    """What a row draws by: its id, or its text's digest."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(text_of())))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = TEMPER, epochs: float = EPOCHS) -> DataFrame:
    """(source, rate): how often a document of the source is wanted."""
    sizes = docs.groupBy("source").agg(F.sum(F.octet_length(text_of()).cast("long")).alias("bytes"))
    if weights is None:
        weighed = sizes.withColumn("w", F.when(F.col("bytes") > 0, F.pow(F.col("bytes").cast("double"), F.lit(temper))).otherwise(0.0))
    else:
        given = F.lit(0.0)
        for name, w in weights.items():
            given = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(given)
        weighed = sizes.withColumn("w", F.when(F.col("bytes") > 0, given).otherwise(0.0))
    weighed = stored(weighed)
    total = weighed.agg(F.sum("bytes").alias("all_bytes"), F.sum("w").alias("all_w"))  # one row
    rate = F.when(F.col("bytes") == 0, F.lit(float(epochs))).otherwise(F.try_divide(F.col("w") * F.lit(float(epochs)) * F.col("all_bytes"), F.col("all_w") * F.col("bytes")))
    return weighed.crossJoin(F.broadcast(total)).select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def poisson_count(rate: Column, u: Column) -> Column:
    """The smallest k with P(N <= k) > u; k ends at MOST_COUNT (beyond it lies less than 1e-12 of the mass for rates up to MOST_RATE)."""
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("c"))
    steps = F.sequence(F.lit(1), F.lit(MOST_COUNT))
    return F.aggregate(
        steps,
        start,
        lambda a, i: F.when(u < a["c"], a).otherwise(F.struct(i.alias("k"), (a["p"] * rate / i).alias("p"), (a["c"] + a["p"] * rate / i).alias("c"))),
        lambda a: a["k"],
    )


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = TEMPER, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """The documents' columns, each row as often as drawn, with mix_copy (from 0), mix_copies and mix_key (hexadecimal); dealt out by mix_key and sorted by it in each partition."""
    spark = docs.sparkSession
    rated = stored(rates(docs, weights, temper, epochs)).select(F.col("source").alias("__skyloom_source"), F.col("rate").alias("__skyloom_rate"))
    bound = rated.agg(F.count(F.lit(1)), F.max(F.length("__skyloom_source"))).first()
    small = bound[0] <= MOST_SOURCES and (bound[1] or 0) <= MOST_NAME
    drawn = docs.join(F.broadcast(rated) if small else rated, docs["source"].eqNullSafe(F.col("__skyloom_source")), "left")
    parts = F.greatest(F.lit(1), F.ceil(F.col("__skyloom_rate") / MOST_RATE)).cast("int")
    draw = F.aggregate(
        F.transform(F.sequence(F.lit(1), parts), lambda j: poisson_count(F.col("__skyloom_rate") / parts, _uniform(F.lit(seed), _id(), j.cast("string")))),
        F.lit(0),
        lambda a, k: a + k,
    )
    drawn = drawn.withColumn("__skyloom_n", draw).where("__skyloom_n > 0")
    copies = drawn.withColumn("__skyloom_i", F.explode(F.sequence(F.lit(0), F.col("__skyloom_n") - 1)))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), _id(), F.col("__skyloom_i").cast("string")))
    named = copies.select(*(docs[c] for c in docs.columns if c not in ("mix_copy", "mix_copies", "mix_key")), F.col("__skyloom_i").alias("mix_copy"), F.col("__skyloom_n").alias("mix_copies"), key.alias("mix_key"))
    # md5 keys are uniform: hashing them deals a random set to each partition, and sorting makes each partition's order random, without a pass that samples ranges.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return named.repartition(n, "mix_key").sortWithinPartitions("mix_key")


ORACLE = f"""
WITH RECURSIVE s AS (SELECT source, sum(octet_length(encode(coalesce(text, '')))) AS bytes FROM documents GROUP BY source),
w AS (SELECT source, bytes, CASE WHEN bytes > 0 THEN pow(bytes::DOUBLE, {TEMPER}) ELSE 0 END AS w FROM s),
t AS (SELECT sum(bytes) AS all_bytes, sum(w) AS all_w FROM w),
r AS (SELECT source, CASE WHEN bytes = 0 THEN 1e0 ELSE w * {EPOCHS} * all_bytes::DOUBLE / (all_w * bytes::DOUBLE) END AS rate FROM w, t),
p AS (SELECT source, rate, greatest(1, ceil(rate / {MOST_RATE}))::INT AS parts FROM r),
u AS (SELECT rowid0, doc_id, text, lang, d.source, n_chars, rate / parts AS rate,
  ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) || '|' || j::VARCHAR), 1, 12))::BIGINT::DOUBLE / {float(2**48)} AS u, j
  FROM (SELECT *, row_number() OVER () AS rowid0 FROM documents) d JOIN p ON d.source IS NOT DISTINCT FROM p.source, unnest(range(1, parts + 1)) AS g(j)),
k(rowid0, doc_id, text, lang, source, n_chars, j, u, rate, k, p, c) AS (
  SELECT rowid0, doc_id, text, lang, source, n_chars, j, u, rate, 0, exp(-rate), exp(-rate) FROM u
  UNION ALL
  SELECT rowid0, doc_id, text, lang, source, n_chars, j, u, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM k WHERE u >= c AND k < {MOST_COUNT}),
n AS (SELECT rowid0, doc_id, text, lang, source, n_chars, sum(k)::INT AS n FROM (SELECT rowid0, doc_id, text, lang, source, n_chars, j, max(k) AS k FROM k GROUP BY ALL) GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, i::INT AS mix_copy, n AS mix_copies,
  md5('{SEED}|order|' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) || '|' || i::VARCHAR) AS mix_key
FROM n, unnest(range(0, n)) AS g(i)
"""

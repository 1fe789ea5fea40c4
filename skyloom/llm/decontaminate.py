"""Benchmark decontamination by spaced-seed hashing.

Texts are cut into words (letters and digits, lower-cased).  A document is
contaminated by a benchmark item if ``WINDOW`` consecutive words of the item
stand in the document, at least ``MATCHES`` of them (similarity 0.8) at their
place; items shorter than the window must match as a whole, at the same
similarity.

Words are compared by their 64-bit hashes.  Candidates come from fixed masks that look at some word positions and ignore
the others.  The three long masks are lossless: whichever two of 13 words are
exchanged, one of the masks fits somewhere within the window without touching
either.  Items of 5 to 12 words use five masks over five words, each ignoring
one; they are lossless as well, as some five words of such an item hold at
most one exchange.  Items of one to four words must stand in the document word
for word, as no exchange leaves 0.8 of them.

The masks' hashes of the benchmark go to every task as a broadcast, in blocks
of at most ``BLOCK_SEEDS`` rows; with a larger benchmark the documents are
passed once for each block.  The documents' hashes are made, looked up and
dropped within one stage, so nothing of the documents is shuffled but the
verified hits.  A passage shared by very many documents has one hit for each
of them and no pairs among them.

Everything is built-in functions: no Python runs on the executors.

Edge cases: null texts and texts with few words match nothing; a document may
match several items; repeated documents (equal id and text) are one row in
the report; null ids are reported as null; repeated items count as one each;
empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

WINDOW, SIMILARITY, SHORT = 13, 0.8, 5
#: Word offsets that a mask looks at.
LONG_MASKS = ((0, 1, 2, 4, 5, 6, 7), (0, 1, 2, 3, 5, 8, 9), (0, 1, 3, 6, 7, 8, 10))
SHORT_MASKS = tuple(tuple(o for o in range(SHORT) if o != left) for left in range(SHORT))
#: More words than any text has.
FAR = 1 << 32
#: Places of a text that are looked up as one row, and words that stand around them.
CHUNK, MARGIN = 2000, 32
#: Of hits in a row, each so many-th is verified.
STRIDE = 8
#: Words around a hit: any window that holds its mask, or that of one of the hits it answers for.
REACH = -WINDOW, WINDOW + STRIDE
#: A seed row is three numbers; so many take about 100 MB in an executor.
BLOCK_SEEDS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _hash(array: str, at: Column, mask: tuple[int, ...], number: int) -> Column:
    return F.xxhash64(F.lit(number), *(F.get(F.col(array), at + o) for o in mask))


def _seeds(items: DataFrame, masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """(h, item_key, item_at, mask) of every place where a mask fits into an item."""
    placed = items.select("item_key", "item", F.explode(F.sequence(F.lit(0), F.size("item") - 1)).alias("item_at"))
    rows = placed.select("item_key", "item_at", F.posexplode(F.array(*(F.when(F.col("item_at") + m[-1] < F.size("item"), _hash("item", F.col("item_at"), m, i)) for i, m in enumerate(masks)))).alias("mask", "h"))
    return rows.where("h is not null")


def _score(matched: Column, doc_at: Column) -> Column:
    """One number that is larger the more words match, and then the earlier they stand."""
    return matched.cast("long") * FAR + (FAR - 1 - doc_at)


def _chunks(docs: DataFrame) -> DataFrame:
    """Documents of key, words in rows of CHUNK places: key, from_word (number of the first word here), places (where the chunk's own begin and end), words.

    Before a stage's generated code passes rows on it gathers all that come
    from one input row, so that row has to be of bounded size.  The
    transform, which turns words into their hashes, ends the generated stage.
    """
    starts = docs.select("key", "words", F.size("words").alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - 1), F.lit(CHUNK))).alias("start"))
    lo = F.greatest(F.lit(0), F.col("start") - MARGIN)
    hi = F.least(F.col("n"), F.col("start") + CHUNK + MARGIN)
    return starts.select("key", lo.alias("from_word"), (F.col("start") - lo).alias("first"), (F.least(F.col("n"), F.col("start") + CHUNK) - lo).alias("end"), F.transform(F.slice("words", lo + 1, hi - lo), lambda w: F.xxhash64(w)).alias("words"))


def _hits(docs: DataFrame, items: DataFrame, masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """Verified hits of documents with the columns of key, words: key, item_id, window, score.

    The look-up is one generated stage, kept small enough to be compiled; what
    leaves it are the words around a hit.  Of several hits of one mask in a
    row on one diagonal the first is taken and every STRIDE-th, which then
    answer for the windows of those between.
    """
    chunked = _chunks(docs)
    placed = chunked.select("key", "from_word", "words", F.explode(F.when(F.col("first") < F.col("end"), F.sequence(F.col("first"), F.col("end") - 1))).alias("at"))
    # A mask that runs over the text's end hashes nulls, which no seed does.
    hashed = placed.select("key", "from_word", "words", "at", F.explode(F.array(*(_hash("words", F.col("at"), m, i) for i, m in enumerate(masks)))).alias("h"))
    met = hashed.join(F.broadcast(_seeds(items, masks)), "h")
    # Words from REACH[0] before a hit, as far as the text has them.
    lo = F.greatest(F.lit(REACH[0]), -F.col("at"))
    hi = F.least(F.lit(REACH[1]), F.size("words") - F.col("at"))
    around = F.struct((F.col("from_word") + F.col("at")).alias("at"), lo.alias("lo"), F.slice("words", F.col("at") + lo + 1, hi - lo).alias("w"))
    near = met.select("key", "item_key", "item_at", "mask", F.explode(F.array(around)).alias("a"))
    near = near.select("key", "item_key", "item_at", "mask", "a.at", "a.lo", F.transform("a.w", lambda w: w).alias("w")).join(F.broadcast(items), "item_key")
    if masks is LONG_MASKS:
        # A hit one place earlier on the diagonal: all the words that the mask looks at are the same there as well.
        before = F.lit(False)
        for i, mask in enumerate(masks):
            same = F.lit(True)
            for o in mask:
                same = same & F.get("w", o - 1 - F.col("lo")).eqNullSafe(F.get("item", F.col("item_at") + o - 1))
            before = before | ((F.col("mask") == i) & same)
        near = near.where((F.col("item_at") % STRIDE == 0) | (F.col("at") == 0) | ~before)
    shift = F.greatest(F.col("lo"), -F.col("item_at"))
    length = F.least(F.size("w") - (shift - F.col("lo")), F.size("item") - F.col("item_at") - shift)
    window = F.least(F.lit(WINDOW), F.size("item"))
    pairs = F.zip_with(F.slice("w", shift - F.col("lo") + 1, length), F.slice("item", F.col("item_at") + shift + 1, length), lambda x, y: (x == y).cast("int"))
    told = near.select("key", "item_id", window.alias("window"), (F.col("at") + shift).alias("doc_at"), pairs.alias("same"))
    sums = F.transform(F.sequence(F.lit(0), F.size("same") - F.col("window")), lambda k: _score(F.aggregate(F.slice("same", k + 1, F.col("window")), F.lit(0), lambda t, x: t + x), F.col("doc_at") + k))
    return told.select("key", "item_id", "window", F.array_max(F.when(F.size("same") >= F.col("window"), sums)).alias("score")).where("score is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """One row per document and item found in it: doc_id, mark (a hash of the text), item_id, window, matched, doc_at (word offset of the best window)."""
    items = stored(benchmark.select("item_id", words(text_of()).alias("item")).where(F.size("item") > 0).select("item_id", F.transform("item", lambda w: F.xxhash64(w)).alias("item")).distinct().withColumn("item_key", F.xxhash64("item")))
    keyed = docs.select(F.struct("doc_id", F.xxhash64(text_of()).alias("mark")).alias("key"), words(text_of()).alias("words"))
    found = []
    size = F.size("item")
    whole = [((tuple(range(n)),), size == n) for n in range(1, SHORT)]
    for masks, of in ((LONG_MASKS, size >= WINDOW), (SHORT_MASKS, (size >= SHORT) & (size < WINDOW)), *whole):
        own = items.where(of)
        seeds = own.agg(F.sum(F.size("item"))).first()[0] or 0
        blocks = -(-seeds * len(masks) // block_seeds)
        for i in range(blocks):
            found.append(_hits(keyed, own.where(F.pmod("item_key", F.lit(blocks)) == i), masks))
    if not found:
        found = [keyed.select("key", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("window"), F.lit(0).cast("long").alias("score")).where("false")]
    best = reduce(DataFrame.unionByName, found).groupBy("key", "item_id", "window").agg(F.max("score").alias("score"))
    matched, rest = F.floor(F.col("score") / FAR).cast("int"), F.pmod(F.col("score"), F.lit(FAR))
    told = best.select("key.doc_id", "key.mark", "item_id", "window", matched.alias("matched"), (FAR - 1 - rest).cast("int").alias("doc_at"))
    return told.where(F.col("matched") >= F.ceil(F.col("window") * SIMILARITY))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark passage, with their own columns."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("__skyloom_id"), F.col("mark").alias("__skyloom_mark")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__skyloom_id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__skyloom_mark")), "left_anti")


ORACLE = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS doc_at, len(w) AS n FROM d),
iw AS (SELECT item_id, unnest(w) AS word, unnest(range(len(w))) AS item_at, len(w) AS n, least({WINDOW}, len(w)) AS win FROM i),
m AS (SELECT doc_id, item_id, doc_at - item_at AS diagonal, item_at, win, iw.n AS item_n, dw.n AS doc_n FROM dw JOIN iw USING (word)),
near AS (SELECT * FROM m WHERE true QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, diagonal) >= ceil(win * 0.8)),
s AS (SELECT DISTINCT doc_id, item_id, diagonal, win, item_n, doc_n FROM near),
starts AS (SELECT s.*, unnest(range(greatest(0, -diagonal), least(item_n, doc_n - diagonal) - win + 1)) AS k FROM s),
c AS (SELECT t.doc_id, t.item_id, t.win, t.diagonal, t.k, count(*) AS matched FROM starts t JOIN near n
      ON n.doc_id = t.doc_id AND n.item_id = t.item_id AND n.diagonal = t.diagonal AND n.item_at >= t.k AND n.item_at < t.k + t.win GROUP BY ALL)
SELECT doc_id, item_id, any_value(win)::INT AS "window", max(matched)::INT AS matched,
  min(k + diagonal) FILTER (matched = best)::INT AS doc_at
FROM (SELECT *, max(matched) OVER (PARTITION BY doc_id, item_id) AS best FROM c) WHERE best >= ceil(win * 0.8) GROUP BY doc_id, item_id
"""

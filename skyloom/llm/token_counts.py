"""Token counts without token ids.

Byte-level BPE never merges across pre-tokens, so a text has as many tokens as
its pre-tokens have pieces.  Pieces are counted once per distinct pre-token:

1. vocabulary: pre-tokens are counted per task and flushed as (pre-token,
   count) rows, summed by a shuffle; each distinct one is encoded once.
2. The common part of the vocabulary is the part of it above a count chosen,
   from a histogram with one row per power step, so that at most
   ``COMMON`` pre-tokens of at most ``COMMON_CHARS`` characters pass.  That
   bounded table goes to every task.
3. Per document, pre-token frequencies meet the common table at once; the
   remaining (document, pre-token, frequency) rows are joined to the
   vocabulary by a shuffle.  Those are rare pre-tokens, and longer ones than
   COMMON_CHARS, which may stand in very many documents: such words are
   salted, rows by their document and the vocabulary by ``SALTS`` copies, so that no key is hot.
   What a document has by the common table is a row without a word, which
   meets nothing; such rows are dealt out by their document.

A document is named by its id and a 128-bit hash of its text.  Rows repeating
both are counted together and written out again.

Special strings inside a text are what the library makes of them by default:
one token each, cutting the text.

Edge cases: null text counts as empty (0 bytes, 0 tokens); null ids stay null;
repeated rows give one row each; a text may be one very long pre-token; an
empty table gives no rows.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, text_of

LIMIT = 512
COMMON, COMMON_CHARS = 300_000, 64
#: Distinct pre-tokens a task holds before it passes its counts on.
HELD, HELD_CHARS = 200_000, 8_000_000
#: Histogram steps for each doubling of the count.
STEPS = 4
SLICE = 200
#: Parts that the rows of a long pre-token are dealt into.
SALTS = 64
REPEATS = 10_000

FREQUENCIES = "doc_id long, mark string, n_bytes long, word string, times long"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _cutter(path: str):
    """The pre-token pattern of the byte-level scheme, and the pattern of special strings or None."""
    import public_tokenizers

    special = sorted((t.content for t in _tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    return regex.compile(public_tokenizers.PATTERN), regex.compile("|".join(map(regex.escape, special))) if special else None


#: Texts of ASCII and Latin characters alone, without fractions and raised digits, are cut by a shorter pattern, to the same pre-tokens.
_OTHER = re.compile("[^\x00-\u024f]|[\xb2\xb3\xb9\xbc-\xbe]")
_SPACE = r"\t-\r \x85\xa0"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w{_SPACE}]|_)+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


@cache
def _unassigned() -> frozenset[str]:
    """Characters whose class the library and the pattern engine may see differently: those newer than Python's own tables."""
    return frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")


def plain_pre_tokens(text: str, path: str) -> list[str]:
    """Pre-tokens of a text without regard to special strings."""
    if not _OTHER.search(text):
        return _LATIN.findall(text)
    if _unassigned().isdisjoint(text):
        return _cutter(path)[0].findall(text)
    return [text[a:b] for _, (a, b) in _tokenizer(path).pre_tokenizer.pre_tokenize_str(text)]


def pre_tokens(text: str, path: str) -> tuple[list[str], int]:
    """Pre-tokens of a text, and the number of special strings in it."""
    special = _cutter(path)[1]
    if special is None or not special.search(text):
        return plain_pre_tokens(text, path), 0
    parts = special.split(text)
    return [w for part in parts for w in plain_pre_tokens(part, path)], len(parts) - 1


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE).to_pydict()


def _count_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        chars = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "times": pa.array(list(seen.values()), pa.int64())})

        for rows in _texts(batches):
            before = len(seen)
            for text in rows["text"]:
                seen.update(pre_tokens(text, path)[0])
            if len(seen) > before:
                chars += sum(map(len, rows["text"])) // 8
            if len(seen) > HELD or chars > HELD_CHARS * 8:
                yield flush()
                seen.clear()
                chars = 0
        if seen:
            yield flush()

    return run


def _pieces(path: str):
    def count(words: pa.Array) -> pa.Array:
        encoder = _tokenizer(path)
        return pa.array([len(e) for e in encoder.encode_batch(words.to_pylist(), add_special_tokens=False)], pa.int64())

    return F.arrow_udf(count, "long")


def vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """(word, times, pieces): each distinct pre-token of the corpus."""
    counted = docs.select(text_of().alias("text")).mapInArrow(_count_words(path), "word string, times long")
    return counted.groupBy("word").agg(F.sum("times").alias("times")).withColumn("pieces", _pieces(path)("word"))


def common(words: DataFrame, most: int = COMMON) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens; at most ``most`` of them."""
    short = words.where(F.length("word") <= COMMON_CHARS)
    step = F.floor(F.log2(F.col("times")) * STEPS).cast("int")
    total, least = 0, None
    for row in sorted(short.groupBy(step.alias("step")).count().collect(), reverse=True):  # at most 64 * STEPS rows
        total += row["count"]
        if total > most:
            break
        least = row["step"]
    if least is None:
        return {}
    return {r.word: r.pieces for r in short.where(step >= least).select("word", "pieces").toLocalIterator()}


def _frequencies(path: str, known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = known.value
        for rows in _texts(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, mark, text in zip(rows["doc_id"], rows["mark"], rows["text"], strict=True):
                words, total = pre_tokens(text, path)
                rest: Counter = Counter()
                for word in words:
                    n = pieces.get(word)
                    if n is None:
                        rest[word] += 1
                    else:
                        total += n
                for row in ((doc_id, mark, len(text.encode()), None, total), *((doc_id, mark, None, w, n) for w, n in rest.items())):
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()), pa.array(out[4], pa.int64())], names=["doc_id", "mark", "n_bytes", "word", "times"])

    return run


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, most_common: int = COMMON) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    path = path or default_path()
    spark = docs.sparkSession
    small_batches(spark)
    words = stored(vocabulary(docs, path))
    known = spark.sparkContext.broadcast(common(words, most_common))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.substring(F.sha2(text_of(), 256), 1, 32).alias("mark"), text_of().alias("text"))
    found = rows.mapInArrow(_frequencies(path, known), FREQUENCIES)
    long = F.length("word") > COMMON_CHARS
    by_document = F.xxhash64("doc_id", "mark")
    rare = words.select("word", "pieces", F.explode(F.when(long, F.array(*map(F.lit, range(SALTS)))).otherwise(F.array(F.lit(0))).cast("array<long>")).alias("salt"))
    dealt = found.withColumn("salt", F.when(F.col("word").isNull(), by_document).when(long, F.pmod(by_document, F.lit(SALTS))).otherwise(0))
    summed = dealt.join(rare, ["word", "salt"], "left").groupBy("doc_id", "mark").agg(F.sum(F.col("times") * F.coalesce("pieces", F.lit(1))).alias("all"), F.max("n_bytes").alias("n_bytes"), F.count_if(F.col("word").isNull()).alias("rows"))
    # Equal rows were summed together.
    each = summed.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / REPEATS)))).withColumn("i", F.explode(F.sequence(F.col("block") * REPEATS, F.least((F.col("block") + 1) * REPEATS, "rows") - 1)))
    n = F.expr("`all` div `rows`")
    return each.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))

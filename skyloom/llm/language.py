"""Language identification by prediction by partial matching (PPM).

For each language a context tree of bytes up to order ``ORDER`` is counted over
a bounded sample of labelled documents, and then frozen.  The code length of a
byte after a context follows escape method C: with probability
d / (n + d) the coder escapes to the next shorter context (n symbols seen
here, d of them distinct), else the byte costs -log2(count / (n + d)).  Below order
0 all 256 bytes are equally likely.  The language whose tree codes the whole text in the fewest bits
wins.

Scoring needs no tree walk: the contexts of all trees are merged, every
context gets the id of its longest known suffix, and the code length of each
byte after each context is a row of a table with one entry per language.  A
text is scored by a few array look-ups over all its bytes, which yields the
exact code lengths.  ``TOGETHER`` languages share such a table; more of them
have more tables.  All labelled languages are learned and all contexts of
their samples are kept, so what is broadcast is bounded by the bytes of the
samples times the number of different bytes in a table.

Text is lower-cased, and digits, ASCII punctuation and white space are
replaced by a space before coding, both in training and in scoring.

Edge cases: a text that is null or has no letter is ``und`` with score 0; with
one known language or none, texts with letters get that language, or ``und``;
ties go to the language that comes first in the alphabet; repeated rows and
null ids are scored like any other; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, small_batches, text_of

ORDER = 3
#: Bounds of the training sample for each language: bytes that are counted, documents, and letters of each (its first ones count).
TRAINING_BYTES, DOCUMENTS, LETTERS = 600_000, 300, 20_000
#: Languages whose code lengths stand in one table.  Each table has all contexts that its languages have.
TOGETHER = 16
#: Bits a byte by which a rival must be worse to halve its share of the score, as a fraction of one bit.
HALVING = 1 / 20
MIN_SCORE = 0.5
UNKNOWN = "und"
#: Bytes scored at once, and texts fetched at once.
BLOCK, SLICE = 1 << 20, 100

#: ASCII other than letters is coded as a space.
_TABLE = bytes(32 if b < 128 and not chr(b).isalpha() else b for b in range(256))


def cleaned(text: str) -> bytes:
    """The bytes that are coded, behind ORDER spaces which are only context."""
    return b" " * ORDER + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()) + b" "


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


@dataclass
class Trees:
    """Merged context trees of some languages.

    symbols maps bytes to codes; all bytes never seen share the last code.
    Contexts of one byte have the byte's code as id.  pair[a, b] is the id of
    a known context of two or -1; two[a, b] and three[pair[a, b] - n, c] are
    the ids of the longest known suffixes of ab and abc.  bits[context *
    n + byte, language] are code lengths.
    """

    languages: list[str]
    symbols: np.ndarray
    pair: np.ndarray
    two: np.ndarray
    three: np.ndarray
    bits: np.ndarray

    def contexts(self, codes: np.ndarray) -> np.ndarray:
        """The context of each byte from number ORDER on."""
        a, b, c = codes[:-3], codes[1:-2], codes[2:-1]
        first = self.pair[a, b]
        return np.where(first >= 0, self.three[first - len(self.pair), c], self.two[b, c])

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each cleaned text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        n = len(self.pair)
        at = 0
        while at < len(texts):  # as many texts as fill a block, or a single long one
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= BLOCK:
                size += len(texts[end])
                end += 1
            sizes = np.fromiter(map(len, texts[at:end]), dtype=np.int64, count=end - at)
            data = self.symbols[np.frombuffer(b"".join(texts[at:end]), dtype=np.uint8)]
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            for lo in range(0, len(data) - ORDER, BLOCK):
                codes = data[lo : lo + BLOCK + ORDER]
                rows = self.contexts(codes) * n + codes[ORDER:]
                # Bytes behind a text's border have contexts from the text before: those are the ORDER spaces, which are not counted.
                first = np.maximum(starts + ORDER, lo + ORDER) - lo - ORDER
                last = np.minimum(starts + sizes, lo + ORDER + len(rows)) - lo - ORDER
                for i in np.flatnonzero(last > first):
                    out[at + i] += self.bits[rows[first[i] : last[i]]].sum(axis=0, dtype=np.float64)
            at = end
        return out



@dataclass
class Model:
    """The trees of all languages, in the order of their names."""

    groups: list[Trees]

    @property
    def languages(self) -> list[str]:
        return [k for g in self.groups for k in g.languages]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each cleaned text in each language."""
        return np.hstack([g.lengths(texts) for g in self.groups] or [np.zeros((len(texts), 0))])

    def predict(self, text: str) -> tuple[str, float]:
        return self.predict_all([text])[0]

    def predict_all(self, texts: list[str]) -> list[tuple[str, float]]:
        coded = [cleaned(t) for t in texts]
        names = self.languages
        if not names:
            return [(UNKNOWN, 0.0)] * len(texts)
        out = []
        for text, data, bits in zip(texts, coded, self.lengths(coded), strict=True):
            if not has_letter(text):
                out.append((UNKNOWN, 0.0))
                continue
            best = int(bits.argmin())
            worse = (bits - bits[best]) / max(1, len(data) - ORDER) / HALVING
            out.append((names[best], float(1 / np.exp2(-worse).sum())))
        return out


def train(texts: dict[str, list[str]], together: int = TOGETHER) -> Model:
    """Count the trees of each language and freeze them as look-up tables."""
    names = sorted(texts)
    return Model([_grown({k: texts[k] for k in names[at : at + together]}) for at in range(0, len(names), together)])


def _grown(texts: dict[str, list[str]]) -> Trees:
    languages = list(texts)
    data = {k: b"".join(map(cleaned, texts[k])) for k in languages}
    seen = sorted({*b"".join(data.values())} | {32})
    n = len(seen) + 1  # the last code is any other byte
    symbols = np.full(256, n - 1, dtype=np.int64)
    symbols[seen] = np.arange(n - 1)
    grams = []  # for each order, (codes, counts) of each language
    for order in range(ORDER + 1):
        own = []
        for k in languages:
            codes = symbols[np.frombuffer(data[k], dtype=np.uint8)]
            key = np.zeros(max(0, len(codes) - ORDER), dtype=np.int64)
            for j in range(ORDER - order, ORDER + 1):
                key = key * n + codes[j : j + len(key)]
            own.append(np.unique(key, return_counts=True))
        grams.append(own)

    def code_lengths(order: int, contexts: np.ndarray, below: np.ndarray) -> np.ndarray:
        """bits[context, byte, language] of the contexts (sorted keys), from those of their suffixes."""
        out = below.copy()
        for i, (key, count) in enumerate(grams[order]):
            counts = np.zeros(out.shape[:2])
            counts[np.searchsorted(contexts, key // n), key % n] = count
            total, distinct = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                own = np.log2(total + distinct) - np.log2(counts)
                escape = np.log2(total + distinct) - np.log2(distinct)
            out[:, :, i] = np.where(total == 0, below[:, :, i], np.where(counts > 0, own, escape + below[:, :, i]))
        return out

    def known(order: int) -> np.ndarray:
        """Keys of the contexts of an order, sorted."""
        return np.unique(np.concatenate([key // n for key, _ in grams[order]]))

    floor = np.full((1, n, len(languages)), 8.0)
    zero = code_lengths(0, np.zeros(1, dtype=np.int64), floor)
    one = code_lengths(1, np.arange(n), np.repeat(zero, n, axis=0))
    # A context of three bytes begins with one of two, behind the first of which a text begins.
    pairs = np.union1d(known(2), known(3) // n)
    double = code_lengths(2, pairs, one[pairs % n])
    pair = np.full(n * n, -1, dtype=np.int64)
    pair[pairs] = n + np.arange(len(pairs))
    two = np.where(pair >= 0, pair, np.tile(np.arange(n), n))
    triples = known(3)
    all_bits = np.concatenate([one, double])
    triple = code_lengths(3, triples, all_bits[two[triples % (n * n)]])
    three = two[(pairs % n)[:, None] * n + np.arange(n)[None, :]].reshape(-1, n)
    where = pair[triples // n] - n
    three[where, triples % n] = n + len(pairs) + np.arange(len(triples))
    bits = np.concatenate([all_bits, triple]).reshape(-1, len(languages)).astype(np.float32)
    return Trees(languages, symbols, pair.reshape(n, n), two.reshape(n, n), three if len(three) else np.zeros((1, n), dtype=np.int64), bits)


def sample(docs: DataFrame, documents: int = DOCUMENTS, most: int = TRAINING_BYTES, letters: int = LETTERS) -> dict[str, list[str]]:
    """Texts to learn from, by language: a bounded sample, by a hash of the ids, of the rows that are not held out."""
    rows = docs.select("doc_id", "lang", text_of().alias("text")).where(F.col("lang").isNotNull() & ~held_out())
    counts = rows.groupBy("lang").count().withColumn("share", documents / F.col("count")).drop("count")  # one row for each language
    chance = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text"))), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.withColumn("chance", chance).join(F.broadcast(counts), "lang").where("chance < share").select("lang", "chance", "doc_id", F.substring("text", 1, letters).alias("text"))
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("chance", "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1))
    texts: dict[str, list[str]] = {r.lang: [] for r in counts.collect()}
    for row in chosen.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < most).orderBy("lang", "chance", "doc_id").select("lang", "text").collect():
        texts[row.lang].append(row.text)
    return texts


def predictor(docs: DataFrame, model: Model | None = None):
    """A column function: text to struct(lang, score), learned from docs unless a model is given."""
    spark = docs.sparkSession
    small_batches(spark)
    frozen = spark.sparkContext.broadcast(model or train(sample(docs)))

    def predict(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for at in range(0, len(texts), SLICE):
            for lang, score in frozen.value.predict_all(texts.slice(at, SLICE).to_pylist()):
                names.append(lang)
                scores.append(score)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return F.arrow_udf(predict, "lang string, score double")


def language_id(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    found = docs.select("doc_id", held_out().alias("held_out"), predictor(docs, model)(text_of()).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def accepted_documents(docs: DataFrame, model: Model | None = None, least: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is known with at least the given score, with their own columns."""
    key = "__skyloom_language"
    kept = docs.withColumn(key, predictor(docs, model)(text_of())).where((F.col(f"{key}.lang") != UNKNOWN) & (F.col(f"{key}.score") >= least))
    return kept.select(*(docs[c] for c in docs.columns))

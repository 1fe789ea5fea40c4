"""Toxicity by a subsequence string-kernel support vector machine.

The kernel of two strings sums over the common subsequences of ``LENGTH``
letters, each weighed by a decay to the number of letters that it spans in
either string, and is raised to a power.  There are two of them (``KERNELS``):
with little decay, letters put in between lower it by little, at however many
places they stand; with much, only letters that stand together count.  No word
is more like a landmark than the landmark itself.  The kernel of two sentences is
the sum over the pairs of their words (a convolution kernel), so every word
counts with all its letters: no word and no pair is left out.

``Landmarks`` are letter n-grams of both classes.  Nyström's map, the inverse
square root of the landmarks' own kernel matrix, turns the kernels with them
into the features of a linear squared-hinge machine.  As a sentence's features
are sums over its words, its margin is too: a word is compared with all
landmarks once in a worker and then is a number.

Words are lower-cased, digits that stand for letters become letters, all else
that is no letter is dropped, and letters standing alone in a row
("i d i o t") are one word.

Training.  Toxic landmarks are n-grams of ``GRAMS`` letters that toxic documents
have and clean ones have not, chosen greedily by the occurrences which no earlier one covers;
clean ones are the clean documents' words that are most like those.
Labels belong to documents; a toxic one lends its label to its highest-scoring sentence and all above
``NEAR``, found again in each round, a clean one to all of its sentences.  A
document's score is a logistic function of the highest margin of its sentences,
of the sum of how far they lie above a sentence without features, and of that
sum by the number of words.

Edge cases: null and empty texts get the score of a text without words;
without labels of both kinds every score is the share of toxic labels (0 if
there are none); repeated rows give one row each; null ids are scored and
never learned from; very long words are cut into overlapping
windows; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, id_crc, small_batches, stored, text_of

LENGTH = 4
#: (decay, power) of each kernel; the first is for what stands together, the second for what letters were put into.
KERNELS = ((0.5, 3), (0.95, 2))
DECAYS = tuple(decay for decay, _ in KERNELS)
THRESHOLD = 0.3
#: Bound of the training sample, by a hash of the ids: toxic and clean documents, and the letters of each.
TOXIC, CLEAN, LETTERS = 1500, 2500, 20_000
#: Bounds of the landmarks of either class, and letters of toxic ones (with the mark of a beginning).
LANDMARKS, OTHERS, GRAMS = 48, 14, (4, 10)
#: A landmark stands in toxic documents in this share of its occurrences at least, and covers so many that no earlier one does (or so many for each toxic document).
PRECISION, COVERS, COVERED = 0.85, 6, 0.025
WINDOW, OVERLAP = 32, 12
#: Words of a sentence.
SENTENCE = 40
#: Words that are compared at once.
BLOCK = 512
#: Numbers that a document is judged by.
TRAITS = 3
#: Margin from which a toxic document's sentences are toxic, apart from its highest.
NEAR = 0.5
#: What a sentence must lie above one without any features to count.
FLOOR = 0.5
#: Weight of a toxic sentence, a clean one's being 1.
WEIGHT = 80.0
#: Share of the toxic sentences' weight that landmarks with letters put in have, and the penalty of the weights.
HIDDEN, PENALTY = 1.0, 1e-6
#: Words whose margins a worker keeps.
KEPT = 400_000

#: Stands before a word; a letter of the kernel like any other.
BEGIN = "^"
_LOOKALIKES = str.maketrans("0134578@", "oieastba")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_SPACED = re.compile(r"(?<!\w)\w(?:[ .\-_*]\w){3,}(?!\w)")
_NOT_LETTER = re.compile(r"[\W\d_]+")
#: Stands behind the end of a landmark, and is no letter.
_NOTHING = 0xFFFFFFFF


def normalised(word: str) -> str:
    """The word's letters behind a mark for its beginning."""
    if not word.isalpha():
        if any(c.isalpha() for c in word):
            word = word.strip(".,;:!?()[]\"'").translate(_LOOKALIKES)
        word = _NOT_LETTER.sub("", word)
    return BEGIN + word


class Forms(dict):
    """Normalised forms of words, each made once."""

    def __missing__(self, word: str) -> str:
        self[word] = form = normalised(word)
        return form


def windows(word: str) -> list[str]:
    if len(word) <= WINDOW:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - OVERLAP, WINDOW - OVERLAP)]


def coded(words: list[str]) -> np.ndarray:
    width = max(map(len, words), default=1) or 1
    return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)


def subsequences(codes: np.ndarray, landmarks: np.ndarray, decays: tuple[float, ...]) -> np.ndarray:
    """Subsequence kernel for each decay of each row of codes (words of one length) with each column of landmarks (_NOTHING behind their ends).

    inner[q][j]: matches of q letters that end before the present letter of
    the word and before letter j of the landmark.  A match from place (a, b)
    to (i, j) is weighed by decay ** (i - a + j - b + 2): the power of a and b is put
    in with its first letter and that of i and j with its last, so that between them matches are just summed.
    Places with too few letters before or behind them for a whole match are left out: with the
    longest landmarks first, those that have enough are the first ones.
    """
    n, letters = codes.shape
    m, k = landmarks.shape
    lengths = (landmarks != _NOTHING).sum(0)
    order = np.argsort(-lengths, kind="stable")
    landmarks = landmarks[:, order]
    having = [int((lengths >= size).sum()) for size in range(m + 1)]
    inner = [[np.zeros((m, k, n), np.float32) for _ in range(LENGTH)] for _ in decays]
    total = np.zeros((len(decays), k, n), np.float32)
    hits = np.zeros((m, k, n), np.float32)
    met, run = np.empty((k, n), np.float32), np.empty((k, n), np.float32)
    for i in range(letters):
        letter = np.ascontiguousarray(codes[:, i])
        for j in range(m):
            hits[j, : having[j + 1]] = landmarks[j, : having[j + 1], None] == letter
        for d, decay in enumerate(decays):
            own = inner[d]
            if i >= LENGTH - 1:
                for j in range(LENGTH - 1, m):
                    c = having[j + 1]
                    np.multiply(hits[j, :c], own[LENGTH - 1][j, :c], out=met[:c])
                    met[:c] *= np.float32(decay ** (i + j + 2))
                    total[d, :c] += met[:c]
            for q in range(min(LENGTH - 1, i + 1), max(0, LENGTH - letters + i), -1):
                run[:] = 0
                for j in range(q, m - LENGTH + q + 1):
                    c = having[j + LENGTH - q]
                    before = np.float32(1 / decay ** (j - 1 + i)) if q == 1 else own[q - 1][j - 1, :c]
                    run[:c] += np.multiply(hits[j - 1, :c], before, out=met[:c])
                    own[q][j, :c] += run[:c]
    out = np.empty_like(total)
    out[:, order] = total
    return out.transpose(0, 2, 1)


def kernels(words: list[str], strings: list[str], decays: tuple[float, ...]) -> np.ndarray:
    """[decay, word, string]: the kernel; that of a long word is the largest of its windows."""
    out = np.zeros((len(decays), len(words), len(strings)), dtype=np.float32)
    if not strings:
        return out
    held = coded(strings).T.astype(np.uint32)
    held = np.where(held == 0, np.uint32(_NOTHING), held)
    by_length: dict[tuple[int, bool], list[tuple[int, str]]] = {}
    for i, word in enumerate(words):
        for part in windows(word):
            if len(part) >= LENGTH:
                by_length.setdefault((len(part), len(word) > WINDOW), []).append((i, part))
    for (_, several), parts in by_length.items():
        codes = coded([p for _, p in parts])
        rows = np.array([i for i, _ in parts])
        for at in range(0, len(parts), BLOCK):
            found, own = subsequences(codes[at : at + BLOCK], held, decays), rows[at : at + BLOCK]
            if several:
                for d in range(len(decays)):
                    np.maximum.at(out[d], own, found[d])
            else:
                out[:, own] = found
    return out


@dataclass
class Landmarks:
    strings: list[str]
    own: list[np.ndarray] = field(init=False)
    roots: list[np.ndarray] = field(init=False)

    def __post_init__(self) -> None:
        self.own, self.roots = [], []
        for raw, (_, power) in zip(kernels(self.strings, self.strings, DECAYS).astype(np.float64), KERNELS, strict=True):
            self.own.append(np.diag(raw).copy())
            values, vectors = np.linalg.eigh((raw / np.sqrt(np.outer(self.own[-1], self.own[-1]))) ** power)
            self.roots.append(vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T)

    @property
    def width(self) -> int:
        return len(KERNELS) * len(self.strings)

    def features(self, words: list[str]) -> np.ndarray:
        """Nyström features of each word; those of a sentence are the sum of its words'.  No word is more like a landmark than that itself."""
        return np.hstack([np.minimum(1, raw / own.astype(np.float32)) ** power @ root.astype(np.float32) for raw, (_, power), own, root in zip(kernels(words, self.strings, DECAYS), KERNELS, self.own, self.roots, strict=True)])


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence, one of more than SENTENCE words being cut; letters standing alone in a row are a word besides."""
    lowered = text.lower()
    spaced = bool(_SPACED.search(lowered))
    out = []
    for sentence in _SENTENCE.split(lowered):
        words = sentence.split()
        if spaced:
            words += _SPACED.findall(sentence)
        out += [words[at : at + SENTENCE] for at in range(0, len(words), SENTENCE)]
    return out


@dataclass
class Machine:
    landmarks: Landmarks
    weights: np.ndarray
    bias: float
    slopes: np.ndarray
    offset: float
    cache: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "cache": {}}

    def margins(self, texts: list[str]) -> list[np.ndarray]:
        """The margin of each sentence of each text."""
        if not self.landmarks.strings:
            return [np.zeros(0)] * len(texts)
        if len(self.cache) > KEPT:
            self.cache.clear()
        cut = [sentences(t) for t in texts]
        new = list({w for text in cut for words in text for w in words} - self.cache.keys())
        forms = list(map(normalised, new))
        plain: dict[str, float] = dict.fromkeys(forms, 0.0)
        distinct = list(plain)
        for at in range(0, len(distinct), 1 << 16):
            some = distinct[at : at + (1 << 16)]
            plain.update(zip(some, (self.landmarks.features(some) @ self.weights).tolist(), strict=True))
        self.cache.update(zip(new, map(plain.__getitem__, forms), strict=True))
        worth = self.cache.__getitem__
        return [np.array([self.bias + sum(map(worth, words)) for words in text]) for text in cut]

    def scores(self, texts: list[str]) -> list[float]:
        traits = np.array([self.traits(t, m) for t, m in zip(texts, self.margins(texts), strict=True)]).reshape(len(texts), TRAITS)
        return (1 / (1 + np.exp(-np.clip(traits @ self.slopes + self.offset, -50, 50)))).tolist()

    def traits(self, text: str, margins: np.ndarray) -> np.ndarray:
        """What a document is judged by: the highest margin of its sentences, the sum of how far they lie above one without features (by FLOOR at least), and that sum by the words."""
        best = np.clip(margins.max(initial=self.bias), -2.0, 2.0)
        total = np.maximum(0, margins - self.bias - FLOOR).sum()
        return np.array([best, np.log1p(total), min(1.0, 10 * total / (20 + text.count(" ") + text.count("\n")))])


def contexts(texts: list[str], forms: Forms) -> Counter:
    """Normalised words, with the number of different neighbours they stand between; so copies of a passage count once."""
    seen: dict[str, set[int]] = {}
    for text in texts:
        lowered = text.lower()
        words = [BEGIN, *map(forms.__getitem__, lowered.split()), BEGIN]
        for before, word, after in zip(words, words[1:], words[2:], strict=False):
            if GRAMS[0] <= len(word) <= 2 * WINDOW:
                seen.setdefault(word, set()).add(hash((before, after)))
        for w in _SPACED.findall(lowered):
            seen.setdefault(normalised(w), set()).add(hash(text))
    return Counter({w: len(c) for w, c in seen.items()})


def grams(word: str) -> set[str]:
    return {word[i : i + n] for n in range(*GRAMS) for i in range(len(word) - n + 1)}


def choose_landmarks(bad: Counter, good: Counter, documents: int, most: int = LANDMARKS) -> list[str]:
    """Toxic landmarks from the words of toxic and of clean documents."""
    covers = max(COVERS, documents * COVERED)
    counts: Counter = Counter()
    for word, n in bad.items():
        for g in grams(word):
            counts[g] += n
    usual = {g for g, n in counts.items() if n >= covers}
    outside: Counter = Counter()
    for word, n in good.items():
        for g in usual.intersection(grams(word)):
            outside[g] += n
    # As if there were as many clean words as toxic documents' words.
    ratio = bad.total() / max(1, good.total())
    precision = {g: n / (n + outside[g] * ratio + 0.5) for g, n in counts.items() if n >= covers}
    words: dict[str, set[str]] = {}
    for word in bad:
        for g in grams(word):
            if precision.get(g, 0) >= PRECISION:
                words.setdefault(g, set()).add(word)
    left = {g: sum(bad[w] for w in ws) for g, ws in words.items()}
    chosen: list[str] = []
    while len(chosen) < most:
        # What is left of an n-gram must still be toxic by itself.
        left = {g: n for g, n in left.items() if n >= covers and n >= PRECISION * (n + outside[g] * ratio + 0.5)}
        if not left:
            break
        top = max(left.values())
        # Of the n-grams that cover nearly as much, the surest and then the longest.
        best = max((g for g, n in left.items() if n >= 0.75 * top), key=lambda g: (round(precision[g], 1), len(g), g))
        chosen.append(best)
        for word in words.pop(best):
            for g in grams(word):
                if g in left and word in words.get(g, ()):
                    words[g].discard(word)
                    left[g] -= bad[word]
        del left[best]
    return chosen


def rivals(toxic: list[str], good: Counter, most: int = OTHERS) -> list[str]:
    """Clean landmarks: words of clean documents, no more than a few for each toxic landmark, that are like it by the kernel but do not hold it; weighed by how often they stand."""
    words = [w for w, _ in sorted(good.items(), key=lambda x: (-x[1], x[0]))[: 200 * most] if GRAMS[0] <= len(w) < GRAMS[1]]
    if not words or not toxic:
        return []
    like = kernels(words, toxic, DECAYS[-1:])[0] / np.diag(kernels(toxic, toxic, DECAYS[-1:])[0]) * np.log1p([good[w] for w in words])[:, None]
    chosen: dict[str, None] = {}
    for place in range(-(-most // len(toxic)) + 2):
        for j in range(len(toxic)):
            order = np.argsort(-like[:, j], kind="stable")
            free = [words[i] for i in order[: 8 + 2 * place] if toxic[j] not in words[i] and like[i, j] > 0 and words[i] not in chosen]
            if free and len(chosen) < most:
                chosen[free[0]] = None
    return [w for w in chosen if not any(z == w for z in toxic)]


def gapped(strings: list[str]) -> list[str]:
    """Each string with a letter put in at one place, and at all."""
    return [v for z in strings for c in "xq" for v in (*(z[:i] + c + z[i:] for i in range(1, len(z))), c.join(z))]


def fit_linear(x: np.ndarray, y: np.ndarray, share: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Squared hinge with the given shares of the rows, by Newton's steps over the rows within the margin."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    ridge = np.r_[np.full(x.shape[1] - 1, penalty), 1e-9]

    def loss(w: np.ndarray) -> float:
        return float(share @ np.maximum(0, 1 - y * (x @ w)) ** 2 + ridge @ w**2)

    w = np.zeros(x.shape[1])
    for _ in range(50):
        near = np.flatnonzero(y * (x @ w) < 1)
        part = x[near].astype(np.float64)
        step = np.linalg.solve((part.T * share[near]) @ part + np.diag(ridge), part.T @ (share[near] * y[near])) - w
        size, now = 1.0, loss(w)
        while size > 1e-3 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if size * np.abs(step).max() < 1e-6 * (1 + np.abs(w).max()):
            break
    return w[:-1], float(w[-1])


def fit_logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes that are not negative, and an offset."""
    x = np.c_[x, np.ones(len(x))]
    used, ridge = np.ones(x.shape[1], dtype=bool), np.r_[np.full(x.shape[1] - 1, 1e-4), 1e-9]
    while True:
        beta = np.zeros(x.shape[1])
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            g = (x.T @ (weight * (p - target)) + ridge * beta)[used]
            h = (x[:, used].T * (weight * p * (1 - p))) @ x[:, used] + np.diag(ridge[used])
            beta[used] -= np.clip(np.linalg.solve(h, g), -1, 1)
        if (beta[:-1] >= 0).all():
            return beta[:-1], float(beta[-1])
        used[:-1] &= beta[:-1] >= 0


def train(toxic: list[str], clean: list[str], share: float) -> Machine:
    """share: the part of the labels that is toxic, for the calibration."""
    prior = float(np.clip(share, 0, 1))
    flat = -50.0 if prior == 0 else float(np.log(prior / (1 - prior))) if prior < 1 else 50.0
    forms = Forms()
    bad, good = (contexts(toxic, forms), contexts(clean, forms)) if toxic and clean else (Counter(), Counter())
    strings = choose_landmarks(bad, good, len(toxic))
    if not strings:
        return Machine(Landmarks([]), np.zeros(0), -1.0, np.zeros(TRAITS), flat)
    landmarks = Landmarks(strings + rivals(strings, good))
    width = landmarks.width
    cut = [[[forms[w] for w in s] for s in sentences(t)] for t in toxic + clean]
    vocabulary = {w: i for i, w in enumerate(sorted({w for text in cut for s in text for w in s}))}
    known = landmarks.features(list(vocabulary))
    rows = [np.array([known[[vocabulary[w] for w in s]].sum(axis=0, dtype=np.float32) for s in text]).reshape(-1, width) for text in cut]
    positive, negative = rows[: len(toxic)], rows[len(toxic) :]
    machine = Machine(landmarks, np.r_[landmarks.roots[0] @ (np.arange(len(landmarks.strings)) < len(strings)), np.zeros(width - len(landmarks.strings))], -1.0, np.zeros(TRAITS), flat)  # the first round takes the sentence most like any toxic landmark
    low = np.vstack([np.zeros((1, width), np.float32), *negative])
    hidden = landmarks.features(gapped(strings))
    for _ in range(4):
        top = np.vstack([r[(best := r @ machine.weights + machine.bias) >= min(best.max(), NEAR)] for r in positive if len(r)])
        # Landmarks with letters put in weigh as much as a part of the toxic sentences.
        share = np.r_[np.full(len(top), WEIGHT), np.full(len(hidden), WEIGHT * HIDDEN * len(top) / len(hidden)), np.ones(len(low))] / (len(top) + len(low))
        y = np.r_[np.ones(len(top) + len(hidden)), -np.ones(len(low))]
        machine.weights, machine.bias = fit_linear(np.vstack([top, hidden, low]), y, share)
    # Logistic regression over documents, each kind weighed as among the labels.
    traits = np.array([machine.traits(t, r @ machine.weights + machine.bias) for t, r in zip(toxic + clean, positive + negative, strict=True)])
    target = np.r_[np.ones(len(positive)), np.zeros(len(negative))]
    weight = np.r_[np.full(len(positive), prior / len(positive)), np.full(len(negative), (1 - prior) / len(negative))]
    machine.slopes, machine.offset = fit_logistic(traits, target, weight)
    return machine


def sample(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> tuple[list[str], list[str], float]:
    """Toxic and clean texts of at most LETTERS letters to learn from, and the share of toxic labels."""
    known = stored(labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n = {r.toxic: r["count"] for r in known.groupBy((F.col("toxic") == 1).alias("toxic")).count().collect()}
    order = (F.xxhash64(id_crc()), F.col("doc_id"))
    ids = [known.where(F.col("toxic") == 1).orderBy(*order).limit(toxic), known.where(F.col("toxic") != 1).orderBy(*order).limit(clean)]
    chosen = stored(ids[0].unionByName(ids[1]))  # at most toxic + clean rows
    rows = docs.select("doc_id", text_of().alias("text")).where(F.length("text").between(1, LETTERS)).join(F.broadcast(chosen), "doc_id")
    found = rows.orderBy("doc_id").limit(2 * (toxic + clean)).collect()
    texts = [list(dict.fromkeys(r.text for r in found if (r.toxic == 1) == bad)) for bad in (True, False)]
    return texts[0], texts[1], n.get(True, 0) / max(1, sum(n.values()))


def scorer(docs: DataFrame, labels: DataFrame, machine: Machine | None = None):
    """A column function: text to score."""
    spark = docs.sparkSession
    small_batches(spark)
    learned = spark.sparkContext.broadcast(machine or train(*sample(docs, labels)))

    def score(texts: pa.Array) -> pa.Array:
        return pa.array(learned.value.scores(texts.to_pylist()), pa.float64())

    return F.arrow_udf(score, "double")


def toxicity(docs: DataFrame, labels: DataFrame, machine: Machine | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    found = docs.select("doc_id", held_out().alias("held_out"), scorer(docs, labels, machine)(text_of()).alias("score"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

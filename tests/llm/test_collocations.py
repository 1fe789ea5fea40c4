"""Phrase mining against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from skyloom.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    """Rows of the contract by counting every phrase."""
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if 2 <= len(p) and a >= least}
        scored = []
        for p, a in often.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in often.items()):
                continue
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def found(docs, **settings):
    return sorted(tuple(r) for r in collocations.collocations(docs, **settings).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["to", "be", "or", "Not", "the", "a.b", "x,", "\u00c9t\u00e9", "\u00e9t\u00e9", "end.", "new\nline", "tab\tbed", "\u3000", "\x1c", "..", "\x0b", "of"]
    texts = [(rng.choice(["en", "fr", None, "und", ""]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    return texts + [("en", None), (None, None), ("fr", ""), ("fr", "to be " * 400)]


@pytest.mark.parametrize("settings", [{}, {"automaton": 40}, {"most_cells": 1 << 22}, {"top": 7}])
def test_phrases_are_the_plain_ones(spark, rows, settings):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert found(docs, least=4, **settings) == plain(rows, 4, settings.get("top", 2000))


def test_blocks_overlap_by_four_words(spark, rows, monkeypatch):
    docs = [[t for lang, t in rows if lang == "en" and t]]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(docs[0]), "text": docs[0]})
    whole = [w for _, words, _ in collocations._blocks(iter([batch])) for w in words]
    monkeypatch.setattr(collocations, "WORDS", 7)
    parts = list(collocations._blocks(iter([batch])))
    assert [w for _, words, overlap in parts for w in words[overlap:]] == whole
    assert all(words[:overlap] == before[1][-overlap:] for before, (_, words, overlap) in zip(parts, parts[1:], strict=False))
    ends = Counter((n, b" ".join(words[e - n + 1 : e + 1])) for _, words, overlap in parts for n, places, *_ in collocations._cells("en", words, overlap, 24) for e in places)
    once = Counter((n, b" ".join(whole[e - n + 1 : e + 1])) for n, places, *_ in collocations._cells("en", whole, 0, 24) for e in places)
    assert ends == once
    shared = type("Shared", (), {"value": ("a", {"en": b"to be\nbe or not\nto"})})
    counted = {r["phrase"]: r["f"] for b in collocations._sum_counts(shared, 1)(collocations._scan(shared)(iter([batch]))) for r in b.to_pylist()}
    assert counted == {p: once[(len(p.split()), p.encode())] for p in counted} and len(counted) >= 2


def test_crowded_sketch_is_still_exact(spark, rows, monkeypatch):
    """Every phrase shares its cell with many others: more candidates, the same result."""
    monkeypatch.setattr(collocations, "BLOCK", 1 << 4)
    monkeypatch.setattr(collocations, "FEWEST_CELLS", 1 << 4)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert found(docs, least=4, bytes_per_cell=10_000) == plain(rows, 4, 2000)


def test_scores_are_exact_beyond_64_bits(spark):
    counts = {"a b": 10**13 + 7, "a": 3 * 10**13 + 1, "b": 9 * 10**13 + 5, "b c": 10**13 + 6, "c": 10**13 + 6}
    n = 7 * 10**14 + 3
    got = collocations.ranked(spark.createDataFrame([("x", p, f) for p, f in counts.items()], "lang string, phrase string, f long"), spark.createDataFrame([("x", n)], "lang string, n long")).collect()
    assert {r.phrase: r.score for r in got} == {p: 1000 * counts[p] * n // (counts[p[0]] * counts[p[2]]) for p in ("a b", "b c")}


def test_documents_table(spark, sf):
    rows = [(r["lang"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet", columns=["lang", "text"]).to_pylist()]
    assert found(spark.read.parquet(f"{sf}/documents.parquet"), least=8) == plain(rows, 8, 2000)

"""Packing and alignment against plain passes, and ids against the libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from skyloom.llm import alignment, packing, token_counts, token_ids

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "b", " ", "  ", "\n", "\u00e9", "<|endoftext|>", "<s>", "<unk>", "\u0558", "1", "\U0001f600", "\u4e2d", "\t", "'s", ".", "\x00", "\x1c", "\u00bd", "_", "\ud7fc"]


@pytest.fixture(scope="module")
def rows(sf):
    return pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()


def odd_texts(n, more=()):
    rng = random.Random(5)
    return ["".join(rng.choice([*ALPHABET, *more]) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def numbers(ids):
    return np.frombuffer(ids, "<u4").tolist()


def test_byte_level_ids_equal_the_library(rows):
    library, plain = Tokenizer.from_file(BYTES), Tokenizer.from_file(BYTES)
    plain.encode_special_tokens = True
    for text in [r["text"] or "" for r in rows] + odd_texts(4000):
        assert numbers(token_ids.byte_level_ids(text, BYTES, True)) == library.encode(text, add_special_tokens=False).ids
        assert numbers(token_ids.byte_level_ids(text, BYTES, False)) == plain.encode(text, add_special_tokens=False).ids


def test_latin_pattern_cuts_like_the_library():
    cutter = Tokenizer.from_file(BYTES).pre_tokenizer
    for i in range(0x250):
        for d in "a1! \n\xa0_'":
            c = chr(i)
            text = f"a{c}{d}b {c}{d}1{c}!{c} {c}{c}{d}  {c}x{d}{d}{c}"
            assert token_counts.plain_pre_tokens(text, BYTES) == [text[a:b] for _, (a, b) in cutter.pre_tokenize_str(text)]


def test_piece_ids_equal_the_library(rows):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in [r["text"] or "" for r in rows] + odd_texts(4000):
        assert numbers(token_ids.piece_ids(text, PIECES)) == library.encode(text)


def plain_best_fit(lengths, capacity):
    """Number of windows by one pass over the sorted pieces."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= length), default=None)
        if fit is None:
            rooms.append(capacity - length)
        else:
            rooms.remove(fit)
            rooms.append(fit - length)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_rules_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 64), rng.randint(1, 8), 64, 33]) for _ in range(400)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    laid = packing.rules(counts, 64).tolist()
    held = defaultdict(list)
    for i, (length, first, window, offset) in enumerate(laid):
        last = laid[i + 1][1] if i + 1 < len(laid) and laid[i + 1][0] == length else counts[length]
        for k in range(last - first):
            held[window + k].append((offset, length))
    rooms = []
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        rooms.append(64 - at)
    assert sorted(rooms) == plain_best_fit(lengths, 64) and sorted(held) == list(range(len(held)))


def test_packing_of_the_documents(spark, sf, rows):
    library = Tokenizer.from_file(BYTES)
    found = packing.pack(spark.read.parquet(f"{sf}/documents.parquet").repartition(7)).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    assert len(pieces) == len(rows)
    for row in rows:
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(pieces[row["doc_id"]], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    used = []
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        used.append(at)
    assert max(used) <= 2048 and sorted(2048 - u for u in used) == plain_best_fit([r.length for r in found], 2048)
    assert sum(2048 - u for u in used if u & (u - 1)) < 0.02 * sum(used)


def test_packing_of_copies(spark):
    docs = spark.createDataFrame([(1, "same words here")] * 300 + [(None, None)] * 50, "doc_id long, text string").repartition(5)
    found = packing.pack(docs).collect()
    assert len(found) == 350 and len({(r.sequence_id, r.offset) for r in found}) == 350
    assert len({r.sequence_id for r in found}) == 1


def plain_alignment(texts):
    """Rows of the contract by loops over tokens."""
    library, pieces = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    library.encode_special_tokens = True
    back = {c: b for b, c in token_ids._alphabet().items()}
    bytes_a = lambda i: bytes(back[c] for c in library.id_to_token(i))

    def bytes_b(i):
        piece = pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("\u2581", " ").encode()

    found = []
    for text in texts:
        a, b = ([], []) if not text else (library.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text))
        ok = text and all(b"".join(map(f, ids)) == (" " + text).encode() for f, ids in ((bytes_a, a), (bytes_b, b)))
        groups = []
        if ok:
            i = j = at_a = at_b = 0
            now = ([], [])
            while i < len(a) or j < len(b):
                if at_a <= at_b:
                    now[0].append(a[i])
                    at_a += len(bytes_a(a[i]))
                    i += 1
                else:
                    now[1].append(b[j])
                    at_b += len(bytes_b(b[j]))
                    j += 1
                if at_a == at_b:
                    groups.append(now)
                    now = ([], [])
        found.append((len(a) if ok else 0, len(b) if ok else 0, groups, Counter((x, y) for g in groups for x in g[0] for y in g[1])))
    counts = Counter(pair for _, _, _, links in found for pair in links)
    highest = Counter()
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = []
    for n_a, n_b, groups, links in found:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), sum(links.values()), sum(t for p, t in links.items() if counts[p] == highest[p[0]]), sum(t * counts[p] for p, t in links.items()), hashlib.sha256(shown.encode()).hexdigest() if shown else ""))
    return out


@pytest.mark.parametrize("common", [1_000_000, 300, 0])
def test_alignment_is_the_plain_one(spark, rows, common):
    texts = [r["text"] for r in rows][:120] + odd_texts(400, ["\u2581", "zzzzzzzz"]) + [None, "", "x" * 5000, "\U0001f600" * 300] + ["same text"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.alignment(docs, most_common=common).collect()}
    assert found == dict(enumerate(plain_alignment(texts)))


def test_wide_groups_are_counted_from_distinct_ids(monkeypatch):
    texts = odd_texts(500, ["zzzzzzzz", "aba"])
    usual = alignment.aligned(texts, BYTES, PIECES)
    monkeypatch.setattr(alignment, "WIDE", 0)
    wide = alignment.aligned(texts, BYTES, PIECES)
    assert usual["n_links"] == wide["n_links"]
    for name in ("pairs", "times"):
        assert all((x == y).all() for x, y in zip(usual[name], wide[name], strict=True))

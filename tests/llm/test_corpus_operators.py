"""The operators against brute force, planted cases and held-out rows."""

import itertools
import re
import time
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skyloom.llm import common, components, decontaminate, exact_dedup, html_text, language, licenses, mixing, personal_data, simhash, token_counts, toxicity


@pytest.fixture(scope="module")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(sf):
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}


def table(sf, name):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


# Personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans(texts):
    rng = np.random.default_rng(1)
    for alphabet in ("0123456789+@.-() ab%,", "12.-+ ", "a@.b_%", "4111 -"):
        for _ in range(4000):
            t = "".join(rng.choice(list(alphabet), rng.integers(0, 50)))
            assert personal_data.base_spans(t) == plain_spans(t)
    for t in texts.values():
        assert personal_data.base_spans(t) == plain_spans(t)


def test_planted_personal_data(spark, small, texts):
    """Data in other forms and repeats of it, through the query's operator: recall and precision of added spans, and the digest columns."""
    import hashlib
    import random

    field = personal_data.train(personal_data.sample(small))
    words = [w for t in texts.values() for w in t.split()[:50] if not re.search("[0-9@]", w)]
    rng = random.Random(11)
    planted = {i: personal_data.example(words, rng) for i in range(600)}
    docs = spark.createDataFrame([(i, t) for i, (t, _) in planted.items()], "doc_id long, text string")
    found = {r.doc_id: r for r in personal_data.personal_data(docs, field).collect()}
    wanted, hit, added, good = dict.fromkeys(PATTERNS, 0), dict.fromkeys(PATTERNS, 0), 0, 0
    for i, (text, spans) in planted.items():
        base = plain_spans(text)
        assert found[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [found[i][f"n_{k}"] for k in PATTERNS] == [sum(k == s[0] for s in base) for k in PATTERNS]
        every = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in found[i].spans.split(",") if s)]
        assert every == sorted(every, key=lambda s: (list(PATTERNS).index(s[0]), s[1], s[2])) and set(base) <= set(every)
        new = [s for s in every if s not in base]
        for k, a, b in spans:
            if not any(x < b and a < y for _, x, y in base):
                wanted[k] += 1
                hit[k] += sum(max(0, min(b, y) - max(a, x)) for kind, x, y in new if kind == k) >= 0.7 * (b - a)
        added += len(new)
        good += sum(any(k == kind and x < b and a < y for kind, a, b in spans) for k, x, y in new)
    assert all(hit[k] >= 0.9 * wanted[k] and wanted[k] > 50 for k in PATTERNS)
    assert good >= 0.95 * added


def test_added_spans(small):
    field = personal_data.train(personal_data.sample(small))
    for text, wanted in (
        ("write jane.doe@example.com then ask jane.doe again", ["jane.doe"]),
        ("bob.9 [at] mail [dot] example [dot] com is it", ["bob.9 [at] mail [dot] example [dot] com"]),
        ("or jane.doe(at)mail.org then", ["jane.doe(at)mail.org"]),
        ("Call 555-123-4567 today", ["555-123-4567"]),
        ("Card 4111.1111.1111.1111 ok", ["4111.1111.1111.1111"]),
        ("the +1 (826) 555-4081 190.137.223.204 of", ["+1 (826) 555-4081"]),
        ("wh 2353820953013749 4550997810720808 th", ["4550997810720808"]),
        ("no such thing in 1999 or 25 rows, on 2020-01-02 at 12:30", []),
    ):
        base = personal_data.base_spans(text)
        assert [text[a:b] for _, a, b in field.added(text, base)] == wanted


def test_message_passing_is_exact_on_trees():
    rng = np.random.default_rng(3)
    k = len(personal_data.LABELS)
    for _ in range(20):
        n = 4
        graph = personal_data.Nodes([(i, i + 1) for i in range(n)], rng.normal(size=(n, 3)), np.array([[0, 1], [1, 2]]), np.array([[0, 3]]))
        field = personal_data.Field(rng.normal(size=(3, k)), rng.normal(size=(k, k)), (lambda s: s + s.T)(rng.normal(size=(k, k))))
        scores = graph.features @ field.unary
        want = np.zeros((n, k))
        for y in itertools.product(range(k), repeat=n):
            p = np.exp(sum(scores[i, y[i]] for i in range(n)) + field.chain[y[0], y[1]] + field.chain[y[1], y[2]] + field.skip[y[0], y[3]])
            for i in range(n):
                want[i, y[i]] += p
        assert np.allclose(field.beliefs(graph), want / want.sum(axis=1, keepdims=True), atol=1e-3)


# Token counts


def test_token_counts(spark, small, texts):
    from tokenizers import Tokenizer

    extra = {10**6: "a<|endoftext|>b <|endoftext|>", 10**6 + 1: "don't  \n\n  it's\té́ 12345 \U0001f600!!", 10**6 + 2: "", 10**6 + 3: " " * 500 + "x"}
    docs = small.select("doc_id", "text").unionByName(spark.createDataFrame(list(extra.items()), "doc_id long, text string"))
    tok = Tokenizer.from_file(token_counts.default_path())
    want = {i: (len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)) for i, t in {**texts, **extra}.items()}
    for common in (10, 300_000):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, most_common=common).collect()}
        assert got == want


# Language


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    rows = language.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert {r.held_out for r in language.language_id(docs).where("doc_id = 3").collect()} == {zlib.crc32(b"3") % 4 == 2}


def tree_length(trees, data):
    """Code length by walking the counts of one language, with escapes."""
    total = 0.0
    for i in range(language.ORDER, len(data)):
        p, factor = None, 1.0
        for order in range(language.ORDER, -1, -1):
            seen = trees[order].get(bytes(data[i - order : i]))
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if data[i] in seen:
                p = factor * seen[data[i]] / (n + d)
                break
            factor *= d / (n + d)
        total -= np.log2(p if p is not None else factor / 256)
    return total


def test_code_lengths_are_exact():
    samples = {"a": ["the cat sat on the mat", "a cat and a hat"], "b": ["der hund und die katze", "ein hund"]}
    model = language.train(samples)
    for text in ("the cat", "hund katze", "xyz zebra", "t", "ça va the"):
        data = language.cleaned(text)
        for k, lang in enumerate(model.languages):
            trees = [{} for _ in range(language.ORDER + 1)]
            joined = b"".join(map(language.cleaned, samples[lang]))
            for i in range(language.ORDER, len(joined)):
                for order in range(language.ORDER + 1):
                    seen = trees[order].setdefault(joined[i - order : i], {})
                    seen[joined[i]] = seen.get(joined[i], 0) + 1
            assert abs(model.lengths([data])[0][k] - tree_length(trees, data)) < 1e-3
    both = model.lengths([language.cleaned("the cat"), language.cleaned("hund")])
    assert np.allclose(both[1], model.lengths([language.cleaned("hund")])[0])


@pytest.mark.parametrize("together", [3, 16])
def test_many_languages(spark, together):
    """More languages than any bound of tables: each with an alphabet order of its own; all can be predicted."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(70):
        syllables = ["".join(rng.choice(list("abcdefghijklmnop"), 2)) for _ in range(12)]
        text = lambda: " ".join("".join(rng.choice(syllables, 3)) for _ in range(40))  # noqa: E731,B023
        rows += [(100 * k + i, text(), f"l{k:02d}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(language.sample(docs), together)
    assert model.languages == [f"l{k:02d}" for k in range(70)]
    found = {r.doc_id: r.lang_pred for r in language.language_id(docs, model).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {lang for _, lang in held} == {found[i] for i, _ in held} and sum(found[i] == lang for i, lang in held) >= 0.98 * len(held)
    # Equal lengths: the language that comes first.
    same = language.train({"b": ["one text"], "a": ["one text"]}, 1)
    assert same.predict("one text")[0] == "a"


# SimHash


def test_simhash_components(small, texts):
    shingles = lambda t: (lambda w: [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else [])([x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) if x])
    import xxhash

    prints = {}
    for i, t in texts.items():
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles(t)]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_dedup(small).collect()}
    assert got == {i: (f"{p:016x}", find(i)) for i, p in prints.items()}


def test_links_find_every_pair(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63, 150)
    near = [int(b) ^ sum(1 << int(i) for i in rng.choice(63, k, replace=False)) for b in base for k in (1, 2, 3, 4)]
    fps = sorted({*map(int, base), *near})
    want = {(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("shape", ["chain", "star", "random", "loops"])
def test_components(spark, shape):
    rng = np.random.default_rng(5)
    edges = {"chain": [(i, i + 1) for i in range(200)], "star": [(0, i) for i in range(1, 300)], "random": [tuple(map(int, rng.integers(0, 400, 2))) for _ in range(300)], "loops": [(1, 1), (2, 3), (3, 2), (3, 3)]}[shape]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {(r.node, r.root) for r in components.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {(n, find(n)) for n in root}


# Exact dedup


def test_perfect_hash_has_no_gaps():
    rng = np.random.default_rng(6)
    for n in [*range(1, 40), 500, 2048, 2300]:
        h = [rng.integers(0, 2**48, n) for _ in range(3)]
        bucket, d0, d1, slot = exact_dedup.displace(*h)
        assert sorted(slot) == list(range(n))
        assert (((h[1] % exact_dedup.PRIME + d0 * (h[2] % exact_dedup.PRIME)) % exact_dedup.PRIME % n + d1) % n == slot).all()


def test_exact_groups(small, texts):
    groups = {}
    for i, t in texts.items():
        groups.setdefault(t.translate({c: c + 32 for c in range(65, 91)}), []).append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(small).collect()}
    assert got == {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}


def test_lookup_tells_members_from_others(spark):
    import hashlib

    digest = lambda x: hashlib.sha256(str(x).encode()).digest()
    history = spark.createDataFrame([(bytearray(digest(i)), i, 1) for i in range(5000)], "digest binary, winner long, members long")
    index, parts = exact_dedup.build_index(history)
    asked = spark.createDataFrame([(bytearray(digest(i)), i) for i in range(4000, 9000)], "digest binary, asked long")
    for r in exact_dedup.lookup(index, parts, asked).collect():
        assert r.slot_winner == (r.asked if r.asked < 5000 else None)


# Decontamination


def brute_contamination(docs, items):
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for (i, d), (k, b) in itertools.product(docs.items(), items.items()):
        w, v = cut(d), cut(b)
        if not v:
            continue
        n = min(decontaminate.WINDOW, len(v))
        best = max((sum(x == y for x, y in zip(w[a : a + n], v[c : c + n], strict=True)) for a in range(len(w) - n + 1) for c in range(len(v) - n + 1)), default=0)
        if best >= np.ceil(n * decontaminate.SIMILARITY):
            out[i, k] = best
    return out


def test_contamination_with_exchanged_words(spark):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefgh"), 3)) for _ in range(60)]
    text = lambda n: list(rng.choice(words, n))
    items = {k: " ".join(text(int(rng.integers(1, 30)))) for k in range(25)} | {25: "aaa", 26: "aaa aab", 27: "aab aaa aac", 28: "aac aaa aab aad"}
    docs = {}
    for i in range(120):
        w = text(int(rng.integers(0, 40)))
        passage = items[int(rng.integers(0, 25))].split()
        passage = [x if rng.random() > 0.12 else "zzz" for x in passage[int(rng.integers(0, 3)) :]]
        docs[i] = " ".join(w[:20] + passage + w[20:] + (["aac", "aaa", "aab", "aad"][i % 4 :] if i % 3 == 0 else []))
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = brute_contamination(docs, items)
    for block in (decontaminate.BLOCK_SEEDS, 200):
        got = {(r.doc_id, r.item_id): r.matched for r in decontaminate.contaminated(d, b, block).collect()}
        assert got == want
    assert {r.doc_id for r in decontaminate.clean_documents(d, b).collect()} == set(docs) - {i for i, _ in want}


def test_masks_lose_no_window():
    for gone in itertools.combinations(range(decontaminate.WINDOW), 2):
        assert any(not {s + o for o in m} & set(gone) for m in decontaminate.LONG_MASKS for s in range(decontaminate.WINDOW - m[-1]))


# Toxicity


def plain_kernel(s, t, decay, p=toxicity.LENGTH):
    return sum(decay ** (a[-1] - a[0] + b[-1] - b[0] + 2) for a in itertools.combinations(range(len(s)), p) for b in itertools.combinations(range(len(t)), p) if all(s[x] == t[y] for x, y in zip(a, b, strict=True)))


def test_subsequence_kernel():
    words, marks = ["idiot", "ixdxixoxt", "edition", "aaaaa", "abc", "banana", ""], ["idiot", "aaaa", "banana"]
    for decay, got in zip((0.5, 0.95), toxicity.kernels(words, marks, (0.5, 0.95)), strict=True):
        for (i, s), (j, t) in itertools.product(enumerate(words), enumerate(marks)):
            assert abs(got[i, j] - plain_kernel(s, t, decay)) < 1e-4
    # A long word counts by its best window, wherever that lies.
    for word in ("z" * 30 + "idiot" + "z" * 30, "z" * 38 + "idiot", "idiot" + "z" * 60):
        assert np.ptp(toxicity.kernels([word, "idiot"], ["idiot"], (0.5,))[0]) < 1e-4
    gram = toxicity.kernels(marks, marks, (0.95,))[0].astype(float)
    assert np.linalg.eigvalsh(gram).min() > -1e-6 * gram.max()


def test_toxicity_held_out(spark, sf):
    at = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    machine = toxicity.train(*toxicity.sample(docs, labels))
    known = {r["doc_id"]: r["toxic"] for r in table(at, "labels")}
    held = [(r["text"], known[r["doc_id"]]) for r in table(at, "documents") if known.get(r["doc_id"]) is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    predicted = np.array(machine.scores([t for t, _ in held])) >= toxicity.THRESHOLD
    y = np.array([y for _, y in held]) == 1
    assert (predicted & y).sum() >= 0.9 * predicted.sum()
    assert (predicted & y).sum() >= 0.9 * y.sum()
    frame = "Anhashsh erealy eaeron onatth ouha the from. {} in in eded thanntly ndth with."
    insults = ("idiot", "clown", "stupid", "pathetic", "moron", "worthless", "loser", "disgusting")
    for hide in (lambda w: w, lambda w: " ".join(w), ".".join, *(lambda w, i=i: w[:i] + "x" + w[i:] for i in range(1, 5))):
        assert min(machine.scores([frame.format(hide(w)) for w in insults])) >= toxicity.THRESHOLD
    assert max(machine.scores([frame.format(w) for w in ("edition", "patient", "story", "crown", "museum", "motion")])) < toxicity.THRESHOLD
    # A clean text stays clean however often it is repeated.
    clean = next(t for (t, y), p in zip(held, predicted, strict=True) if y == 0 and not p and len(t) > 2000)
    assert machine.scores([clean * 20])[0] < toxicity.THRESHOLD


# Pages


def test_main_text(sf):
    """The generated pages, as they are and with a plain element in the article's place."""
    import html

    right = 0
    rows = table(sf.replace("0.001", "0.01"), "pages")
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL).group(1)
        want = "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[a-z/][^>]*>", "", y)).split()) for y in re.split(r"</?(?:p|h1|br)>", article)) if x)
        assert html_text.main_text(r["html"]) == want
        right += html_text.main_text(r["html"].replace("<article>", "<div>").replace("</article>", "</div>")) == want
    assert right >= 0.98 * len(rows)


@pytest.mark.parametrize("page", ["<b>{}</i>", "<p>x{}<div>a", "<div>{}<b></div><p>x", "<p><table>{}<b><div></div>", "<ul>{}<li>a<ul>"])
def test_deeply_nested_pages_take_linear_time(page):
    before, _, after = page.partition("{}")
    started = time.perf_counter()
    html_text.main_text(before * 20_000 + after * 20_000)
    assert time.perf_counter() - started < 20  # quadratic passes take minutes


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div class=content><h1>T</h1><p>Hello world, this is long. Yes, it is.</p><p>Second one here, also fine.</p></div><div class='sidebar'><p>Buy now, please. It is great.</p></div><div id=comments><p>Nice one, thanks.</p></div>", "T\nHello world, this is long. Yes, it is.\nSecond one here, also fine."),
        ("<header><h1>Site</h1></header><div class=cookie-notice>We use cookies, accept.</div><p>Main one, which is long enough. Truly.</p><p>Main two, as well &amp; more.</p><form>Name, please: <input></form><footer>c</footer>", "Main one, which is long enough. Truly.\nMain two, as well & more."),
        ("<article><h1>A &lt;b&gt;</h1>loose <i>in</i> it<br>more<ul><li>one<li>two</ul><section class='comments'><p>bad comment, long one. yes.</p></section></article>", "A <b>\nloose in it more\none\ntwo"),
        ("<body class=page><form action=x><div><h1>T</h1><p>All of the page stands in a form, as some do. It is long.</p><p>And goes on here, for a while, to be text.</p></div></form></body>", "T\nAll of the page stands in a form, as some do. It is long.\nAnd goes on here, for a while, to be text."),
        ("<div><p class=market-share>The share rose, as was said, to a third.</p><section class=related-work><p>Others found, in their work, the same.</p></section><p>Let <math><mi>x</mi></math> be small, and <svg width=1/> then smaller. So it is.</p></div>", "The share rose, as was said, to a third.\nOthers found, in their work, the same.\nLet x be small, and then smaller. So it is."),
        ("<div><h1>T</h1><div><p>One paragraph of the text, as long as they are.</p><p>One more of them, which is as long, or so.</p><ul><li><a href=a>Share this</a><li><a href=b>Print that</a></ul></div></div>", "T\nOne paragraph of the text, as long as they are.\nOne more of them, which is as long, or so."),
        ("<p>unclosed <b>bold<p>next <!-- never closed", "unclosed bold\nnext"),
    ],
)
def test_page_shapes(page, want):
    assert html_text.main_text(page) == want


# Licences


def plain_report(text, model):
    n, sure, families = 0, 0, set()
    for piece in re.split(licenses.PARAGRAPH, text):
        family, _ = model.predict(piece)
        if family != licenses.NONE:
            n += 1
            if family != licenses.UNKNOWN and licenses.similarity(piece, family) >= licenses.SIMILARITY:
                sure += 1
                families.add(family)
    return n, sure, ",".join(sorted(families)), n - sure


def test_license_report(spark, small, texts):
    model = licenses.train(licenses.sample(small))
    wrapped = "\n".join(" ".join(licenses.TEMPLATES["mit"][0].split()[i : i + 9]) for i in range(0, 60, 9))
    more = ("A\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files\nB", "SPDX-License-Identifier: MPL-2.0", "Released under the Strange License 7.", "See the license office.", "Licensed under the Apache License, Version 2.0.", wrapped, "Released under MIT.", "Dual MIT/X11.", "Terms: Expat", "Mit.", "The company renewed its software license for the general office.")
    lines = {10**6 + i: t for i, t in enumerate(more)}
    docs = small.select("doc_id", "text").unionByName(spark.createDataFrame(list(lines.items()), "doc_id long, text string"))
    got = {r.doc_id: (r.n_paragraphs, r.n_confirmed, r.families, r.n_unknown) for r in licenses.license_report(docs, model).collect()}
    assert got == {i: plain_report(t, model) for i, t in {**texts, **lines}.items()}
    assert [got[10**6 + i][2] for i in range(len(more))] == ["mit", "mpl", "", "", "apache-2.0", "mit", "mit", "mit", "mit", "", ""]
    assert [got[10**6 + i][0] for i in (2, 3, 9, 10)] == [1, 0, 0, 0]


def test_licenses_held_out(small, texts):
    """Examples left out of the fit, and the corpus' own lines by a pattern that the model does not know."""
    corpus = licenses.sample(small)
    model = licenses.train(corpus)
    told = [(c, model.predict(t)[0]) for c, t, held in licenses.examples(corpus) if held]
    for families in (True, False):
        kinds = {c for c, _ in told if c not in (licenses.NONE, licenses.UNKNOWN)} if families else {licenses.UNKNOWN}
        hit = sum(c == p for c, p in told if c in kinds)
        assert hit >= 0.9 * sum(c in kinds for c, _ in told) and hit >= 0.9 * sum(p in kinds for _, p in told)
    assert sum(p == licenses.NONE for c, p in told if c == licenses.NONE) >= 0.97 * sum(c == licenses.NONE for c, _ in told)
    pieces = [p for t in texts.values() for p in re.split(licenses.PARAGRAPH, t)]
    says = re.compile(r"\b(Licensed|licensed|Released) under ")
    found = [(bool(says.search(p)), model.predict(p)[0] not in (licenses.NONE, licenses.UNKNOWN)) for p in pieces]
    hit = sum(a and b for a, b in found)
    assert hit >= 0.95 * sum(a for a, _ in found) and hit >= 0.95 * sum(b for _, b in found)


def test_licenses_within_longer_paragraphs(spark, small):
    own = licenses.TEMPLATES
    rows = [
        (" ".join(own["apache-2.0"]), "apache-2.0"),
        ("Copyright (c) 2019, Jane Doe. " + " ".join(own["apache-2.0"]), "apache-2.0"),
        (f"{own['bsd'][0]} 1. {own['bsd'][1]} 2. {own['bsd'][2]} 3. {own['bsd'][3]}", "bsd"),
        (" ".join(own["mit"]), "mit"),
        ("Copyright 2020 Jane Doe. Released under the MIT License.", "mit"),
        ("The tool grew out of a weekend project and was rewritten twice. Released under the MIT License. Bug reports are welcome at any time of the year.", "mit"),
        ("Copyright 2021 The Authors. Licensed under CC BY 4.0.", "cc-by"),
        ("Copyright 2021 The Authors. Licensed under GPLv3.", "gpl"),
        ("Many people talk about the MIT License at length and in other words than these.", ""),
        ("Released under the Strange License 7.", ""),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    found = licenses.license_report(docs, licenses.train(licenses.sample(small)))
    assert {r.doc_id: r.families for r in found.collect()} == {i: f for i, (_, f) in enumerate(rows)}


# Mixing


def test_mixing_rates(spark):
    rows = [(i, "x" * 10, "en", "big" if i % 4 else "small", 10) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix(docs, {"big": 1.0, "small": 3.0})
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["small"] - 3000) < 5 * 3000**0.5 and abs(n["big"] - 1000) < 5 * 1000**0.5
    again = mixing.mix(docs.repartition(7), {"big": 1.0, "small": 3.0})
    key = ["doc_id", "mix_copy", "mix_copies"]
    assert out.select(key).exceptAll(again.select(key)).isEmpty() and again.count() == sum(n.values())
    nameless = mixing.mix(docs.withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat("text", F.monotonically_increasing_id().cast("string"))), {"big": 1.0, "small": 3.0})
    n = {r.source: r["count"] for r in nameless.groupBy("source").count().collect()}
    assert abs(n["small"] - 3000) < 5 * 3000**0.5 and len({r.mix_copies for r in nameless.collect()}) > 4 and len({r.mix_key for r in nameless.collect()}) == sum(n.values())
    counts = np.bincount([r.n for r in out.where("source = 'small'").groupBy("doc_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()])
    assert abs(counts[3] / 1000 - 0.224) < 0.05  # P(N = 3) for mean 3


def test_mixing_order_is_global(small):
    keys = [r.mix_key for r in mixing.mix(small).collect()]
    ids = [r.doc_id for r in mixing.mix(small).collect()]
    assert sorted(keys) != keys and ids != sorted(ids)


# Queries


def test_pipeline_matches_plain_python(spark, sf, texts):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = {}
    for name, f in corpus_pipeline.STAGES:
        docs = common.stored(f(spark, docs, sf))
        steps[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    left = {i for i, t in texts.items() if any(c.isalpha() for c in t)}
    assert steps["language ID"] == left
    groups = {}
    for i in left:
        groups.setdefault(texts[i].translate({c: c + 32 for c in range(65, 91)}), []).append(i)
    left = {max(g) for g in groups.values()}
    assert steps["exact dedup"] == left
    prints = {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_dedup(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    kept = set(left)
    changed = True
    label = {i: i for i in left}
    while changed:
        changed = False
        for a, b in itertools.combinations(sorted(left), 2):
            if (prints[a] ^ prints[b]).bit_count() <= 3 and label[a] != label[b]:
                low = min(label[a], label[b])
                label[a] = label[b] = low
                changed = True
    kept = {i for i in left if label[i] == i}
    assert steps["SimHash near-dedup"] == kept
    bad = brute_contamination({i: texts[i] for i in kept}, {r["item_id"]: r["text"] for r in table(sf, "benchmark")})
    assert steps["benchmark decontamination"] == kept - {i for i, _ in bad}
    assert corpus_pipeline.run(spark, sf).select("doc_id", "mix_copy").exceptAll(docs.select("doc_id", "mix_copy")).isEmpty()


ARTICLE = "".join(f"<p>Paragraph {i} of the article says something, at some length, about the matter at hand.</p>" for i in range(4))
ARTICLE_TEXT = "\n".join(f"Paragraph {i} of the article says something, at some length, about the matter at hand." for i in range(4))
NOISE = '<nav><a href="/">Home</a></nav>'
AFTER = '<div class="sidebar"><p>Buy now, it is cheap.</p></div><div id="comments"><div class="comment"><p>I agree with all of it, really.</p></div></div><footer>Imprint</footer>'


@pytest.mark.parametrize(
    "page",
    [
        f'<html><body class="has-sidebar">{NOISE}<article>{ARTICLE}</article>{AFTER}</body></html>',
        f'<html class="ad-free"><body>{NOISE}<div class="content">{ARTICLE}</div>{AFTER}</body></html>',
        f'<html><body>{NOISE}<article class="post comments-open">{ARTICLE}</article>{AFTER}</body></html>',
        f'<html><body>{NOISE}<article class="post comments-open">{ARTICLE}{AFTER}</article></body></html>',
        f'<html><body><div class="page has-sidebar">{NOISE}<div>{ARTICLE}</div>{AFTER}</div><p>Copyright.</p></body></html>',
        f'<html><body class="social"><div class="site ad-free"><div class="wrap no-sidebar">{NOISE}<main class="widget-area">{ARTICLE}</main>{AFTER}</div></div></body></html>',
        f'<html><body><div class="sidebar"><article><p>A teaser, short.</p></article></div><div class="post">{ARTICLE}</div>{AFTER}</body></html>',
        f'<html><body><div class="post">{ARTICLE}</div><div id="comments">{"<p>I agree with all of it, really, and say so at length.</p>" * 60}</div></body></html>',
        f'<html><body class="comments"><article>{ARTICLE}<p aria-hidden="true">Not seen, ever.</p></article></body></html>',
    ],
)
def test_main_text_is_kept_where_names_of_its_ancestors_say_boilerplate(page):
    assert html_text.main_text(page) == ARTICLE_TEXT


@pytest.mark.parametrize("unit", ['<a b="', '<a ">" ', "<!", "<a", "</script ", "<", '"<b>', "<b>x<hr>", "<a '", "</"])
@pytest.mark.parametrize("around", [("", ""), ("<script>", ""), ("", ">")])
def test_pages_of_nothing_but_markup_take_linear_time(unit, around):
    def seconds(size):
        page = around[0] + unit * (size // len(unit)) + around[1]
        began = time.process_time()
        html_text.blocks(page)
        return time.process_time() - began

    seconds(1000)
    assert seconds(400_000) < 40 * seconds(40_000) + 0.5


def test_tags_with_brackets_and_quotes():
    page = """<p title="a > b" class='x'>one</p><b data-x='"'>two</b><i "unclosed>three</i><br/>4 < 5<!-- <p>no</p> --><q a=">">six</q><p"""
    found = [(page[a:b], slash, name) for a, b, slash, name, _ in html_text.tags(page)]
    assert found == [("<p title=\"a > b\" class='x'>", "", "p"), ("</p>", "/", "p"), ("<b data-x='\"'>", "", "b"), ("</b>", "/", "b"), ('<i "unclosed>three</i><br/>4 < 5<!-- <p>no</p> --><q a=">', "", "i"), ("</q>", "/", "q"), ("<p", "", "")]


def test_kernel_leaves_out_places_without_a_whole_match(monkeypatch):
    def plain(word, string, decay):
        ends = {}  # (letters, end in word, end in string): weight
        for q in range(1, toxicity.LENGTH + 1):
            for i, c in enumerate(word):
                for j, z in enumerate(string):
                    if c == z:
                        ends[q, i, j] = decay**2 if q == 1 else sum(w * decay ** (i - a + j - b) for (p, a, b), w in ends.items() if p == q - 1 and a < i and b < j)
        return sum(w for (q, _, _), w in ends.items() if q == toxicity.LENGTH)

    strings, words = ["abcd", "^ababcabcd", "abc", "dcbaab"], ["^abcabcd", "^aabbccdd", "^dcba", "^abab", "^xyzxyzxy"]
    found = toxicity.kernels(words, strings, toxicity.DECAYS)
    for d, decay in enumerate(toxicity.DECAYS):
        assert np.allclose(found[d], [[plain(w, s, decay) for s in strings] for w in words], rtol=1e-4)
    # One long landmark does not make the short ones long.
    made, multiply = [], np.multiply
    monkeypatch.setattr(np, "multiply", lambda *a, **k: made.append(a[0].size) or multiply(*a, **k))
    toxicity.kernels(["^abcabcd"] * 9, ["abcd"] * 20 + ["^ababcabcd"], toxicity.DECAYS)
    assert sum(made) < 8 * 2 * 4 * 21 * 9 * 3

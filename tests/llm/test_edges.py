"""Each operator on nulls, empty and long texts, repeats, clashing columns and an empty table."""

import pytest

from skyloom.llm import alignment, collocations, decontaminate, exact_dedup, html_text, language, licenses, mixing, packing, personal_data, simhash, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, fp long, digest string, line string, score double"
LONG = "the quick brown fox jumps over the lazy dog " * 3000
ROWS = [
    (1, None, None, None, None, None, None, None, None, None),
    (2, "", "en", "a", 0, True, 1, "x", "y", 0.5),
    (3, LONG, "en", "a", 1, True, 1, "x", "y", 0.5),
    (4, "Hello there, idiot. Mail me@example.com now.", "en", "b", 1, None, None, None, None, None),
    (4, "Hello there, idiot. Mail me@example.com now.", "en", "b", 1, None, None, None, None, None),
    (None, "Released under the MIT License.", "en", "b", 1, None, None, None, None, None),
    (None, None, "fr", "b", 1, None, None, None, None, None),
    (5, "HELLO there, idiot. Mail me@example.com now.", "en", "b", 1, None, None, None, None, None),
    (6, "\n\n \t", "fr", "b", 1, None, None, None, None, None),
    (7, "12345 67890", "fr", "b", 1, None, None, None, None, None),
    (8, "x" * 100_000, "fr", "b", 1, None, None, None, None, None),
    (9, "Bonjour à tous, ça va \U0001f600 ​?", "fr", None, 1, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 1), (5, 1, 1), (3, 1, 0), (9, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "jumps over the lazy dog the quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (3, "hello there idiot mail me example com"), (None, "bonjour à tous ça va")], "item_id long, text string")


def operators(docs, labels, bench):
    return {
        "licenses": lambda d: licenses.license_report(d),
        "mixing": lambda d: mixing.mix(d),
        "personal_data": lambda d: personal_data.personal_data(d),
        "token_counts": lambda d: token_counts.token_counts(d),
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "language": lambda d: language.language_id(d),
        "simhash": lambda d: simhash.near_dedup(d),
        "exact_dedup": lambda d: exact_dedup.exact_dedup(d),
        "alignment": lambda d: alignment.alignment(d),
        "collocations": lambda d: collocations.collocations(d, least=2),
        "packing": lambda d: packing.pack(d),
        "decontaminate": lambda d: decontaminate.contaminated(d, bench),
        "stage_language": lambda d: language.accepted_documents(d),
        "stage_exact": lambda d: exact_dedup.dedup_documents(d),
        "stage_near": lambda d: simhash.near_dedup_documents(d),
        "stage_clean": lambda d: decontaminate.clean_documents(d, bench),
    }


ROW_WISE = ("licenses", "personal_data", "token_counts", "toxicity", "language", "simhash", "exact_dedup", "alignment")
NAMES = (*ROW_WISE, "mixing", "packing", "collocations", "decontaminate", "stage_language", "stage_exact", "stage_near", "stage_clean")


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(name, docs, labels, bench):
    out = operators(docs, labels, bench)[name](docs)
    rows = out.collect()
    if name in ROW_WISE:
        key = lambda r: (r is None, r or 0)
        assert sorted((r.doc_id for r in rows), key=key) == sorted((r[0] for r in ROWS), key=key)
    if name.startswith("stage"):
        assert out.columns == docs.columns


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(name, docs, labels, bench):
    empty = docs.where("doc_id < 0").coalesce(1)
    assert operators(docs, labels, bench)[name](empty).collect() == []


def test_empty_partners(docs, labels, bench):
    assert decontaminate.contaminated(docs, bench.where("item_id < 0")).count() == 0
    scores = {r.score for r in toxicity.toxicity(docs, labels.where("doc_id < 0")).collect()}
    assert scores == {0.0} or max(scores) < 1e-6


def test_exact_stage_keeps_one_of_each(docs):
    left = [(r.doc_id, (r.text or "").lower()) for r in exact_dedup.dedup_documents(docs).collect()]
    assert len({t for _, t in left}) == len(left)
    assert (5, ROWS[7][1].lower()) in left and 4 not in {i for i, _ in left}
    report = {}
    for r in exact_dedup.exact_dedup(docs).collect():
        report.setdefault(r.text_sha256, []).append(r)
    for group in report.values():
        assert sum(r.kept for r in group) == 1 and {r.group_size for r in group} == {len(group)}


def test_near_stage_keeps_one_of_each_component(docs):
    kept = [r.doc_id for r in simhash.near_dedup_documents(docs).collect()]
    components = {r.component_id for r in simhash.near_dedup(docs).collect()}
    assert len(kept) == len(components)


def test_near_stage_keeps_unlinked_texts_with_null_or_repeated_ids(spark):
    apple, boat, cloud = ("apples grow on old trees in the north", "boats sail over the wide sea at night", "clouds hang low above seven quiet hills")
    rows = [(None, apple), (None, boat), (None, boat), (7, cloud), (7, "seven other words that link to nothing here"), (9, "seven other words that link to nothing here"), (8, apple + " and more besides, of a wholly other kind")]
    kept = sorted(((r.doc_id or 0), r.text) for r in simhash.near_dedup_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == sorted([(0, apple), (0, boat), (7, cloud), (7, rows[4][1]), (8, rows[6][1])])


def test_clean_stage_uses_ids_and_texts(docs, bench):
    found = decontaminate.contaminated(docs, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(3, 1), (4, 3), (5, 3), (9, None)}
    assert sorted((r.doc_id or 0) for r in decontaminate.clean_documents(docs, bench).collect()) == [0, 0, 1, 2, 6, 7, 8]


def test_pages(spark):
    long = "<div>" + "<p>The same sentence, again and again, for ever.</p>" * 20_000 + "</div>"
    rows = [(1, "u", long, "t", 5), (1, "u", long, "t", 5), (2, None, "plain words", None, None), (3, "u", "<" * 5000, "", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    out = html_text.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((r.page_id, r.n_chars, len(r.text)) for r in out.collect())
    assert got[:2] == [(1, 20_000 * 46 - 1, 20_000 * 46 - 1)] * 2 and got[2] == (2, 11, 11)
    assert html_text.extract(pages.where("page_id < 0")).collect() == []


def test_page_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, ""), (2, "v", "<article><p>A &amp; B</p></article>")], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [(0, "", 0), (1, "", 0), (1, "", 0), (2, "A & B", 5)]


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_awkward_rows(spark, docs, bench, tmp_path, empty):
    import corpus_pipeline

    docs.where("doc_id < 0" if empty else "true").write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "mix_copy", "mix_copies", "mix_key"]
    rows = out.collect()
    # Without letters (1, 2, 6, 7), copies of benchmark items (3, 5, 9) and repeats of texts go; what is left is drawn.
    left = docs.where("doc_id < 0" if empty else "true")
    for _, stage in corpus_pipeline.STAGES[:4]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in left.collect()]
    assert {i for i, _ in kept} == (set() if empty else {8, None}) and len(kept) == len(set(kept))
    assert {(r.doc_id, r.text) for r in rows} <= set(kept) and all(r.mix_copies >= 1 for r in rows)

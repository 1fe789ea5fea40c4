"""Phrase collocations by language: sketch, candidates, exact counts by automata.

1. Sketch: the phrases of one to five words are hashed into cells, whose number
   grows with the corpus (``BYTES_PER_CELL``).  A task sorts the cells it met
   and hands on, for each block of ``BLOCK`` cells, the distinct ones and their
   counts, cut off at the threshold; blocks are summed by a shuffle, each in a
   small array.  A cell's count is an upper bound of the counts of its phrases,
   and one bit a cell, the bound against the threshold, is all that is kept.
2. Candidates: each phrase whose cell and the cells of whose parts reach the
   threshold.  The bits go to every task, at most ``MOST_CELLS`` of them; a
   larger sketch is dealt into that many cells at a time, with a pass for each.
3. Exact counts: candidates are dealt into automata of at most ``AUTOMATON``
   phrases over word codes.  A text is the sequence of its words' codes,
   with a guard at each end of a piece and for every word that no candidate of
   the automaton has, so that no match crosses one.  All matches are counted,
   overlapping ones included, and summed over the tasks.
4. Threshold, parts, cuts, scores and ranks are joins and windows over the
   counted phrases.  A phrase lies inside a longer one of the same count only
   if it does so with one more word on the left or the right, since a count
   never rises with more words; so those two are looked at.

The passes over the corpus are two and one for each further automaton and
sketch part; their number grows with the phrases that reach the threshold, which are
at most one in ``least`` words for each length.  A corpus far beyond some
hundred GB calls for a higher ``least``.

Scores are exact: numerators and denominators are decimals of 38 digits.

Edge cases: null text is empty, null language is ``und``; repeated rows count
each; a text of any length is read in blocks of ``WORDS`` words that overlap by
four; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache, reduce
from itertools import groupby, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, text_of

LONGEST = 5
LEAST = 100
TOP = 2000
#: Bytes of text for each cell of the sketch: about 50 phrases a cell.
BYTES_PER_CELL = 64
FEWEST_CELLS, MOST_CELLS = 1 << 24, 1 << 29
BLOCK = 1 << 16
#: Phrases of one automaton, whose nodes and word codes take about 400 bytes for each; and branches of a node at most.
AUTOMATON, SIGNS = 500_000, 64
SLICE = 200
WORDS = 500_000
#: Cells a task holds before it sorts and hands them on.
HELD = 4_000_000
#: Words whose hashes a worker keeps.
KEPT = 400_000
SALTS = 64
#: Parts of a language's candidates, and phrases of a part of the counts; a task hands on one packed row for each.
PARTS, COUNTED = 256, 4096

#: Delimiters of pieces become the guard, a word of its own.
GUARD = b"."
_DELIMITERS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", GUARD * 9)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Lower-case words, with a guard between pieces."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_DELIMITERS).replace(GUARD, b" . ").split()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], int]]:
    """(language, words, overlap): the words of some texts of a language; the first ``overlap`` ones end nothing new."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            rows = batch.slice(at, SLICE).to_pydict()
            by_language = defaultdict(list)
            for lang, text in zip(rows["lang"], rows["text"], strict=True):
                by_language[lang].append(text)
            for lang, texts in by_language.items():
                # bytes.split() cuts at blanks, tabs and the delimiters' line ends, which are guards by now.
                words = words_of("\n".join(texts))
                for start in range(0, len(words), WORDS):
                    overlap = min(start, LONGEST - 1)
                    yield lang, words[start - overlap : start + WORDS], overlap


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh64_intdigest(word)
        if len(self) >= KEPT:
            self.clear()
        self[word] = out
        return out


@cache
def _hashes() -> _Hashes:
    return _Hashes()


def _cells(lang: str, words: list[bytes], overlap: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the places from ``overlap`` on where its phrases end, their cells, hashes by the phrase's start, and hashes of the words."""
    h = np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))
    inside = h != np.uint64(_hashes()[GUARD])
    for i in np.flatnonzero(~inside):  # a word may hash like the guard
        inside[i] = words[i] != GUARD
    mixed, whole = h ^ np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))), inside
    for n in range(1, LONGEST + 1):
        if n > 1:
            mixed = mixed[:-1] * _ODD + h[n - 1 :]
            mixed ^= mixed >> np.uint64(31)
            whole = whole[:-1] & inside[n - 1 :]
        ends = np.flatnonzero(whole) + n - 1
        ends = ends[ends >= overlap]
        yield n, ends, ((mixed[ends - n + 1] * _ODD) >> np.uint64(64 - bits)).astype(np.uint32 if bits <= 32 else np.int64), mixed, h


def _fill(bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, words_by = 0, Counter()

        def flush() -> pa.RecordBatch:
            cells = np.sort(np.concatenate(held))
            new = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
            counts = np.minimum(np.diff(np.r_[new, len(cells)]), least).astype(np.uint16)
            cells = cells[new]
            blocks, first = np.unique(cells // BLOCK, return_index=True)
            bounds = [*first.tolist(), len(cells)]
            # A step is less than a block but for the first one of each block, whose place is taken off.
            steps = np.diff(cells, prepend=cells[:1])
            steps[first] = cells[first] % BLOCK
            steps = steps.astype(np.uint16)
            rows = [pa.compress(steps[a:b].tobytes() + counts[a:b].tobytes(), "zstd", asbytes=True) for a, b in zip(bounds, bounds[1:], strict=False)]
            return _sketch_rows(blocks.tolist(), np.diff(bounds).tolist(), rows, [None] * len(rows))

        for lang, words, overlap in _blocks(batches):
            for n, ends, cells, *_ in _cells(lang, words, overlap, bits):
                held.append(cells)
                size += len(cells)
                if n == 1:
                    words_by[lang] += len(ends)
            if size > HELD:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()
        if words_by:
            yield _sketch_rows([None] * len(words_by), list(words_by.values()), [None] * len(words_by), list(words_by))

    return run


def _sketch_rows(blocks: list, sizes: list, payloads: list, langs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(sizes, pa.int64()), pa.array(payloads, pa.binary()), pa.array(langs, pa.string())], names=["block", "size", "payload", "lang"])


def _sum_blocks(least: int):
    """Rows arrive sorted by block; one block's counts are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, np.zeros(BLOCK, np.uint32)

        def bits() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"block": pa.array([now], pa.int64()), "bits": pa.array([np.packbits(counts >= least).tobytes()], pa.binary())})

        for batch in batches:
            for block, size, payload in zip(*(batch.column(n).to_pylist() for n in ("block", "size", "payload")), strict=True):
                if block != now:
                    if now is not None:
                        yield bits()
                    now = block
                    counts[:] = 0
                raw = pa.decompress(payload, 4 * size, "zstd", asbytes=True)
                cells = np.cumsum(np.frombuffer(raw, np.uint16, size), dtype=np.int64)
                counts[cells] = np.minimum(counts[cells] + np.frombuffer(raw, np.uint16, size, 2 * size), least)
        if now is not None:
            yield bits()

    return run


def _first_places(mixed: np.ndarray, h: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """One end of each distinct phrase; phrases whose mixed hashes are equal by chance are all given."""
    _, first, of = np.unique(mixed[ends - n + 1], return_index=True, return_inverse=True)
    same = ends[first][of]
    other = np.zeros(len(ends), bool)
    for k in range(n):
        other |= h[ends - k] != h[same - k]
    return np.concatenate([ends[first], ends[other]])


def _candidates(shared, bits: int, low: int):
    """Candidates of a task, packed by language and part of the phrases, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.frombuffer(shared.value, np.uint8)
        known: dict[str, set[bytes]] = defaultdict(set)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, phrases in known.items():
                parts = defaultdict(list)
                for phrase in sorted(phrases):
                    parts[xxhash.xxh64_intdigest(phrase) % PARTS].append(phrase)
                packed = [b"\n".join(part) for part in parts.values()]
                yield _packed([lang] * len(parts), list(parts), [len(p) for p in packed], packed)
            known.clear()

        for lang, words, overlap in _blocks(batches):
            likely = np.ones(len(words), bool)  # by the end: the phrase of one word less may reach the threshold
            for n, ends, cells, mixed, h in _cells(lang, words, 0, bits):
                at = cells.astype(np.int64) - low
                # Cells of another part of the sketch are not known here.
                here = (at >= 0) & (at < 8 * len(full))
                at = np.where(here, at, 0)
                reach = (full[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                may = likely[ends] & (likely[ends - 1] if n > 1 else True) & (reach | ~here)
                likely = np.zeros(len(words), bool)
                likely[ends[may]] = True
                new = _first_places(mixed, h, ends[may & here & (ends >= overlap)], n).tolist()
                known[lang].update(b" ".join(words[end - n + 1 : end + 1]) for end in new)
            if sum(map(len, known.values())) > KEPT:
                yield from flush()
        yield from flush()

    return run


def _packed(langs: list[str], parts: list[int], sizes: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    small = [pa.compress(p, "zstd", asbytes=True) for p in payloads]
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(small, pa.binary())], names=["lang", "part", "size", "payload"])


PACKED = "lang string, part long, size long, payload binary"


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[bytes]]]:
    """Payloads of each (language, part); rows arrive sorted by it."""
    rows = (row for batch in batches for row in zip(*(batch.column(n).to_pylist() for n in ("lang", "part", "size", "payload")), strict=True))
    for key, some in groupby(rows, key=itemgetter(0, 1)):
        yield key, (pa.decompress(payload, size, "zstd", asbytes=True) for _, _, size, payload in some)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each candidate once; the phrases of one part are held."""
    for (lang, _), payloads in _by_part(batches):
        yield _phrases(lang, list({phrase for payload in payloads for phrase in payload.split(b"\n")}))


def _phrases(lang: str, phrases: list[bytes], counts: list[int] | None = None) -> pa.RecordBatch:
    columns = {"lang": pa.array([lang] * len(phrases), pa.string()), "phrase": pa.array(phrases, pa.binary()).cast(pa.string())}
    return pa.RecordBatch.from_pydict(columns | ({} if counts is None else {"f": pa.array(counts, pa.int64())}))


def _by_key(packed: DataFrame) -> DataFrame:
    return packed.repartition("lang", "part").sortWithinPartitions("lang", "part")


#: The automata of the last job of this worker, by language.
_built: dict[tuple[str, str], tuple] = {}


def _automaton(job: str, lang: str, joined: bytes) -> tuple[dict[bytes, str], str, object, list[bytes]]:
    """The words' codes, the guard, the automaton and its phrases.

    A word is a number written with a fixed count of digits, each place with
    signs of its own, so that matches begin at words only and no node has more than
    ``SIGNS`` branches, which are searched one by one.
    """
    import ahocorasick

    key = job, lang
    if key not in _built:
        for old in [k for k in _built if k[0] != job]:
            del _built[old]
        phrases = joined.split(b"\n")
        words = dict.fromkeys(w for phrase in phrases for w in phrase.split(b" "))
        places = 1
        while SIGNS**places < len(words):
            places += 1
        codes = {w: "".join(chr(1 + SIGNS * j + i // SIGNS**j % SIGNS) for j in range(places)) for i, w in enumerate(words)}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, phrase in enumerate(phrases):
            automaton.add_word("".join(map(codes.__getitem__, phrase.split(b" "))), i)
        automaton.make_automaton()
        _built[key] = codes, "\0" * places, automaton, phrases
    return _built[key]


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, payload = shared.value
        totals: dict[str, Counter] = defaultdict(Counter)
        for lang, words, overlap in _blocks(batches):
            if lang in payload:
                codes, guard, automaton, _ = _automaton(job, lang, payload[lang])
                hits, seen = automaton.iter("".join(map(codes.get, words, repeat(guard)))), overlap * len(guard)
                totals[lang].update((v for end, v in hits if end >= seen) if seen else map(itemgetter(1), hits))
        for lang, counts in totals.items():
            at = np.fromiter(counts, np.int64, len(counts))
            order = np.argsort(at)
            at, n = at[order], np.fromiter(counts.values(), np.int64, len(counts))[order]
            parts, first = np.unique(at // COUNTED, return_index=True)
            bounds = [*first.tolist(), len(at)]
            packed = [at[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
            yield _packed([lang] * len(parts), parts.tolist(), list(map(len, packed)), packed)

    return run


def _sum_counts(shared, least: int):
    """Counts of each phrase that reaches the threshold; the sums of one part are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, phrases = None, []
        for (lang, part), payloads in _by_part(batches):
            if lang != of:
                of, phrases = lang, shared.value[1][lang].split(b"\n")
            sums = np.zeros(COUNTED, np.int64)
            for payload in payloads:
                at, n = np.frombuffer(payload, np.int64).reshape(2, -1)
                sums[at - part * COUNTED] += n
            enough = np.flatnonzero(sums >= least)
            yield _phrases(lang, [phrases[i] for i in (enough + part * COUNTED).tolist()], sums[enough].tolist())

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))


def sketch_bits(rows: DataFrame, bytes_per_cell: int = BYTES_PER_CELL) -> int:
    """Two to this power are the cells of the sketch."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(FEWEST_CELLS, size // bytes_per_cell).bit_length()


def candidates(rows: DataFrame, sketch: DataFrame, bits: int, most_cells: int = MOST_CELLS) -> DataFrame:
    """(lang, phrase) of all phrases whose bounds reach the threshold, and some others; written."""
    spark = rows.sparkSession
    found = []
    for low in range(0, 1 << bits, most_cells):
        high = min(low + most_cells, 1 << bits)
        full = np.zeros((high - low) // 8, np.uint8)
        for r in sketch.where(F.col("block").between(low // BLOCK, high // BLOCK - 1)).toLocalIterator():  # most_cells bits at most
            at = (r.block * BLOCK - low) // 8
            full[at : at + BLOCK // 8] = np.frombuffer(r.bits, np.uint8)
        shared = spark.sparkContext.broadcast(full.tobytes())
        packed = rows.mapInArrow(_candidates(shared, bits, low), PACKED)
        found.append(stored(_by_key(packed).mapInArrow(_met, "lang string, phrase string")))
        shared.destroy()
    return reduce(DataFrame.unionByName, found)


def counted(rows: DataFrame, phrases: DataFrame, least: int, most: int = AUTOMATON) -> DataFrame:
    """(lang, phrase, f): exact counts of the candidates that reach the threshold."""
    spark = rows.sparkSession
    jobs: list[int] = []
    starts = []
    for r in phrases.groupBy("lang").count().orderBy("lang").collect():  # one row per language
        parts = math.ceil(r["count"] / most)
        if parts > 1 or not jobs or jobs[-1] + r["count"] > most:
            starts.append((r.lang, len(jobs), parts))
            jobs += [r["count"] // parts] * parts
        else:
            starts.append((r.lang, len(jobs) - 1, parts))
            jobs[-1] += r["count"]
    out = []
    dealt = phrases.join(F.broadcast(spark.createDataFrame(starts, "lang string, first int, parts int")), "lang").withColumn("job", F.col("first") + F.pmod(F.xxhash64("phrase"), F.col("parts")).cast("int"))
    for job in range(len(jobs)):
        payload: dict[str, list[str]] = defaultdict(list)
        for r in dealt.where(F.col("job") == job).select("lang", "phrase").toLocalIterator():  # about ``most`` phrases
            payload[r.lang].append(r.phrase)
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, {lang: "\n".join(p).encode() for lang, p in payload.items()}))
        some = rows.where(F.col("lang").isin(list(payload))) if len(payload) < len(starts) else rows
        found = some.mapInArrow(_scan(shared), PACKED)
        out.append(stored(_by_key(found).mapInArrow(_sum_counts(shared, least), "lang string, phrase string, f long")))
        shared.destroy()
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "lang string, phrase string, f long")


def ranked(phrases: DataFrame, sizes: DataFrame, top: int = TOP) -> DataFrame:
    """Scores and ranks from the counts (lang, phrase, f) of all phrases that reach the threshold, and the words (lang, n) of each language."""
    words = phrases.withColumn("words", F.split("phrase", " "))
    long = words.where(F.size("words") > 1)
    less = F.size("words") - 1
    joined = lambda start, count: F.array_join(F.slice("words", start, count), " ")
    inner = long.where(F.size("words") > 2).select("lang", F.explode(F.array(joined(F.lit(1), less), joined(F.lit(2), less))).alias("phrase"), F.col("f").alias("longer"))
    covers = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = long.join(covers, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("f")))
    k = F.col("k")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), less)).alias("k")).select("lang", "phrase", "a", "k", joined(F.lit(1), k).alias("left"), joined(k + 1, F.size("words") - k).alias("right"))
    side = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    both = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(F.broadcast(sizes), "lang")
    wide = "cast({} as decimal(19, 0))".format
    score = F.expr(f"({wide('a')} * {wide('n')} * 1000) div ({wide('l')} * {wide('r')})")
    lowest = both.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    # The best of each part of a language, then of the language.
    best = Window.orderBy(F.desc("score"), F.desc("a"), "phrase")
    near = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = near.withColumn("rank", F.row_number().over(best.partitionBy("lang", "salt"))).where(F.col("rank") <= top)
    last = near.withColumn("rank", F.row_number().over(best.partitionBy("lang")).cast("long")).where(F.col("rank") <= top)
    return last.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, bytes_per_cell: int = BYTES_PER_CELL, most_cells: int = MOST_CELLS, automaton: int = AUTOMATON) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = _rows(docs)
    bits = sketch_bits(rows, bytes_per_cell)
    filled = stored(rows.mapInArrow(_fill(bits, least), "block long, size long, payload binary, lang string"))
    blocks = filled.where("lang is null").drop("lang").repartition("block").sortWithinPartitions("block")
    sketch = stored(blocks.mapInArrow(_sum_blocks(least), "block long, bits binary"))
    phrases = counted(rows, candidates(rows, sketch, bits, most_cells), least, automaton)
    sizes = filled.where("lang is not null").groupBy("lang").agg(F.sum("size").alias("n"))  # one row per language
    return ranked(phrases, sizes, top)


#: All phrases counted one by one.
ORACLE = f"""
with texts as (
    select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), pieces as (
    select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') as words
    from (select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece from texts)
), sizes as (
    select lang, sum(len(words))::bigint as n from pieces group by lang
), spans as (
    select lang, words, unnest(range(1, len(words) + 1)) as i from pieces
), counts as (
    select lang, phrase, k, count(*) as f
    from (select lang, k, array_to_string(words[i:i + k - 1], ' ') as phrase from spans, range(1, {LONGEST + 1}) t(k) where i + k - 1 <= len(words))
    group by all having count(*) >= {LEAST}
), longer as (
    select lang, phrase, max(f) as f from (
        select lang, array_to_string(string_split(phrase, ' ')[1:k - 1], ' ') as phrase, f from counts where k > 2
        union all select lang, array_to_string(string_split(phrase, ' ')[2:k], ' '), f from counts where k > 2
    ) group by all
), kept as (
    select c.lang, c.phrase, c.k, c.f as a from counts c left join longer x on c.lang = x.lang and c.phrase = x.phrase where c.k > 1 and (x.f is null or x.f < c.f)
), cuts as (
    select lang, phrase, a, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') as lead, array_to_string(string_split(phrase, ' ')[cut + 1:k], ' ') as tail
    from kept, range(1, {LONGEST}) t(cut) where cut < k
), scored as (
    select c.lang, c.phrase, c.a, c.cut, x.f as l, y.f as r, s.n, ((1000::hugeint * c.a * s.n) // (x.f::hugeint * y.f))::bigint as score
    from cuts c join counts x on x.lang = c.lang and x.phrase = c.lead join counts y on y.lang = c.lang and y.phrase = c.tail join sizes s on s.lang = c.lang
), lowest as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from lowest qualify rank <= {TOP}
"""

"""Licence scans by a trained paragraph classifier.

A paragraph ends at a blank line, or at the end of a line behind a full stop
or another mark that ends a sentence; so hard-wrapped notices are one piece.
Each is scored by a multinomial logistic
regression over sparse word n-grams (one to three words); its classes are the
licence families, ``none`` for paragraphs that say nothing about rights, and
``unknown`` for statements about rights that belong to no known family.  The
prediction is confirmed by comparison with the family's templates: at least
0.8 of the paragraph's shingles of five words
must stand in them taken together, or 0.8 of the shingles of one of them (of the
whole, if it has fewer words) in the paragraph; a bare name must be all of it.

Training, on the driver: positive examples are made from the templates below
and from rules for how authors state a licence; statements of other licences
are left out of the families and teach ``unknown``; sentences that merely use
the same words, and a bounded sample of the corpus' own paragraphs that hold nothing of the
templates, teach ``none``.  N-grams that are usual in that sample are no features.
An L1 penalty keeps the weights sparse.  A temperature and the least
probability for a family are calibrated on examples left out of the fit, the
latter so that 95 % of other licences' statements come out as unknown.

Every paragraph of every text is looked through: the hashes of its n-grams
meet those of the weights (bounded by ``MOST_WEIGHTS``) and templates within one stage, and
only hits leave it.  A paragraph without any weighed n-gram has the score
of the bias, which is ``none``.  Scoring is built-in functions only.

Edge cases: null text counts as empty; documents without licences have
n_paragraphs 0 and no families; repeated rows give one row each with the same
result; null ids stay null; very long paragraphs are scored whole; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

NONE, UNKNOWN = "none", "unknown"
GRAM, SHINGLE, SIMILARITY = 3, 5, 0.8
#: Paragraphs of the corpus that teach the class none, and their letters; an n-gram is usual if it stands in so many of them.
CORPUS_PARAGRAPHS, LETTERS, USUAL = 2000, 400, 3
MOST_WEIGHTS = 50_000
#: Where a paragraph ends.
PARAGRAPH = r"(?<=[.:;!?])[ \t]*\r?\n|\n[ \t\r]*\n"
#: Places of a paragraph that are looked up as one row.
CHUNK = 2000

# Names by which licence families are stated.
NAMES = {
    "agpl": ("GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL", "AGPLv3", "GNU AGPL v3", "AGPL-3.0"),
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0", "Apache License", "Apache Software License 2.0"),
    "bsd": ("BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "New BSD License", "BSD-3-Clause", "BSD-2-Clause", "Simplified BSD License"),
    "cc-by": ("CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC-BY-4.0"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial License"),
    "cc-by-nc-sa": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC-BY-NC-SA-4.0"),
    "cc-by-sa": ("CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike License"),
    "cc0": ("CC0 1.0", "CC0 1.0 Universal", "CC0", "Creative Commons Zero v1.0 Universal", "CC0-1.0"),
    "gpl": ("GNU General Public License, version 3", "GNU General Public License, version 2", "GNU General Public License", "GNU GPL", "GPLv3", "GPLv2", "GPL v3", "GPL-3.0", "GNU General Public License v3.0"),
    "isc": ("ISC License", "ISC license"),
    "lgpl": ("GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 3", "LGPL", "LGPLv3", "LGPL-2.1"),
    "mit": ("MIT License", "MIT licence", "MIT/X11 License", "Expat License", "MIT-licensed code", "MIT Public License"),
    "mpl": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0", "Mozilla Public License, v. 2.0"),
    "unlicense": ("Unlicense", "The Unlicense"),
}
# Short names, which say so only in a statement.
SHORT_NAMES = {"apache-2.0": ("Apache 2.0", "Apache"), "bsd": ("BSD",), "gpl": ("GPL",), "isc": ("ISC",), "mit": ("MIT", "Expat", "MIT/X11", "X11"), "mpl": ("MPL",)}
# Licences that stand for all that are not known.
OTHER_NAMES = ("Artistic License 2.0", "Boost Software License, Version 1.0", "zlib License", "Eclipse Public License 2.0", "European Union Public Licence 1.2", "SIL Open Font License, Version 1.1", "Common Development and Distribution License", "Microsoft Public License", "Academic Free License v3.0", "Q Public License", "WTFPL", "Open Data Commons Open Database License", "PostgreSQL License", "Python Software Foundation License", "Business Source License 1.1", "Elastic License 2.0", "Server Side Public License", "Open Government Licence v3.0", "Acme Shareware License", "Community Research License", "Sample Evaluation License 1.4")
# How a licence is stated.
STATEMENTS = ("{}", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Released under {}.", "Distributed under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "This work is licensed under {}.", "This project is licensed under the {}.", "This software is released under the {}.", "This file is made available under the {}.", "Made available under the {}.", "Available under the {}.", "Published under the {}.", "The content is available under {}.", "License: {}", "SPDX-License-Identifier: {}", "This program is distributed under the terms of the {}.", "You may use this under the terms of the {}.", "Code is under the {}; see the LICENSE file for details.", "See the {} for more details.", "Terms: {}", "Dual {}.", "{} licensed.", "Licence: {}")
# Sentences of the licences' own texts and notices.
TEMPLATES = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "gpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/"),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "agpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "cc-by": ("You are free to share and adapt the material for any purpose, even commercially, under the following terms: you must give appropriate credit.",),
}
OTHER_STATEMENTS = ("All rights reserved.", "Copyright 2019 Example Corp. All rights reserved.", "© 2021 The Authors. All rights reserved.", "No part of this publication may be reproduced without written permission of the publisher.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.", "Use of this material requires a commercial license.", "This software may be used for evaluation only under the vendor's license.", "Copyright notice: reproduction is permitted with attribution.")
# Sentences that use the words without granting anything.
DECOYS = ("He lost his driver's license last week.", "The restaurant needs a liquor license before it can open.", "She asked for permission to leave early.", "Researchers at MIT published a new study.", "The warranty on the car expired in May.", "Apache helicopters flew over the valley.", "Copyright law was debated in parliament.", "A fishing licence costs twenty euros.", "The gnu is a large African antelope.", "They bought a public house under a new name.", "Version 2.0 of the game is out.", "The general public was not admitted.", "Parents give permission for the school trip.", "Creative people share the commons of ideas.", "The software runs on any machine.", "He took artistic license with the story.", "The plate on the license office read closed.", "All rights and duties were explained to the tenants.", "The film was released under a different title.", "The company was licensed to sell wine.", "The work was published in two parts.", "Distributed systems are hard.", "The firm bought a software license for every desk.", "They renewed the license of the shop last spring.", "Her license for the software ran out in June.", "The office keeps a license for general use of the hall.", "A license was issued to the company in 1999.")
def words(text: str) -> list[str]:
    """What the SQL form ``words_sql`` gives for ASCII letters; the training texts have no others."""
    out, here = [], []
    for c in text.lower():
        if c.isalnum():
            here.append(c)
        elif here:
            out.append("".join(here))
            here = []
    return [*out, "".join(here)] if here else out


def words_sql(column: str):
    return F.array_remove(F.split(F.lower(F.col(column)), r"[^\p{L}\p{N}]+"), "")


def grams(text: str, sizes=range(1, GRAM + 1)) -> set[str]:
    w = words(text)
    return {" ".join(w[i : i + n]) for n in sizes for i in range(len(w) - n + 1)}


def shingles(w: list[str]) -> list[str]:
    return [" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)] if len(w) > SHINGLE else [" ".join(w)]


@dataclass
class Classifier:
    classes: list[str]
    weights: dict[str, np.ndarray]
    bias: np.ndarray
    temperature: float
    least: float

    def probabilities(self, text: str) -> np.ndarray:
        score = self.bias + sum((self.weights[g] for g in grams(text) if g in self.weights), np.zeros(len(self.classes)))
        e = np.exp((score - score.max()) / self.temperature)
        return e / e.sum()

    def predict(self, text: str) -> tuple[str, float]:
        """The rule that ``scored`` states in SQL, for one paragraph."""
        if not any(g in self.weights for g in grams(text)):
            return NONE, 1.0
        p = self.probabilities(text)
        best = int(p.argmax())
        if self.classes[best] != NONE and p[best] < self.least:
            return UNKNOWN, float(p[best])
        return self.classes[best], float(p[best])


def statements() -> list[tuple[str, str]]:
    """(family, statement) for all names; a short one never stands alone."""
    out = [(f, s.format(n)) for f, names in NAMES.items() for n in names for s in STATEMENTS]
    return out + [(f, s.format(n)) for f, names in SHORT_NAMES.items() for n in names for s in STATEMENTS if s != "{}"]


def templates() -> list[tuple[str, str, bool]]:
    """(family, words of a template joined by spaces, whether it is a bare name)."""
    bare = {" ".join(words(n)) for names in NAMES.values() for n in names}
    out = statements() + [(f, t) for f, texts in TEMPLATES.items() for t in texts]
    return sorted({(f, t := " ".join(words(text)), t in bare) for f, text in out})


def similarity(text: str, family: str) -> float:
    """What ``compared`` states in SQL, for one paragraph."""
    w = words(text)
    own = [" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)]
    known = {s for f, t, _ in templates() if f == family and len(t.split()) >= SHINGLE for s in shingles(t.split())}
    best = sum(s in known for s in own) / len(own) if own else 0.0
    held = grams(text, range(1, SHINGLE + 1))
    for f, t, bare in templates():
        if f == family and (not bare or len(w) == len(t.split())):
            parts = set(shingles(t.split()))
            best = max(best, sum(p in held for p in parts) / len(parts))
    return best


def examples(corpus: list[str]) -> list[tuple[str, str, bool]]:
    """(class, text, held out) for training and calibration; a rule spreads the held-out ones over all classes."""
    rows = statements()
    for f, texts in TEMPLATES.items():
        for t in texts:
            w = t.split()
            rows += [(f, " ".join(w[i : i + n])) for n in (12, 20, len(w)) for i in range(0, max(1, len(w) - n + 1), 3)]
    rows += [(UNKNOWN, s.format(n)) for n in OTHER_NAMES for s in STATEMENTS]
    rows += [(UNKNOWN, p + t) for t in OTHER_STATEMENTS for p in ("", "Notice: ", "Please note. ")]
    rows += [(NONE, t) for t in DECOYS for _ in range(4)] + [(NONE, t) for t in corpus] + [(NONE, s.format("new rules")) for s in STATEMENTS if "icens" not in s and "ICENSE" not in s]
    return [(c, t, i % 5 == 4) for i, (c, t) in enumerate(rows)]


def train(corpus: list[str], steps: int = 300, l1: float = 2e-5) -> Classifier:
    """Proximal gradient descent with acceleration; classes weigh alike but for ``none``, which weighs as half of all."""
    rows = examples(corpus)
    classes = sorted({c for c, _, _ in rows})
    fit, held = [r for r in rows if not r[2]], [r for r in rows if r[2]]
    usual = Counter(g for t in corpus for g in grams(t))
    stated = Counter(g for c, t, _ in fit if c != NONE or t in DECOYS for g in grams(t))
    vocabulary = {g: i for i, g in enumerate(sorted(g for g, n in stated.items() if n > 1 and usual[g] < USUAL))}

    # Rows and columns of the sparse matrix of examples and n-grams, either way around.
    own = [sorted(vocabulary[g] for g in grams(t) if g in vocabulary) for _, t, _ in fit]
    filled = np.array([bool(o) for o in own])
    lengths = np.array([len(o) for o in own])
    index = np.array([i for o in own for i in o], dtype=np.int64)
    starts = np.r_[0, np.cumsum(lengths[filled])[:-1]]
    order = np.argsort(index, kind="stable")
    row_of = np.repeat(np.arange(len(fit)), lengths)[order]
    used, column_starts = np.unique(index[order], return_index=True)
    y = np.array([classes.index(c) for c, _, _ in fit])
    size = np.bincount(y, minlength=len(classes))
    share = np.where(np.arange(len(classes)) == classes.index(NONE), 0.5, 0.5 / max(1, len(classes) - 1))
    each = (share / np.maximum(1, size))[y].astype(np.float32)
    hot = np.eye(len(classes), dtype=np.float32)[y]
    w, b = np.zeros((len(vocabulary), len(classes)), dtype=np.float32), np.zeros(len(classes), dtype=np.float32)
    vw, vb = w.copy(), b.copy()
    rate = 2 / float(each @ (lengths + 1))
    for step in range(1, steps + 1):
        s = np.tile(vb, (len(fit), 1))
        s[filled] += np.add.reduceat(vw[index], starts, axis=0)
        e = np.exp(s - s.max(axis=1, keepdims=True))
        g = (e / e.sum(axis=1, keepdims=True) - hot) * each[:, None]
        nw = vw.copy()
        nw[used] -= rate * np.add.reduceat(g[row_of], column_starts, axis=0)
        nw = np.sign(nw) * np.maximum(0, np.abs(nw) - rate * l1)
        nb = vb - rate * g.sum(axis=0)
        beta = (step - 1) / (step + 2)
        vw, vb = nw + beta * (nw - w), nb + beta * (nb - b)
        w, b = nw, nb
    names = list(vocabulary)
    model = Classifier(classes, {names[i]: w[i].astype(np.float64) for i in np.flatnonzero(np.abs(w).max(axis=1) > 0)}, b.astype(np.float64), 1.0, 0.0)
    assert len(model.weights) <= MOST_WEIGHTS and classes[int(b.argmax())] == NONE

    # Temperature: the best of a few by the likelihood of the held-out part.
    def loss(t: float) -> float:
        model.temperature = t
        return -sum(np.log(model.probabilities(text)[classes.index(c)] + 1e-12) for c, text, _ in held)
    model.temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0), key=loss)
    # Least probability: other licences' held-out statements that look like a family stay below it, 95 % of them.
    wrong = sorted(float(p.max()) for c, text, _ in held if c == UNKNOWN and classes[int((p := model.probabilities(text)).argmax())] not in (NONE, UNKNOWN))
    others = sum(c == UNKNOWN for c, _, _ in held)
    allowed = int(0.05 * others)
    model.least = min(0.9, max(0.5, wrong[-allowed - 1] if len(wrong) > allowed else 0.5))
    return model


def sample(docs: DataFrame, most: int = CORPUS_PARAGRAPHS, letters: int = LETTERS) -> list[str]:
    """A bounded sample, by a hash, of the corpus' paragraphs that hold nothing of the templates: no name, and no five words of a template."""
    n = docs.count()
    chosen = docs.select(text_of().alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(min(1.0, most / max(1, n)) * (1 << 30)))
    pieces = chosen.select(F.explode(F.split("text", PARAGRAPH)).alias("piece")).where(F.length("piece").between(20, letters)).distinct()
    first = [r.piece for r in pieces.orderBy(F.xxhash64("piece"), "piece").limit(2 * most).collect()]
    told = {s for _, t, _ in templates() if len(t.split()) >= SHINGLE for s in shingles(t.split())}
    names = {" ".join(words(n)) for own in (*NAMES.values(), OTHER_NAMES) for n in own} | {"license", "licence", "licensed", "copyright"}
    sizes = {len(n.split()) for n in names} | {SHINGLE}
    return [p for p in first if not grams(p, sizes) & (told | names)][:most]


def _hash(array: str, at, n: int):
    """Hash of n words from a place on; one that runs over the end is that of no n-gram."""
    return F.xxhash64(F.lit(n), *(F.get(F.col(array), at + i) for i in range(n)))


def _hashed(grams_: DataFrame) -> DataFrame:
    """The table of grams with their hashes h in place of gram."""
    cut = grams_.withColumn("__w", F.transform(F.split("gram", " "), lambda w: F.xxhash64(w)))
    h = F.lit(None).cast("long")
    for n in range(1, SHINGLE + 1):
        h = F.when(F.size("__w") == n, _hash("__w", F.lit(0), n)).otherwise(h)
    return cut.withColumn("h", h).drop("gram", "__w")


def _hits(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, mark, no, n, at, h) of each place of a text where a known n-gram stands: number and words of the paragraph, place in it.

    Looking up is one generated stage over rows of bounded size; nothing but hits leaves it.
    """
    pieces = docs.select("doc_id", F.xxhash64(text_of()).alias("mark"), F.posexplode(F.split(text_of(), PARAGRAPH)).alias("no", "piece"))
    cut = pieces.select("doc_id", "mark", "no", words_sql("piece").alias("words")).where(F.size("words") > 0)
    starts = cut.select("doc_id", "mark", "no", "words", F.size("words").alias("n"), F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(CHUNK))).alias("start"))
    chunks = starts.select("doc_id", "mark", "no", "n", "start", F.transform(F.slice("words", F.col("start") + 1, F.lit(CHUNK + SHINGLE - 1)), lambda w: F.xxhash64(w)).alias("w"))
    places = chunks.select("doc_id", "mark", "no", "n", "start", "w", F.explode(F.sequence(F.lit(0), F.least(F.lit(CHUNK), F.col("n") - F.col("start")) - 1)).alias("i"))
    hashed = places.select("doc_id", "mark", "no", "n", (F.col("start") + F.col("i")).alias("at"), F.explode(F.array(*(_hash("w", F.col("i"), n) for n in range(1, SHINGLE + 1)))).alias("h"))
    return hashed.join(F.broadcast(known), "h", "left_semi").distinct()  # repeated documents repeat their hits


PLACE = ["doc_id", "mark", "no"]


def scored(hits: DataFrame, weights: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, mark, no, family, probability) of the paragraphs that are not none."""
    met = hits.select(*PLACE, "h").distinct().join(F.broadcast(weights), "h")
    # Weights are summed as integers of 1e-9, so that the sum does not hang on the order of its terms.
    sums = met.groupBy(*PLACE).agg(*(F.sum(F.round(F.get("w", F.lit(i)) * 1e9).cast("long")).alias(f"s{i}") for i in range(len(model.classes))))
    score = F.array(*((F.col(f"s{i}") / F.lit(1e9) + float(b)) / model.temperature for i, b in enumerate(model.bias)))
    ranked = sums.select(*PLACE, score.alias("score")).withColumn("top", F.array_max("score"))
    norm = F.aggregate("score", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("top")))
    names = F.array(*map(F.lit, model.classes))
    best = ranked.select(*PLACE, F.element_at(names, F.array_position("score", F.col("top")).cast("int")).alias("class"), (1 / norm).alias("probability"))
    family = F.when((F.col("class") != NONE) & (F.col("probability") < model.least), F.lit(UNKNOWN)).otherwise(F.col("class"))
    return best.select(*PLACE, family.alias("family"), "probability").where(F.col("family") != NONE)


def compared(hits: DataFrame, shares: DataFrame, whole: DataFrame) -> DataFrame:
    """(doc_id, mark, no, family, similarity): the larger of how much of the paragraph stands in the family's templates, and of one of them in it."""
    inside = hits.join(F.broadcast(shares), "h").groupBy(*PLACE, "n", "family").agg((F.count(F.lit(1)) / (F.first("n") - (SHINGLE - 1))).alias("share"))
    holds = hits.select(*PLACE, "n", "h").distinct().join(F.broadcast(whole), "h").where(~F.col("bare") | (F.col("n") == F.col("size"))).groupBy(*PLACE, "family", "template").agg((F.count(F.lit(1)) / F.first("parts")).alias("share"))
    return inside.select(*PLACE, "family", "share").unionByName(holds.select(*PLACE, "family", "share")).groupBy(*PLACE, "family").agg(F.max("share").alias("similarity"))


def scan(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """One row per licence paragraph: doc_id, mark (a hash of the text), no, family, probability, similarity, confirmed."""
    spark = docs.sparkSession
    model = model or train(sample(docs))
    weights = _hashed(spark.createDataFrame([(g, [float(v) for v in w]) for g, w in sorted(model.weights.items())] or [("", [0.0] * len(model.classes))], "gram string, w array<double>"))
    forms = templates()
    shares = _hashed(spark.createDataFrame(sorted({(s, f) for f, t, _ in forms if len(t.split()) >= SHINGLE for s in shingles(t.split())}), "gram string, family string"))
    whole = _hashed(spark.createDataFrame([(s, f, i, len(parts), len(t.split()), bare) for i, (f, t, bare) in enumerate(forms) for parts in [set(shingles(t.split()))] for s in sorted(parts)], "gram string, family string, template int, parts int, size int, bare boolean"))
    known = stored(weights.select("h").unionByName(whole.select("h")).distinct())
    hits = stored(_hits(docs, known))
    named, like = scored(hits, weights, model).alias("a"), compared(hits, shares, whole).alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    for c in ("mark", "no", "family"):
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    found = named.join(like, same, "left").select("a.*", F.coalesce("b.similarity", F.lit(0.0)).alias("similarity"))
    return found.withColumn("confirmed", F.col("similarity") >= SIMILARITY)


def license_report(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """One row per document: doc_id, n_paragraphs (those about licences), n_confirmed, families (confirmed ones, in order, joined by commas), n_unknown (those of no known family, or not confirmed)."""
    sure = F.col("confirmed") & (F.col("family") != UNKNOWN)
    each = scan(docs, model).groupBy(F.col("doc_id").alias("id"), F.col("mark").alias("m")).agg(F.count(F.lit(1)).alias("n_paragraphs"), F.count_if(sure).alias("n_confirmed"), F.array_join(F.array_sort(F.collect_set(F.when(sure, F.col("family")))), ",").alias("families"))
    ids = docs.select("doc_id", F.xxhash64(text_of()).alias("mark"))
    joined = ids.join(each, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m")), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return joined.select("doc_id", count("n_paragraphs").alias("n_paragraphs"), count("n_confirmed").alias("n_confirmed"), F.coalesce("families", F.lit("")).alias("families"), (count("n_paragraphs") - count("n_confirmed")).alias("n_unknown"))

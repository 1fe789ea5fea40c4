"""Personal data: base patterns, and a skip-chain conditional random field.

The base patterns (email, ip, card, phone) are exact.  The field adds spans
that they miss: reformatted or broken-up data, and repeats of data that was
found elsewhere in the document.

Model.  A document is cut at white space.  A token is a node of the field if
it has a digit, an at sign or a bracketed "at" or "dot", stands beside such a
bracket or a free-standing at sign, or repeats the part of an address before
the at sign; all other
tokens have the label O for certain, so they cut the chain and cost nothing.
Nodes that are neighbours in the text share a chain potential.  Tokens with a
signature in common (their digits, their text, the part of an address before
the at sign) share a skip potential, however far apart: each is linked to the
next one with that signature, which makes links linear in the tokens.  Tokens
that a base span covers have its label as evidence.  Sum-product
messages are passed over both kinds of edges; a token takes the label of its
largest belief.

Training.  A bounded sample of documents lends its words; data of all kinds are
made up and put between them, as the base patterns know them, in other forms
(``rewritten``), and once more in part; so are numbers that are none (years, dates,
versions, digits that fail the card check), for the label O.  Parameters
maximise the pseudo-likelihood.

Edge cases: null text counts as empty: no spans, and base_sha256 is the hash of
the empty string; null ids stay null; repeated rows give one row each; very
long texts are scanned once by each pattern in linear time, and the field's
memory is a few hundred bytes for each of their nodes; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, text_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
#: Documents whose words the field learns between, letters of each, and examples made of them.
DOCUMENTS, LETTERS, EXAMPLES = 400, 5_000, 1500
ROUNDS, DAMPING = 12, 0.3
#: Least belief of an added span.
BELIEF = 0.8
#: Most neighbouring tokens that are looked at as one number.
RUN = 6

# The patterns are the stated ones, written so that a run of characters is tried once only.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _emails(text: str) -> list[tuple[str, int, int]]:
    """From each at sign back to where its run of local characters or the last match's end is."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _HOST.match(text, at + 1)):
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = []
    if "@" in text:
        out += _emails(text)
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# Nodes of the field

_TOKEN = re.compile(r"\S+")
_SPELLED = re.compile(r"[\[({<](?:at|dot|\.)[\])}>]", re.IGNORECASE)
_AT = re.compile(r"@|[\[({<]at[\])}>]", re.IGNORECASE)
_CORE = re.compile(r"[^\s.,;:!?\"'()\[\]{}<>](?:.*[^\s.,;:!?\"'()\[\]{}<>])?", re.DOTALL)
_EDGES = ".,;:!?\"'()[]{}<>"
_OCTETS = re.compile(r"[0-9]{1,3}(?:(?:\.|[\[({<](?:dot|\.)[\])}>])[0-9]{1,3}){3}", re.IGNORECASE)
_GROUPS = re.compile(r"\(?[0-9]{2,4}\)?(?:[-./_][0-9]{2,4})*")
_CALL = re.compile(r"\(?[0-9]{3}[)/.-]{1,2}[0-9]{3}[.-]?[0-9]{4}|0[0-9]{1,4}[/-][0-9]{5,8}|(?:00|1|0)[0-9]{9,12}")
_DATE = re.compile(r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?")
_FOUR = re.compile(r"[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_SPELT_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+[\[({<]at[\])}>][A-Za-z0-9-]+(?:(?:\.|[\[({<]dot[\])}>])[A-Za-z0-9-]+)+", re.IGNORECASE)
# Words before data of a kind.
CUES = (frozenset("email e-mail mail write contact".split()), frozenset("ip host server address".split()), frozenset("card visa mastercard amex iban".split()), frozenset("call phone tel telephone fax mobile ring".split()))


@dataclass
class Nodes:
    spans: list[tuple[int, int]]
    features: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _shape(token: str) -> list[float]:
    core = token.strip(_EDGES)
    found = _digits(core)
    digits = len(found)
    letters = sum(c.isalpha() for c in core)
    octets = _OCTETS.fullmatch(core)
    return [
        1.0,
        "@" in token,
        token.lstrip("(").startswith("+"),
        *(lo <= digits <= hi for lo, hi in ((1, 2), (3, 3), (4, 4), (5, 6), (7, 8), (9, 12), (13, 19))),
        digits >= 20,
        letters > 0,
        letters > 3,
        digits > 0 and letters > 0,
        digits + letters > 24 and _SPELLED.search(core) is None,
        octets is not None,
        octets is not None and all(int(p) <= 255 for p in re.findall("[0-9]+", core)),
        _GROUPS.fullmatch(core) is not None and letters == 0,
        "-" in token,
        token.startswith("("),
        any(c in token for c in "=\"'/_#$%&*"),
        13 <= digits <= 19 and luhn(found),
        13 <= digits <= 19 and not luhn(found),
        _FOUR.fullmatch(core) is not None,
        _FOUR.fullmatch(core) is not None and luhn(found),
        _CALL.fullmatch(core) is not None,
        _DATE.fullmatch(core) is not None,
        digits == 4 and letters == 0 and found[:2] in ("18", "19", "20"),
        _SPELLED.fullmatch(token.strip(",;")) is not None or token == "@",
        _SPELT_ADDRESS.fullmatch(core) is not None,
        _DOMAIN.fullmatch(core) is not None and letters > 1,
        digits == 0 and ("." in core or "_" in core),
    ]


def _runs(words: list[str], follows: np.ndarray) -> np.ndarray:
    """For each node, whether it is a part of neighbours that make up a call number, a valid card number, or four groups that are none."""
    out = np.zeros((len(words), 4))
    cores = [w.strip(".,;:!?\"'") for w in words]
    plain = [_digits(c) if not any(x.isalpha() or x == "@" for x in c) and not _OCTETS.fullmatch(c) else "" for c in cores]
    for i in range(len(words)):
        if not plain[i]:
            continue
        digits, j = plain[i], i
        while j + 1 < len(words) and j - i < RUN and follows[j] and plain[j + 1]:
            j += 1
            digits += plain[j]
            groups = [len(plain[k]) for k in range(i, j + 1)]
            opens = cores[i].startswith(("+", "(", "00")) or cores[i] == "1"
            if 9 <= len(digits) <= 13 and opens and max(groups) <= 8 and groups[-1] >= 3:
                out[i : j + 1, 0] = 1
            if 9 <= len(digits) <= 11 and not opens and min(groups) >= 2 and max(groups) <= 7 and groups[-1] >= 4:
                out[i : j + 1, 1] = 1
            if 13 <= len(digits) <= 19 and all(g == 4 for g in groups[:-1]) and groups[-1] <= 4:
                out[i : j + 1, 2 if luhn(digits) else 3] = 1
    return out


def nodes(text: str) -> Nodes | None:
    """The nodes of a text with their features and edges, or None if it has none."""
    if not ("@" in text or _DIGIT.search(text) or _SPELLED.search(text)):
        return None
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    words = [text[a:b] for a, b in tokens]
    spelled = {i for i, w in enumerate(words) if (w[0] in "[({<" and _SPELLED.fullmatch(w.strip(",;"))) or w == "@"}
    names = {m.lower() for w in words if (at := _AT.search(w)) and len(m := w[: at.start()].strip(_EDGES)) > 3}
    names |= {m.lower() for i in spelled if i and _AT.fullmatch(words[i]) and len(m := words[i - 1].strip(_EDGES)) > 3}
    chosen = {i for i, w in enumerate(words) if "@" in w or _DIGIT.search(w) or (_SPELLED.search(w) if ")" in w or "]" in w or "}" in w or ">" in w else False)}
    chosen |= {j for i in spelled for j in (i - 1, i, i + 1) if 0 <= j < len(words)}
    if names:
        chosen |= {i for i, w in enumerate(words) if w.strip(_EDGES).lower() in names}
    if not chosen:
        return None
    chosen = sorted(chosen)
    own = [words[i] for i in chosen]
    shapes = np.array([_shape(w) for w in own], dtype=np.float32)
    follows = np.array([b - a == 1 for a, b in zip(chosen, chosen[1:], strict=False)], dtype=bool)
    before, after = np.zeros_like(shapes), np.zeros_like(shapes)
    before[1:][follows] = shapes[:-1][follows]
    after[:-1][follows] = shapes[1:][follows]
    said = np.zeros((len(chosen), len(CUES)), dtype=np.float32)
    for n, i in enumerate(chosen):
        near = {words[j].strip(_EDGES).lower() for j in range(max(0, i - 2), i)}
        said[n] = [bool(near & cue) for cue in CUES]
    features = np.hstack([shapes, before[:, 1:], after[:, 1:], said, _runs(own, follows).astype(np.float32)])
    last: dict[tuple[str, str], int] = {}
    skip = set()
    for n, i in enumerate(chosen):
        if i in spelled:
            continue
        core = words[i].strip(_EDGES)
        marks = {("text", core.lower())} if len(core) > 3 else set()
        if len(d := _digits(core)) >= 4:
            marks.add(("digits", d))
            ahead = _digits(own[n - 1]) if n and follows[n - 1] and len(d) < 7 else ""
            if len(ahead + d) >= 7:
                marks.add(("digits", (ahead + d)[-7:]))  # a call number without its area
        if (at := _AT.search(core)) and at.start() > 3:
            marks.add(("text", core[: at.start()].lower()))
        for mark in marks:
            if mark in last and last[mark] != n:
                skip.add((last[mark], n))
            last[mark] = n
    at = np.flatnonzero(follows)
    return Nodes([tokens[i] for i in chosen], features, np.c_[at, at + 1], np.array(sorted(skip), dtype=np.int64).reshape(-1, 2))


@dataclass
class Field:
    """Unary weights (feature, label), chain (left label, right label) and skip (symmetric) potentials, as logarithms."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def beliefs(self, graph: Nodes, evidence: np.ndarray | None = None) -> np.ndarray:
        """Label probabilities of each node by damped sum-product message passing; evidence has a label, or -1, for each node."""
        scores = (graph.features @ self.unary).astype(np.float32)
        if evidence is not None and (known := np.flatnonzero(evidence >= 0)).size:
            scores[known] = -60.0
            scores[known, evidence[known]] = 0.0
        if not len(graph.chain) and not len(graph.skip):
            return _softmax(scores)
        k = len(LABELS)
        # Sender, receiver and potential[sender's label, receiver's label] of the messages along and against each kind of edge.
        ways = [(e[:, i], e[:, 1 - i], np.exp(m if i == 0 else m.T).astype(np.float32)) for e, m in ((graph.chain, self.chain), (graph.skip, self.skip)) for i in (0, 1)]
        messages = [np.full((len(s), k), -np.log(k), dtype=np.float32) for s, _, _ in ways]

        def total() -> np.ndarray:
            out = scores.copy()
            for (_, receiver, _), m in zip(ways, messages, strict=True):
                np.add.at(out, receiver, m)
            return out

        for _ in range(ROUNDS):
            now = total()
            fresh = []
            for w, (sender, _, potential) in enumerate(ways):
                back = messages[w ^ 1]  # what came the other way along the same edges
                new = _softmax(now[sender] - back) @ potential
                fresh.append(DAMPING * messages[w] + (1 - DAMPING) * np.log(new / new.sum(axis=1, keepdims=True) + 1e-30))
            messages = fresh
        return _softmax(total())

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Spans of the field that touch no base span; neighbouring tokens of one label are one span."""
        graph = nodes(text)
        if graph is None:
            return []
        evidence = np.full(len(graph.spans), -1)
        starts = np.array([a for a, _ in graph.spans])
        ends = np.array([b for _, b in graph.spans])
        for kind, a, b in base:
            evidence[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b)] = LABELS.index(kind)
        covered = evidence >= 0
        if covered.all():
            return []
        belief = self.beliefs(graph, evidence)
        label = np.where((belief.max(axis=1) >= BELIEF) & ~covered, belief.argmax(axis=1), 0)
        follows = {int(a) for a, _ in graph.chain}
        whole = [len(_digits(text[a:b])) >= 13 for a, b in graph.spans]  # two card numbers in a row are two
        out, i = [], 0
        while i < len(label):
            j = i
            while j in follows and label[j + 1] == label[i] and not (whole[j] or whole[j + 1]):
                j += 1
            if label[i]:
                a, b = graph.spans[i][0], graph.spans[j][1]
                if m := _CORE.search(text, a, b):
                    out.append((LABELS[label[i]], *m.span()))
            i = j + 1
        return out


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# Training


def _labels(graph: Nodes, spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(len(graph.spans), dtype=np.int64)
    for kind, a, b in spans:
        for i, (x, y) in enumerate(graph.spans):
            if x < b and a < y:
                out[i] = LABELS.index(kind)
    return out


def _card(rng: random.Random) -> str:
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def _number(rng: random.Random, n: int) -> str:
    return str(rng.randrange(1, 10)) + "".join(rng.choice("0123456789") for _ in range(n - 1))


def made_up(kind: str, words: list[str], rng: random.Random) -> str:
    """A value of the kind in the form of the base patterns."""
    name = lambda: re.sub("[^a-z]", "", rng.choice(words).lower()) or "jo"
    if kind == "email":
        local = rng.choice(("{a}.{b}", "{a}{n}", "{a}_{b}{n}", "{a}.{n}", "{a}")).format(a=name(), b=name(), n=rng.randrange(1, 99))
        return f"{local}@{name()}.{rng.choice(('com', 'org', 'example.com', 'de'))}"
    if kind == "ip":
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == "card":
        return _card(rng)
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    return rng.choice((f"+1 ({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"+49 {rng.randrange(20, 99)} {b}{c}", f"+1{a}{b}{c}"))


def rewritten(kind: str, value: str, rng: random.Random) -> str:
    """The value in a form that the base patterns miss."""
    if kind == "email":
        local, _, host = value.partition("@")
        left, right = rng.choice(("[]", "()", "{}"))
        at, dot = f"{left}{rng.choice(('at', 'AT'))}{right}", rng.choice((".", f"{left}dot{right}"))
        host = host.replace(".", dot)
        return rng.choice((local + at + host, local + at + host.replace(".", dot), f"{local} {at} {host}", f"{local} {at} " + host.replace(dot, f" {dot} ") if dot != "." else f"{local} {at} {host}", f"{local} @ {value.partition('@')[2]}"))
    if kind == "ip":
        return value.replace(".", rng.choice(("[.]", "(.)", "[dot]", "(dot)")))
    if kind == "card":
        cut = [value[i : i + 4] for i in range(0, len(value), 4)]
        return rng.choice((".", "/", "_", "  ")).join(cut)
    digits = _digits(value)[-10:].rjust(10, "2")
    a, b, c = digits[:3], digits[3:6], digits[6:]
    return rng.choice((f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}.{b}.{c}", f"1{a}{b}{c}", f"1 {a} {b} {c}", f"{a} {b} {c}", f"0{a}/{b}{c}", f"00{rng.randrange(30, 50)} {a} {b}{c}", f"1-{a}-{b}-{c}"))


def other_number(rng: random.Random) -> str:
    """Something with digits that is no personal data."""
    n = lambda hi: rng.randrange(1, hi)
    bad = _card(rng)
    bad = bad[:-1] + str((int(bad[-1]) + n(10)) % 10)
    return rng.choice((str(rng.randrange(1800, 2030)), f"{rng.randrange(1900, 2030)}-{n(13):02d}-{n(29):02d}", f"{n(29)}.{n(13)}.{rng.randrange(1900, 2030)}", f"{n(13)}/{n(29)}/{rng.randrange(10, 99)}", f"{n(24)}:{n(60):02d}", str(n(10)), str(n(1000)), str(n(100_000)), f"{n(1000)}.{n(100):02d}", f"{n(9)}.{n(20)}", f"{n(9)}.{n(20)}.{n(9)}", f"{n(90)}%", f"${n(90)},{n(900):03d}", f"{n(90)}-{n(90)}", bad, " ".join(bad[i : i + 4] for i in range(0, 16, 4)), "%040x" % rng.getrandbits(160), f'"{rng.getrandbits(100):x}"', _number(rng, 6), _number(rng, 8), f"{n(300) + 255}.{n(900)}.{n(900)}.{n(900)}", f"978-{n(9)}-{n(90) + 9}-{n(900000) + 99999}-{n(9)}", f"#{n(9999)}", f"v{n(9)}.{n(9)}", f"{n(99)} {n(999)} {n(99)}"))


def example(words: list[str], rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A text with made-up data and other numbers between words, and the spans of the data."""
    text, spans, seen = "", [], []

    def put(piece: str, kind: str | None = None) -> None:
        nonlocal text
        text += " " if text else ""
        if kind:
            spans.append((kind, len(text), len(text) + len(piece)))
        text += piece

    for _ in range(rng.randrange(1, 5)):
        for _ in range(rng.randrange(0, 9)):
            put(rng.choice(words))
        kind, turn = rng.choice(KINDS), rng.random()
        if turn < 0.3:
            put(other_number(rng) + rng.choice(("", "", ".", ",")))
            continue
        if turn < 0.45:
            put(rng.choice(sorted(CUES[KINDS.index(kind)])) + rng.choice(("", ":")))
        value = made_up(kind, words, rng)
        if kind == "card" and rng.random() < 0.3:
            put(_number(rng, 15) + str((int(value[-1]) + 1) % 10))
        put(rewritten(kind, value, rng) if rng.random() < 0.6 else value, kind)
        seen.append((kind, value))
    for kind, value in seen:
        if rng.random() < 0.6:  # once more, in part
            for _ in range(rng.randrange(2, 9)):
                put(rng.choice(words))
            local = value.partition("@")[0]
            if kind == "email":
                # A name that is a word like others is one when it stands alone.
                put(local, kind if re.search("[0-9._]", local) else None)
            elif kind == "card":
                put(value, kind)
            elif kind == "phone":
                put(_digits(value)[-7:] if rng.random() < 0.5 else value[1:], kind)
            else:
                put(value, kind)
    put(rng.choice(words))
    return text, spans


def train(texts: list[str], steps: int = 200, rate: float = 0.1, penalty: float = 3e-5, examples: int = EXAMPLES) -> Field:
    """Pseudo-likelihood by Adam over the nodes of examples made of the texts' words."""
    rng = random.Random(7)
    words = [w for t in texts for w in t.split()[:200] if not _DIGIT.search(w) and "@" not in w and len(w) < 30] or ["word", "other", "name"]
    graphs, labels = [], []
    for _ in range(examples):
        text, spans = example(words, rng)
        if (g := nodes(text)) is not None:
            graphs.append(g)
            labels.append(_labels(g, spans))
    k = len(LABELS)
    x, y = np.vstack([g.features for g in graphs]).astype(np.float32), np.concatenate(labels)
    offset = np.cumsum([0, *(len(g.spans) for g in graphs)])[:-1]
    chain = np.concatenate([g.chain + o for g, o in zip(graphs, offset, strict=True)])
    skip = np.concatenate([g.skip + o for g, o in zip(graphs, offset, strict=True)])
    hot = np.eye(k, dtype=np.float32)[y]
    left, right, far = (np.zeros((len(y), k), dtype=np.float32) for _ in range(3))
    left[chain[:, 1]], right[chain[:, 0]] = hot[chain[:, 0]], hot[chain[:, 1]]
    np.add.at(far, skip[:, 0], hot[skip[:, 1]])
    np.add.at(far, skip[:, 1], hot[skip[:, 0]])
    weights = [np.zeros((x.shape[1], k), dtype=np.float32), np.zeros((k, k), dtype=np.float32), np.zeros((k, k), dtype=np.float32)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        u, t, s = weights
        g = (_softmax(x @ u + left @ t + right @ t.T + far @ s) - hot) / len(y)
        ds = far.T @ g
        for i, d in enumerate((x.T @ g, left.T @ g + (right.T @ g).T, (ds + ds.T) / 2)):
            d = d + penalty * weights[i]
            first[i] = 0.9 * first[i] + 0.1 * d
            second[i] = 0.999 * second[i] + 0.001 * d * d
            weights[i] = weights[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Field(*weights)


def sample(docs: DataFrame, documents: int = DOCUMENTS, letters: int = LETTERS) -> list[str]:
    """A bounded sample of the distinct shorter texts, by a hash of the text: of about twice as many the first ones."""
    text = text_of()
    rows = docs.select(text.alias("text"), F.xxhash64(text).alias("h")).where(F.length("text").between(1, letters))
    share = min(1.0, 2 * documents / max(1, docs.count()))
    some = rows.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    return [r.text for r in some.groupBy("h").agg(F.first("text").alias("text")).orderBy("h").limit(documents).collect()]


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def finder(docs: DataFrame, field: Field | None = None):
    """A column function: text to the report's struct."""
    spark = docs.sparkSession
    small_batches(spark)
    learned = spark.sparkContext.broadcast(field or train(sample(docs)))

    def find(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts:
            text = value.as_py()
            base = base_spans(text)
            every = base + learned.value.added(text, base)
            every.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
            rows.append({**{f"n_{k}": sum(s[0] == k for s in base) for k in KINDS}, "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(every)})
        return pa.array(rows, pa.struct([*((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())]))

    return F.arrow_udf(find, SCHEMA)


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    return docs.select("doc_id", finder(docs, field)(text_of()).alias("found")).select("doc_id", "found.*")

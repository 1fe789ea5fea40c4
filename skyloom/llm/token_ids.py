"""Token ids of whole texts, put together from the ids of their segments.

No merge crosses a segment's border, so a segment is encoded by the library
once and its ids are kept.  A worker process keeps at most ``KEPT`` segments of
at most ``KEPT_CHARS`` characters, half of them from before.  Ids are bytes,
four little-endian ones each, so that a text's ids are one join.

Byte-level BPE: segments are pre-tokens.  Byte-fallback BPE over pieces: as no
piece has a space mark behind another character (checked when a model is
opened; otherwise texts are encoded whole), segments are words with the spaces
before them.
"""

from __future__ import annotations

import re
import struct
from functools import cache

import numpy as np

from .token_counts import _cutter, _tokenizer, plain_pre_tokens

KEPT, KEPT_CHARS = 600_000, 64
SPACE_MARK = "▁"

_SEGMENT = re.compile(" *[^ ]+| +$")
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


class _Kept(dict):
    """Segment to ids; what is missing is encoded, and kept if short.  A full half becomes the old one, from which what is met again returns."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, segment: str) -> bytes:
        packed = self.old.get(segment)
        if packed is None:
            ids = self.encode(segment)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(segment) <= KEPT_CHARS:
            if len(self) >= KEPT // 2:
                self.old = dict(self)
                self.clear()
            self[segment] = packed
        return packed


@cache
def _alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


@cache
def _byte_level(path: str) -> _Kept:
    """Pre-tokens meet the library's merges directly: they are cut already and hold no special strings, or hold them as plain text."""
    merges, shown = _tokenizer(path).model, _alphabet()
    return _Kept(lambda word: [t.id for t in merges.tokenize(word.encode().decode("latin-1").translate(shown))])


def byte_level_ids(text: str, path: str, specials: bool) -> bytes:
    """Ids of a text; strings of special tokens are those tokens if ``specials`` (the library's default), else plain text."""
    kept = _byte_level(path)
    pattern = _cutter(path)[1]
    if not specials or pattern is None or not pattern.search(text):
        return b"".join(map(kept.__getitem__, plain_pre_tokens(text, path)))
    out, at = [], 0
    for found in pattern.finditer(text):
        out.extend(map(kept.__getitem__, plain_pre_tokens(text[at : found.start()], path)))
        out.append(np.asarray([_tokenizer(path).token_to_id(found.group())], dtype="<u4").tobytes())
        at = found.end()
    out.extend(map(kept.__getitem__, plain_pre_tokens(text[at:], path)))
    return b"".join(out)


@cache
def byte_level_table(path: str) -> list[bytes]:
    """The bytes of each id: its entry decoded from the byte-level alphabet."""
    codes = {c: b for b, c in _alphabet().items()}
    own = _tokenizer(path)
    out = [b""] * own.get_vocab_size()
    for entry, i in own.get_vocab().items():
        out[i] = bytes(codes[c] for c in entry) if all(c in codes for c in entry) else entry.encode()
    return out


@cache
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def _by_pieces(path: str) -> tuple[_Kept, bool]:
    model = _pieces(path)
    apart = not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", model.id_to_piece(i)) for i in range(model.get_piece_size()))
    mark = model.piece_to_id(SPACE_MARK)
    return _Kept(lambda segment: model.encode(segment) if segment else [mark]), apart


def piece_ids(text: str, path: str) -> bytes:
    """Ids of a text; the library puts one space before it."""
    if not text:
        return b""
    kept, apart = _by_pieces(path)
    if not apart:
        return np.asarray(_pieces(path).encode(text), dtype="<u4").tobytes()
    words = text.split(" ")
    if "" in words:
        words = [segment[1:] for segment in _SEGMENT.findall(" " + text)]
    return b"".join(map(kept.__getitem__, words))


@cache
def piece_table(path: str) -> list[bytes]:
    """The bytes of each id: a byte piece's byte, or the piece with space marks as spaces."""
    model = _pieces(path)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        byte = _BYTE_PIECE.fullmatch(piece)
        out.append(bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE_MARK, " ").encode())
    return out

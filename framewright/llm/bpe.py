"""Whole-text encoding with the tokenizers library, a distinct piece at a time.

Byte-level vocabularies cut a text before every run of white space that follows a visible character, and
before ASCII punctuation that follows an ASCII letter: no pre-token spans such a place, so the ids of a text
are the ids of its pieces in order.  A task encodes each distinct piece once and keeps its ids.  Vocabularies
with any other pre-tokenizer are encoded text by text.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .kernels import U64, prefix_hash, span_hash

#: Distinct pieces that a worker keeps; beyond it starts anew.
KEPT_PIECES = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_POINT = np.zeros(256, bool)
_POINT[[ord(c) for c in '.,;:!?)"']] = True


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable Latin-1, else the next free code."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = {b: chr(b) for b in kept}, 256
    for b in range(256):
        if b not in out:
            out[b], free = chr(free), free + 1
    return out


def pieces(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the pieces of all texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    cut = np.zeros(n, bool)
    before = data[:-1]
    high = before >= 0x80  # the last byte of a character: cut only where it can't be white space
    safe = _VISIBLE[before] | high
    c2 = np.flatnonzero(high[1:] & ((before[1:] == 0x85) | (before[1:] == 0xA0)) & (before[:-1] == 0xC2)) + 1
    safe[c2] = False
    wide = np.flatnonzero(high[2:] & (before[:-2] >= 0xE1) & (before[:-2] <= 0xE3)) + 2
    safe[wide] = False
    cut[1:] = (_SPACE[data[1:]] & safe) | (_POINT[data[1:]] & _LETTER[before])
    starts = off[:-1]
    cut[starts[starts < off[1:]]] = True
    return np.flatnonzero(cut)


class PieceEncoder:
    def __init__(self, path: str, kept: int = KEPT_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        kind = config.get("pre_tokenizer") or {}
        parts = kind.get("pretokenizers", [kind])
        levels = [p for p in parts if p.get("type") == "ByteLevel" and not p.get("add_prefix_space")]
        words = [p for p in parts if p.get("type") == "Split" and p.get("behavior") == "Removed"]
        self.by_space = bool(levels) and len(parts) == 1 and levels[0].get("use_regex", True) and self.normalizer is None
        steps = [n.get("type") for n in (config.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = bool(levels) and len(parts) == 2 and len(words) == 1 and self.normalizer is not None
        self.lowers = steps == ["NFC", "Replace", "Lowercase"]
        self.alphabet = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        self._empty()

    def forget(self) -> None:
        """Drop the kept pieces: workers outlive their tasks, and an executor may have many."""
        self._empty()

    def _empty(self) -> None:
        self.keys, self.begin, self.size = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _ids(self, piece: bytes) -> list[int]:
        text = piece.decode("utf-8")
        if self.by_word:
            plain = text.strip(" \t\n\v\f\r").lower() if self.lowers and text.isascii() else self.normalizer.normalize_str(text).strip(" ")
            if plain.isalpha():
                return [t.id for t in self.model.tokenize(plain.encode().decode("latin-1").translate(self.alphabet))]
        elif (text[1:] if text[:1] == " " else text).isalpha():
            return [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.alphabet))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _keep(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        size = np.array([len(x) for x in ids], np.int64)
        total = int(size.sum())
        if self.used + total > len(self.flat):
            grown = np.zeros(max(2 * len(self.flat), self.used + total), np.uint32)
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        begin = self.used + np.cumsum(size) - size
        self.used += total
        at = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.size = np.insert(self.keys, at, keys), np.insert(self.begin, at, begin), np.insert(self.size, at, size)

    def encode(self, data: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, and where each text's ids begin (n + 1 values)."""
        n = len(off) - 1
        if self.by_space or self.by_word:
            start = pieces(data, off)
        else:
            start = off[:-1][off[:-1] < off[1:]]
        end = np.append(start[1:], len(data)) if len(start) else start
        hashes = span_hash(prefix_hash(data), start, end)
        keys, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.kept:
            self._empty()
        at = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~known)
        if len(new):
            raw, a, b = data.tobytes(), start[index[new]].tolist(), end[index[new]].tolist()
            encode = self._ids if self.by_space or self.by_word else lambda x: self.tokenizer.encode(x.decode("utf-8"), add_special_tokens=False).ids
            self._keep(keys[new], [encode(raw[i:j]) for i, j in zip(a, b, strict=True)])
        at = np.searchsorted(self.keys, keys)[inverse]
        begin, size = self.begin[at], self.size[at]
        upto = np.append(0, np.cumsum(size))
        flat = self.flat[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
        ends = upto[np.searchsorted(start, off[1:])]  # ids up to the end of each text
        out = np.empty(len(flat) + n, np.uint32)
        last = ends + np.arange(n)
        body = np.ones(len(out), bool)
        body[last] = False
        out[body], out[last] = flat, end_id
        return out, np.append(0, last + 1)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder; a task forgets its kept pieces at its end."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]

"""Cutting texts into pieces whose token ids are independent of their surroundings, and remembering what each distinct piece gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from .common import ASCII_LOWER, hash_spans

_SPACE, _LETTER, _DIGIT, _MARK, _QUOTE = range(5)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[[32, 10]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = _LETTER
_CLASS[39] = _QUOTE


def plain_rows(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows of printable ASCII, line feeds and the letters U+00C0 to U+00FF only, without `<|` of special strings: for them the classes
    of single bytes tell where pre-tokens end. Other rows go to the tokenizer as they are."""
    if not len(data):
        return np.ones(len(offs) - 1, bool)
    nxt, prev = np.append(data[1:], 0), np.insert(data[:-1], 0, 0)
    odd = ((data < 32) & (data != 10)) | (data == 127) | ((data == 60) & (nxt == 124))
    high = data >= 128
    tail = (data < 192) & (prev == 0xC3) & (data != 0x97) & (data != 0xB7)
    head = (data == 0xC3) & (nxt >= 128) & (nxt < 192)
    odd |= high & ~tail & ~head
    c = np.concatenate(([0], np.cumsum(odd)))
    return c[offs[1:]] == c[offs[:-1]]


def byte_level_cuts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of pieces for byte-level pre-tokens ( word, number or mark run with a space before it; white space): before a lone space,
    before and after a lone line feed, and between a letter or digit and a mark other than an apostrophe."""
    c = _CLASS[data]
    prev, prev2, nxt = np.insert(c[:-1], 0, 9), np.insert(c[:-2], 0, [9, 9])[: len(c)], np.append(c[1:], _SPACE)
    before = np.insert(data[:-1], 0, 0)
    full = offs[1:] > offs[:-1]
    nxt[offs[1:][full] - 1] = _SPACE
    cut = (data == 32) & (prev != _SPACE) & (nxt != _SPACE)
    cut |= (data == 10) & (prev != _SPACE)
    cut |= (before == 10) & (prev2 != _SPACE) & (c != _SPACE)
    cut |= (c == _MARK) & ((prev == _LETTER) | (prev == _DIGIT))
    cut[offs[:-1][full]] = True
    return np.flatnonzero(cut)


def word_level_cuts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of pieces for pre-tokens without white space: at each change of class, but beside an apostrophe only at white space."""
    c = _CLASS[data]
    prev = np.insert(c[:-1], 0, 9)
    cut = (c != prev) & (((c != _QUOTE) & (prev != _QUOTE)) | (c == _SPACE) | (prev == _SPACE))
    cut[offs[:-1][offs[1:] > offs[:-1]]] = True
    return np.flatnonzero(cut)


class Memory:
    """What `make` gives for each distinct piece, numbered; forgets all when more than `most` pieces are held."""

    def __init__(self, make: Callable[[list[str]], list], most: int):
        self.make, self.most, self.number, self.values = make, most, {}, []

    def numbers(self, data: np.ndarray, s: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
        """(number of each distinct piece, index of the piece at each place) for the pieces that start at s and end at the next start."""
        if len(self.values) > self.most:
            self.number.clear()
            self.values.clear()
        low = ASCII_LOWER[data] if lower else data
        e = np.append(s[1:], len(data))
        uniq, at, inverse = np.unique(hash_spans(low, s, e), return_index=True, return_inverse=True)
        keys, known = uniq.tolist(), self.number
        new = [i for i, k in enumerate(keys) if k not in known]
        if new:
            raw = low.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(s[at[new]].tolist(), e[at[new]].tolist(), strict=True)]
            n = len(self.values)
            self.values.extend(self.make(texts))
            known.update(zip((keys[i] for i in new), range(n, n + len(new)), strict=True))
        return np.fromiter((known[k] for k in keys), np.int64, len(keys)), inverse


def runs(mask: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """(first, end, value) of equal neighbours."""
    edges = np.flatnonzero(np.diff(mask)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(mask)], strict=True):
        if b > a:
            yield a, b, bool(mask[a])

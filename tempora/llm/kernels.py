"""Vectorised text kernels for use inside tasks: words, their hashes and their n-grams, over Arrow batches.

A kernel sees the UTF-8 bytes of a few documents at once (about ``SLICE`` bytes, at least one
document).  A word is ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; its hash is a random byte
code times the powers of an odd base, summed modulo 2^64 and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE = 1 << 18  # with some ten 8-byte numbers for each byte, a slice takes about 20 MB
_BASE = 0x9E3779B97F4A7C13  # odd, and 3 modulo 8, so that powers differ early
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of a public hash)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_BYTE = np.arange(256)
BLANK = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
_CODE = mixed(np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(_U) + _U(0x51ED270B))
_EXACT_CODE = mixed(_BYTE.astype(_U) + _U(0x51ED270B))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_powers["up"]) < n:
        n = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, _U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


class Words(NamedTuple):
    """The words of a slice of documents, in order."""

    data: np.ndarray  # the slice's bytes
    bounds: np.ndarray  # of documents: document d has the bytes bounds[d]:bounds[d + 1]
    doc: np.ndarray  # of words: the document
    start: np.ndarray  # of words: first byte
    end: np.ndarray  # of words: one past the last byte
    hash: np.ndarray  # of words

    def first(self) -> np.ndarray:
        """Document d has the words first[d]:first[d + 1]."""
        return np.searchsorted(self.doc, np.arange(len(self.bounds)))


def sums_of(data: np.ndarray, exact: bool = False) -> np.ndarray:
    """Running sums that give the hash of any byte range; A-Z count as lower-case unless ``exact``."""
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((_EXACT_CODE if exact else _CODE)[data] * _power(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def hashes_of(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, alike for equal ranges wherever they stand."""
    return mixed((sums[end] - sums[start]) * _power(len(sums))[1][start] + (end - start).astype(_U))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return hashes_of(sums_of(data), start, end)


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first byte, one past the last byte) of all words."""
    solid = ~BLANK[data]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
    opens[inner] = solid[inner]
    closes[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return np.searchsorted(bounds, start, "right") - 1, start, end


def words_of(data: np.ndarray, bounds: np.ndarray) -> Words:
    doc, start, end = word_spans(data, bounds)
    return Words(data, bounds, doc, start, end, span_hash(data, start, end))


def place_factors(n: int) -> np.ndarray:
    """Unrelated odd factors for the places of a sequence, so that its order counts."""
    return mixed(np.arange(1, n + 1, dtype=_U)) | _U(1)


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within a document, and the first word of each."""
    if len(words.hash) < n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    many = len(words.hash) - n + 1
    total = np.zeros(many, _U)
    for k, factor in enumerate(place_factors(n)):
        total += words.hash[k : many + k] * factor
    at = np.flatnonzero(words.doc[:many] == words.doc[n - 1 :])
    return mixed(total[at]), at


def text_slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, one past the last, bytes, bounds) of slices of about ``size`` bytes; null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def binary_rows(parts: list[np.ndarray]) -> pa.Array:
    """An Arrow array of the arrays' bytes."""
    return pa.array([x.tobytes() for x in parts], pa.binary())


def in_bits(words: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash's leading ``bits`` bits is set in a table of 64-bit words."""
    place = (hashes >> _U(64 - bits)).astype(np.int64)
    return (words[place >> 6] >> (place & 63).astype(_U)) & _U(1) == 1

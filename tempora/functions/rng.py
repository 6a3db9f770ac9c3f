"""Keyed randomness: a draw depends on its key only, never on partitions, order or retries."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: MD5's constants, shifts of a round, the word that each step reads, and the state that it starts from.
_SINES = [int(abs(np.sin(i + 1.0)) * 2**32) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_WORDS = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Keys hashed side by side, so that their words stay in the processor's cache, and keys under which each is hashed by itself.
TILE, FEW = 16_384, 1024


def draw(*key: Column | str | int) -> Column:
    """A number from 0 to 2^32 - 1: the first eight hexadecimal digits of the MD5 of the key's parts joined by ``|``."""
    parts = [F.lit(k) if isinstance(k, (int, str)) else k for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def sign(*key: Column | str | int) -> Column:
    """1 or -1."""
    return F.when(draw(*key) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def md5_words(starts: list[bytes], ends: list[bytes]) -> np.ndarray:
    """(start, end): the draws of the keys start + end, by MD5 over many keys at once; keys of over 55 bytes, and a few keys, one by one."""
    out = np.empty((len(starts), len(ends)), np.uint32)
    rows, columns = _by_length(starts), _by_length(ends)
    for long, i in rows.items():
        for more, j in columns.items():
            if long + more > 55 or len(i) * len(j) < FEW:
                for r in i.tolist():
                    got = b"".join([hashlib.md5(starts[r] + ends[c]).digest()[:4] for c in j.tolist()])
                    out[r, j] = np.frombuffer(got, ">u4")
                continue
            left = np.frombuffer(b"".join([starts[r] for r in i.tolist()]), np.uint8).reshape(len(i), long)
            right = np.frombuffer(b"".join([ends[c] for c in j.tolist()]), np.uint8).reshape(len(j), more)
            wide = min(len(j), TILE)
            tall = max(1, TILE // wide)
            for c in range(0, len(j), wide):
                tail = _words(right[c : c + wide], long, more)
                for r in range(0, len(i), tall):
                    head = _words(left[r : r + tall], 0, long, end=False)
                    found = _hashed(head, tail, 8 * (long + more))
                    out[np.ix_(i[r : r + tall], j[c : c + wide])] = found
    return out


def _by_length(texts: list[bytes]) -> dict[int, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    return {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}


def _words(text: np.ndarray, at: int, size: int, end: bool = True) -> dict[int, np.ndarray]:
    """The little-endian words, by place, that ``text`` (key, byte) takes part in when it stands at byte ``at``, with the mark behind its end."""
    first, last = at // 4, (at + size + end + 3) // 4
    padded = np.zeros((len(text), 4 * (last - first)), np.uint8)
    padded[:, at - 4 * first : at - 4 * first + size] = text
    if end:
        padded[:, at - 4 * first + size] = 0x80
    words = padded.view("<u4")
    return {first + k: words[:, k] for k in range(last - first)}


def _hashed(head: dict[int, np.ndarray], tail: dict[int, np.ndarray], bits: int) -> np.ndarray:
    """The first four bytes of the MD5 of each head with each tail, as a big-endian number."""
    tall, wide = (len(next(iter(w.values()), ())) for w in (head, tail))
    tall = tall or 1
    message: list[int | np.ndarray] = [0] * 16
    message[14] = bits
    for k in {*head, *tail}:
        both = np.zeros((tall, wide), np.uint32)
        if k in head:
            both |= head[k][:, None]
        if k in tail:
            both |= tail[k][None]
        message[k] = both.ravel()
    a, b, c, d = (np.full(tall * wide, v, np.uint32) for v in _STATE)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(61):  # the last three steps don't reach the first word
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        a += f
        word = message[_WORDS[i]]
        if isinstance(word, int):
            a += np.uint32((_SINES[i] + word) & 0xFFFFFFFF)
        else:
            a += word
            a += np.uint32(_SINES[i])
        turn = _TURNS[kind][i % 4]
        np.left_shift(a, np.uint32(turn), out=t)
        a >>= np.uint32(32 - turn)
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    b += np.uint32(_STATE[0])
    return b.byteswap().reshape(tall, wide)

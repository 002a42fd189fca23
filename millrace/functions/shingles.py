"""MD5 of all word shingles of many texts at once, in numpy: for Arrow batches inside tasks."""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: Bytes of a word: ASCII digits and small letters.
_WORD = np.isin(np.arange(256), [*b"0123456789abcdefghijklmnopqrstuvwxyz"])
#: The constants of MD5 (RFC 1321): what is added, how far it turns and which word is taken in each of 64 steps.
_ADDED = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_TAKEN = [(a * i + b) % 16 for a, b in ((1, 0), (5, 1), (3, 5), (7, 0)) for i in range(16)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: Bytes of a message that fits one block, and messages that are hashed at once.
_MOST, _ONCE = 55, 1 << 14
#: For each length of a message: which bytes of its block are its own, and what follows them.
_OWN = (np.arange(64) < np.arange(_MOST + 1)[:, None]).astype(np.uint8) * 255
_REST = (np.arange(64) == np.arange(_MOST + 1)[:, None]).astype(np.uint8) * 128
_REST[:, 56] = np.arange(_MOST + 1) * 8 % 256
_REST[:, 57] = np.arange(_MOST + 1) * 8 // 256


def _md5(words: np.ndarray) -> np.ndarray:
    """The first 60 bits of the MD5 of messages of one block each; words: 16 rows of uint32, a column for each message."""
    a, b, c, d = (np.full(words.shape[1], x) for x in _START)
    f, turned = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += words[_TAKEN[i]]
        f += _ADDED[i]
        np.left_shift(f, np.uint32(_TURNS[i]), out=turned)
        f >>= np.uint32(32 - _TURNS[i])
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += _START[0]
    b += _START[1]
    return a.byteswap().astype(np.uint64) << np.uint64(28) | b.byteswap().astype(np.uint64) >> np.uint64(4)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(60 bits of the MD5 of each run of k words, joined by spaces; how many runs each text has), text after text.

    data: bytes of lower-cased texts, of which the n-th stands from offsets[n] to offsets[n + 1].
    """
    word = _WORD[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = word[edges]
    begin = np.flatnonzero(first)
    if len(begin) < k:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = np.flatnonzero(word)
    size = np.diff(np.append(np.flatnonzero(first[inside]), len(inside)))
    end = np.cumsum(size + 1) - 1
    plain = np.full(end[-1] + 64, 32, np.uint8)  # the words, one space between
    plain[np.arange(len(inside)) + np.repeat(np.arange(len(size)), size)] = data[inside]
    doc = np.searchsorted(offsets, begin, "right") - 1
    i = np.flatnonzero(doc[: 1 - k] == doc[k - 1 :])
    at = end[i] - size[i]
    n = end[i + k - 1] - at
    out = np.empty(len(i), np.uint64)
    blocks = np.lib.stride_tricks.sliding_window_view(plain, 64)
    for lo in range(0, len(i), _ONCE):
        m = np.minimum(n[lo : lo + _ONCE], _MOST)
        block = blocks[at[lo : lo + _ONCE]] & _OWN[m] | _REST[m]
        out[lo : lo + _ONCE] = _md5(np.ascontiguousarray(block.view("<u4").T))
    for j in np.flatnonzero(n > _MOST).tolist():
        out[j] = int.from_bytes(hashlib.md5(plain[at[j] : at[j] + n[j]].tobytes(), usedforsecurity=False).digest()[:8]) >> 4
    return out, np.bincount(doc[i], minlength=len(offsets) - 1)

"""Vectorised tokenisation of whole Arrow text columns.

Every function works on the bytes of many documents at once, so no Python code runs per
word.  Words are known by 64-bit fingerprints; a window of words by a fingerprint that is
folded from those of its halves.  Memory is a few bytes for each byte of text plus some
eight-byte arrays per word, whatever the length of a single document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20_240_917)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15 // 8 * 8 + 5)
_CHUNK = 1 << 19
_LEFT, _RIGHT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)

#: White space of the contracts: space and tab to carriage return.
SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters (after lower-casing), digits and every byte of a longer code point.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def _powers(base: int) -> np.ndarray:
    p = np.full(_CHUNK + 1, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_tables: dict[str, np.ndarray] = {}


def _power(kind: str) -> np.ndarray:
    if kind not in _tables:
        _tables[kind] = _powers(int(_STEP) if kind == "up" else _inverse(int(_STEP)))
    return _tables[kind]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * _LEFT
    x ^= x >> np.uint64(29)
    x *= _RIGHT
    x ^= x >> np.uint64(32)
    return x


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint of a sequence from those of its two parts, in order."""
    x = a * _LEFT
    x ^= x >> np.uint64(31)
    x += b
    x *= _RIGHT
    x ^= x >> np.uint64(30)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.cast(pa.large_binary()).fill_null(b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]), at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text (a longer row stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = flat(batch.column(text))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


class Words:
    """The words of a column of texts.

    starts, ends: byte places of each word; first: for each text the index of its first
    word, with the total at the end; hashes: a fingerprint of each word.
    """

    def __init__(self, column: pa.Array, letters: np.ndarray = SPACES, lower: bool = False, kinds: np.ndarray | None = None):
        """kinds: a class for each byte; words are also cut where a 1 meets a 2."""
        raw, self.offsets = flat(column)
        self.raw = raw
        self.bytes = buf = _LOWER[raw] if lower else raw
        inside = letters[buf]
        edge = self.offsets[(self.offsets > 0) & (self.offsets < len(buf))]
        begins, stops = inside.copy(), inside.copy()
        if len(buf):
            begins[1:] &= ~inside[:-1]
            begins[edge] = inside[edge]
            stops[:-1] &= ~inside[1:]
            stops[edge - 1] = inside[edge - 1]
        if kinds is not None and len(buf):
            k = kinds[buf]
            cut = k[1:] * k[:-1] == 2
            begins[1:] |= cut
            stops[:-1] |= cut
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self._hashes: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """The text that each word stands in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = self._hash()
        return self._hashes

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        up, down = _power("up"), _power("down")
        k = 0
        while k < len(out):
            base = int(self.starts[k])
            to = max(k + 1, int(np.searchsorted(self.ends, base + _CHUNK, "right")))
            if self.ends[to - 1] - base > _CHUNK:
                out[k] = self._long(base, int(self.ends[k]))
                k += 1
                continue
            chunk = _BYTE[self.bytes[base : self.ends[to - 1]]]
            sums = np.zeros(len(chunk) + 1, np.uint64)
            chunk *= up[: len(chunk)]
            np.cumsum(chunk, out=sums[1:])
            s, e = self.starts[k:to] - base, self.ends[k:to] - base
            out[k:to] = (sums[e] - sums[s]) * down[s]
            k = to
        return mix(out)

    def _long(self, start: int, end: int) -> np.uint64:
        up, total, scale = _power("up"), 0, 1
        for at in range(start, end, _CHUNK):
            part = self.bytes[at : min(end, at + _CHUNK)]
            total = (total + scale * int((_BYTE[part] * up[: len(part)]).sum(dtype=np.uint64))) % (1 << 64)
            scale = scale * int(up[len(part)]) % (1 << 64)
        return np.uint64(total)

    def word(self, k: int) -> bytes:
        return self.bytes[self.starts[k] : self.ends[k]].tobytes()

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of the k words from each place on, and whether they are of one text."""
        return window_hashes(self.hashes, k), self.whole(k)

    def whole(self, k: int) -> np.ndarray:
        ok = np.zeros(len(self), bool)
        if len(self):
            last = np.repeat(self.first[1:], self.counts)
            ok = np.arange(len(self)) + k <= last
        return ok


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Same length as the input; places with fewer than k words after them hold noise."""
    out, have, power, size, rest = None, 0, hashes, 1, k
    while rest:
        if rest & 1:
            out, have = (power.copy(), size) if out is None else (join_hash(_ahead(power, 0), _ahead(out, size)), have + size)
        rest >>= 1
        if rest:
            power = join_hash(power, _ahead(power, size))
            size *= 2
    return mix(out ^ np.uint64(k))


def _ahead(x: np.ndarray, k: int) -> np.ndarray:
    if not k:
        return x
    out = np.zeros_like(x)
    if k < len(x):
        out[:-k] = x[k:]
    return out

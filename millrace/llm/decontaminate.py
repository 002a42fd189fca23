"""Operator 6: benchmark passages in documents, by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows (n consecutive words; a shorter item is one window).  For
each pattern length there is one table:

- a shift table over hashed blocks of two words: how far the search may move on when a block
  ends at this place, the whole window where the block is in no pattern;
- buckets of patterns by the fingerprint of their last block, looked up where the shift is 0;
- a direct comparison of all words with the pattern's.

All stretches of a batch of texts move in step, each by its own shift, so skipping costs no
Python loop per word.  The tables of up to `most_bytes` of benchmark text are broadcast (some seven
bytes for each byte of text); a larger benchmark is searched in parts of that size, one scan each.

Defined cases: null and empty texts have no words; items without words match nothing; repeated
items and repeated item ids count once; null item ids are left out; an empty benchmark leaves
every document clean; an empty table gives an empty result; other columns are carried or ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import words as W

_LANE = 512


class Table:
    """Wu-Manber tables for the distinct patterns of one length: places in one array of all items' words.

    words: fingerprints of the items' words; place: where each pattern begins; m: words of a pattern;
    owner, owner_first: the items of each pattern, one after another.
    """

    def __init__(self, words: np.ndarray, place: np.ndarray, m: int, owner: np.ndarray, owner_first: np.ndarray):
        self.words, self.place, self.m, self.block = words, place.astype(np.int32), m, min(2, m)
        self.owner, self.owner_first = owner, owner_first.astype(np.int32)
        blocks = self._blocks(words, None) if self.block == 1 else np.r_[self._blocks(words[:-1], words[1:]), np.zeros(1, np.uint64)]
        # two slots for each distinct block; a shift takes one byte, or four for windows of more words
        self.mask = np.uint64((1 << max(12, math.ceil(math.log2(2 * max(1, len(np.unique(blocks))))))) - 1)
        self.shift = np.full(int(self.mask) + 1, m - self.block + 1, np.uint8 if m < 256 else np.int32)
        for j in range(m - self.block + 1):
            np.minimum.at(self.shift, (blocks[place + j] & self.mask).astype(np.int64), self.shift.dtype.type(m - self.block - j))
        last = blocks[place + m - self.block]
        order = np.argsort(last, kind="stable")
        self.suffix, self.order = last[order], order.astype(np.int32)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.words, self.place, self.owner, self.owner_first, self.shift, self.suffix, self.order))

    def owners(self, pattern: int) -> list[int]:
        return self.owner[self.owner_first[pattern] : self.owner_first[pattern + 1]].tolist()

    @staticmethod
    def _blocks(a: np.ndarray, b: np.ndarray | None) -> np.ndarray:
        return W.mix(a) if b is None else W.join_hash(a, b)

    def search(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, pattern) of each occurrence in texts whose words start at `first`."""
        m = self.m
        starts, ends = first[:-1], first[1:] - m + 1
        some = ends > starts
        starts, ends = starts[some], ends[some]
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lanes = -(-(ends - starts) // _LANE)
        step = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(starts, lanes) + step * _LANE
        to = np.minimum(at + _LANE, np.repeat(ends, lanes))
        block = self._blocks(hashes, None) if self.block == 1 else np.r_[self._blocks(hashes[:-1], hashes[1:]), np.zeros(1, np.uint64)]
        jump = self.shift[(block & self.mask).astype(np.int64)]
        tail, hits = m - self.block, []
        while len(at):
            move = jump[at + tail].astype(np.int64)
            stop = move == 0
            if stop.any():
                hits.append(at[stop])
            at = at + np.maximum(move, 1)
            on = at < to
            at, to = at[on], to[on]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.concatenate(hits)
        lo = np.searchsorted(self.suffix, block[at + tail], "left")
        hi = np.searchsorted(self.suffix, block[at + tail], "right")
        found_at, found = [], []
        while True:
            on = lo < hi
            at, lo, hi = at[on], lo[on], hi[on]
            if not len(at):
                break
            pattern = self.order[lo]
            same = np.ones(len(at), bool)
            for j in range(m):
                live = np.flatnonzero(same)
                same[live] = hashes[at[live] + j] == self.words[self.place[pattern[live]] + j]
            found_at.append(at[same])
            found.append(pattern[same])
            lo = lo + 1
        return (np.concatenate(found_at), np.concatenate(found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _distinct(words: np.ndarray, place: np.ndarray, m: int) -> np.ndarray:
    """For each window the number of the first of those with the same words: grouped by a fingerprint, then compared word by word."""
    mark = W.window_hashes(words, m)[place]
    order = np.argsort(mark, kind="stable")
    new = np.r_[True, mark[order[1:]] != mark[order[:-1]]] if len(order) else np.zeros(0, bool)
    del mark
    order, first = order.astype(np.int32), np.empty(len(place), np.int32)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new, dtype=np.int32) - 1]
    del order, new
    for j in range(m):
        other = words[place + j] != words[place[first] + j]
        first[other] = np.flatnonzero(other)  # a clash of fingerprints: a pattern of its own
    return first


def build(items: list[tuple[int, str]], n: int) -> list[Table]:
    """One table for each length of pattern that the items give."""
    w = W.Words(pa.array([t or "" for _, t in items], pa.string()), W.ALNUM, lower=True)
    words, size, start, ids = w.hashes, np.diff(w.first), w.first, np.array([i for i, _ in items], np.int64)
    del w
    tables = []
    for m in np.unique(np.minimum(size, n)[size > 0]).tolist():
        own = np.flatnonzero(np.minimum(size, n) == m)
        many = size[own] - m + 1
        at = (np.repeat(start[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())).astype(np.int32)
        first = _distinct(words, at, m)
        pattern = np.flatnonzero(first == np.arange(len(first))).astype(np.int32)
        number = np.searchsorted(pattern, first).astype(np.int32)
        del first
        item = np.repeat(own.astype(np.int32), many)  # by its place in ids
        order = np.lexsort((ids[item], number))
        number, item = number[order], item[order]
        once = np.r_[True, (number[1:] != number[:-1]) | (ids[item[1:]] != ids[item[:-1]])]
        number, owner = number[once], ids[item[once]]
        del order, item, once
        tables.append(Table(words, at[pattern], m, owner, np.r_[0, np.cumsum(np.bincount(number, minlength=len(pattern)))]))
    return tables


def hits(texts: pa.Array, tables: list[Table]):
    """For each text: number of words, the hit stretches of words [start, end), the items that occur."""
    w = W.Words(texts, W.ALNUM, lower=True)
    edge, item_of = np.zeros(len(w) + 1, np.int32), {}
    doc = w.doc
    for t in tables:
        at, pattern = t.search(w.hashes, w.first)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + t.m, -1)
        if len(at):
            for d, p in np.unique(np.stack([doc[at], pattern], 1), axis=0).tolist():
                item_of.setdefault(d, set()).update(t.owners(p))
    covered = np.cumsum(edge[:-1]) > 0
    for d in range(len(w.first) - 1):
        spans: list[int] = []
        if d in item_of:
            c = np.r_[False, covered[w.first[d] : w.first[d + 1]], False]
            spans = np.flatnonzero(c[1:] != c[:-1]).tolist()
        yield int(w.counts[d]), spans, sorted(item_of.get(d, ()))


def _merged(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for s, e in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _scan(tables):
    def run(batches):
        for batch in W.pieces(batches, "text"):
            n, spans, items = [], [], []
            for k, (x, s, i) in enumerate(hits(batch.column("text"), tables.value)):
                if "spans" in batch.schema.names:
                    s = _merged(s, batch.column("spans")[k].as_py())
                    i = sorted({*i, *batch.column("items")[k].as_py()})
                n.append(x)
                spans.append(s)
                items.append(i)
            names = [c for c in batch.schema.names if c not in ("n_words", "spans", "items")]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.int64()))], names=[*names, "n_words", "spans", "items"])

    return run


def find_contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int = 10, carry: list[str] | None = None, most_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, text, n_words, spans, items): benchmark windows in each document.

    spans: starts and ends, in words, of the hit stretches, in turn.  items: ids of the benchmark
    items with an occurring window.  carry: other columns to bring along, as a struct `carry`.
    """
    from millrace.llm.shared import Scratch

    rest = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carry")] if carry else []
    state = docs.select("doc_id", "text", *rest)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text").cast("long")).alias("b")).first()["b"] or 0
    parts = max(1, math.ceil(size / most_bytes))
    scratch = Scratch(spark, "decontaminate")
    for part in range(parts):
        # a part holds about most_bytes of text, whatever the benchmark's size
        own = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()]
        tables = spark.sparkContext.broadcast(build(own, n))
        ddl = ", ".join(f"{c} {t}" for c, t in state.dtypes if c in ("doc_id", "text", "carry"))
        state = state.mapInArrow(_scan(tables), f"{ddl}, n_words long, spans array<long>, items array<long>")
        if part + 1 < parts:
            state = scratch.table(state)
    return state

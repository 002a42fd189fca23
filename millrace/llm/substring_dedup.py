"""Operator 9: removal of repeated passages, found by recompression.

Recompression names a text's symbols in rounds: first every maximal run of one symbol, then
every pair of a left and a right symbol, becomes one new symbol.  A name is a fingerprint of the
names that it replaces and the left-or-right division is a bit of the name, so all tasks give the
same name to the same run or pair with nothing exchanged between them, and equal passages get
equal symbols inside, away from their ends.  Along with each symbol goes the stretch of words on
which its name and its cut depend.

1. Name: each window (k consecutive words) elects, among the symbols whose stretch lies inside
   it, the one of least fingerprint: its anchor.  Equal windows elect equal anchors.  A window
   with no such symbol is its own anchor.  Only anchors are shuffled, about one for six words.
2. Share: anchors that occur once in the corpus end there.  The names of the others go back to
   the blocks of documents that hold them.
3. Verify: windows under shared anchors are compared exactly, as 64-bit fingerprints of their
   words under the same anchor.  The first by (doc_id, start) stays, later ones are repeats.
   Each block compares its own windows first, so a passage that stands everywhere is sent on
   once a block.
4. Every word that a repeat covers is taken out.

Defined cases: null, empty and blank texts have no words and stay as empty texts; texts with
fewer than k words never change; rows that repeat a doc_id are one document of which no row
counts as earlier than its like at the same start; a null doc_id sorts after all others; an
empty table gives an empty result; other columns may be carried through under any name.
"""

from __future__ import annotations

import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.shared import Scratch, as_text

_NO_ID = (1 << 63) - 1
_SIDE = 0xC2B2AE3D27D4EB4F
_ROUNDS = 3
#: Words in a block of documents, whose windows are compared before any shuffle.
BLOCK_WORDS = 1_500_000


def recompress(names: np.ndarray, first: np.ndarray, rounds: int = _ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after some rounds, with the words [lo, hi) on which each depends.

    first: for each text the index of its first word, with the total at the end.  A symbol that
    depends on its text's end reaches one word beyond it, so no window holds it.
    """
    n = len(names)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    name, lo, hi = names, np.arange(n), np.arange(1, n + 1)
    for r in range(rounds):
        # runs
        if not len(name):
            break
        new = np.r_[True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])]
        at = np.flatnonzero(new)
        last = np.r_[at[1:], len(name)] - 1
        length = (last - at + 1).astype(np.uint64)
        lo, hi = _reach(lo, hi, at, last, doc, first)
        name = np.where(length > 1, W.join_hash(name[at], W.mix(length)), name[at])
        doc = doc[at]
        # pairs
        left = (W.mix(name ^ np.uint64(_SIDE * (2 * r + 1) % (1 << 64))) & np.uint64(1)).astype(bool)
        here = np.r_[doc[1:] == doc[:-1], False]
        pair = np.r_[left[:-1] & ~left[1:], False] & here
        second = np.r_[False, pair[:-1]]
        wide_lo, wide_hi = _reach(lo, hi, np.arange(len(name)), np.arange(len(name)), doc, first)
        after = np.r_[name[1:], np.zeros(1, np.uint64)]
        hi_after = np.r_[hi[1:], np.zeros(1, np.int64)]
        lo = np.where(left, lo, wide_lo)
        hi = np.where(pair, hi_after, np.where(left, wide_hi, hi))
        name = np.where(pair, W.join_hash(name, W.mix(after)), name)
        keep = ~second
        name, lo, hi, doc = name[keep], lo[keep], hi[keep], doc[keep]
    return name, lo, hi


def _reach(lo, hi, at, last, doc, first):
    """The dependence of symbols at..last widened by the symbol on either side."""
    n = len(lo)
    has_before = (at > 0) & (doc[at - 1] == doc[at])
    nxt = np.minimum(last + 1, n - 1)
    has_after = (last + 1 < n) & (doc[nxt] == doc[at])
    return np.where(has_before, lo[at - 1], first[doc[at]] - 1), np.where(has_after, hi[nxt], first[doc[at] + 1] + 1)


def anchors(w: W.Words, k: int, rounds: int = _ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, fingerprint, anchor, occurrence) of every window of k words.

    occurrence numbers the anchor's place: equal for windows that share one occurrence.
    """
    whole, ok = w.windows(k)
    start = np.flatnonzero(ok)
    window = whole[start]
    name, lo, hi = recompress(w.hashes, w.first, rounds)
    if not len(start):
        return start, window, window, start
    key = W.mix(name ^ _RANK)
    a, b = np.searchsorted(lo, start, "left"), np.searchsorted(hi, start + k, "right")
    size = b - a
    best = np.full(len(start), -1)
    index, width = np.arange(len(key)), 1
    while True:
        here = (size >= width) & (size < 2 * width)
        if here.any():
            x, y = index[a[here]], index[b[here] - width]
            best[here] = np.where(key[y] < key[x], y, x)
        if not (size >= 2 * width).any():
            break
        x, y = index[:-width], index[width:]
        index, width = np.where(key[y] < key[x], y, x), 2 * width
    none = best < 0
    anchor = np.where(none, W.mix(window ^ _OWN), key[best])
    return start, window, anchor, np.where(none, len(key) + start, best)


_RANK, _OWN = np.uint64(0x1D8E4E27C47D124F), np.uint64(0x94D049BB133111EB)


def _bits(count: float) -> int:
    """Bits of buckets so that each holds about 500,000 of so many entries."""
    return max(0, min(20, math.ceil(math.log2(max(1.0, count / 500_000)))))


def _split(anchor: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and the next 32 bits."""
    if not bits:
        return np.zeros(len(anchor), np.int64), (anchor >> np.uint64(32)).astype(np.uint32)
    return (anchor >> np.uint64(64 - bits)).astype(np.int64), (anchor << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)


def _name(k: int, bits: int, flush: int = 400_000):
    """(bucket, block, names, twice) of the anchors of a task's documents."""

    def rows(held):
        block, anchor, twice = (np.concatenate([x[j] for x in held]) for j in range(3))
        bucket, low = _split(anchor, bits)
        order = np.lexsort((low, block, bucket))
        bucket, block, low, twice = bucket[order], block[order], low[order], twice[order]
        new = np.r_[True, (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1]) | (low[1:] != low[:-1])]
        at = np.flatnonzero(new)
        twice = np.maximum(np.add.reduceat(twice, at), np.diff(np.r_[at, len(new)]) > 1) > 0
        bucket, block, low = bucket[at], block[at], low[at]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[cut[1:], len(bucket)]
        parts = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary())
        return pa.record_batch([pa.array(bucket[cut], pa.int32()), parts(block.astype(np.uint32)), parts(low), parts(twice)], names=["bucket", "block", "low", "twice"])

    def run(batches):
        held, many = [], 0
        for batch in W.pieces(batches, "text", 1 << 20):
            w = W.Words(batch.column("text"))
            start, _, anchor, seen = anchors(w, k)
            if not len(start):
                continue
            fresh = np.r_[True, (seen[1:] != seen[:-1])]
            block = np.repeat(batch.column("block").to_numpy().astype(np.int64), w.counts)[start][fresh]
            anchor, seen = anchor[fresh], seen[fresh]
            _, once = np.unique(seen, return_index=True)
            block, anchor = block[once], anchor[once]
            held.append((block, anchor, np.zeros(len(block), np.int64)))
            many += len(block)
            if many >= flush:
                yield rows(held)
                held, many = [], 0
        if held:
            yield rows(held)

    return run


def _share(table: pa.Table) -> pa.Table:
    """Of a bucket's anchors those that occur twice or more, for each block that holds one."""
    bucket = table.column("bucket")[0].as_py()
    block, low = (np.concatenate([np.frombuffer(x, np.uint32) for x in table.column(c).to_pylist()]) for c in ("block", "low"))
    twice = np.concatenate([np.frombuffer(x, bool) for x in table.column("twice").to_pylist()])
    order = np.lexsort((block, low))
    block, low, twice = block[order], low[order], twice[order]
    at = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    size = np.diff(np.r_[at, len(low)])
    shared = np.repeat((size > 1) | np.logical_or.reduceat(twice, at), size)
    block, low = block[shared], low[shared]
    order = np.lexsort((low, block))
    block, low = block[order], low[order]
    new = np.r_[True, (block[1:] != block[:-1]) | (low[1:] != low[:-1])] if len(block) else np.zeros(0, bool)
    block, low = block[new], low[new]
    cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, int)
    ends = np.r_[cut[1:], len(block)][: len(cut)]
    return pa.table([pa.array(block[cut], pa.int64()), pa.array(np.full(len(cut), bucket), pa.int32()), pa.array([low[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary())], names=["block", "bucket", "low"])


def _unpack(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts, document numbers and text fingerprints of a block."""
    import zstandard

    d = zstandard.ZstdDecompressor()
    raw = [d.decompress(z) for z in table.column("z").to_pylist()]
    ids = table.column("id").to_numpy() if table.num_rows else np.zeros(0, np.int64)
    marks = table.column("mark").to_numpy().astype(np.int64) if table.num_rows else np.zeros(0, np.int64)
    return pa.array(raw, pa.large_binary()), ids, marks


def _slices(raw: pa.Array, most: int = 1 << 20):
    _, at = W.flat(raw)
    lo = 0
    while lo < len(raw):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


_WINDOWS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("low", pa.binary()), ("id", pa.binary()), ("mark", pa.binary()), ("start", pa.binary()), ("size", pa.binary()), ("hashes", pa.binary())])
_WINDOWS_DDL = "kind int, bucket int, block long, low binary, id binary, mark binary, start binary, size binary, hashes binary"
_COLUMNS = (("low", np.uint32), ("id", np.int64), ("mark", np.int32), ("start", np.uint32), ("size", np.uint16))


def _runs(low, block, ident, mark, start, window=None):
    """Consecutive windows of one document under one anchor (and block) as runs."""
    if not len(start):
        return np.zeros(0, int), np.zeros(0, int)
    new = np.r_[True, (ident[1:] != ident[:-1]) | (mark[1:] != mark[:-1]) | (start[1:] != start[:-1] + 1) | (low[1:] != low[:-1]) | (block[1:] != block[:-1])]
    at = np.flatnonzero(new)
    at = np.unique(np.concatenate([at, *(at + j for j in range(60_000, int(np.diff(np.r_[at, len(start)]).max()), 60_000))]))
    new = np.zeros(len(start) + 1, bool)
    new[at[at < len(start)]] = True
    at = np.flatnonzero(new)
    return at, np.diff(np.r_[at, len(start)])


def _emit(kind, bucket, block, low, ident, mark, start, window) -> pa.Table:
    """Rows of packed runs, cut where bucket or block changes; kind 0: windows to compare, 1: repeats."""
    at, size = _runs(low, block if kind else bucket, ident, mark, start)
    by = (block if kind else bucket)[at]
    cut = np.flatnonzero(np.r_[True, by[1:] != by[:-1]]) if len(at) else np.zeros(0, int)
    ends = np.r_[cut[1:], len(at)][: len(cut)]
    edge = np.r_[at, len(start)]
    packed = {c: [v[at][i:j].astype(t).tobytes() for i, j in zip(cut, ends, strict=True)] for (c, t), v in zip(_COLUMNS[:4], (low, ident, mark, start), strict=True)}
    packed["size"] = [size[i:j].astype(np.uint16).tobytes() for i, j in zip(cut, ends, strict=True)]
    hashes = [b"" if kind else window[edge[i] : edge[j]].tobytes() for i, j in zip(cut, ends, strict=True)]
    return pa.table([pa.array(np.full(len(cut), kind), pa.int32()), pa.array(bucket[at][cut], pa.int32()), pa.array(block[at][cut], pa.int64()), *(pa.array(packed[c], pa.binary()) for c, _ in _COLUMNS), pa.array(hashes, pa.binary())], schema=_WINDOWS)


def _firsts(low, window, ident, mark, start):
    """Order that puts equal windows together, and which of them repeat an earlier one or stand at the first's place."""
    order = np.lexsort((mark, start, ident, low, window))
    w, l, i, s = window[order], low[order], ident[order], start[order]
    at = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (l[1:] != l[:-1])]) if len(w) else np.zeros(0, int)
    lead = np.repeat(at, np.diff(np.r_[at, len(w)]))
    later = (i != i[lead]) | (s != s[lead])
    return order, later


def _compare(k: int, bits: int):
    """For a block of documents: its windows under shared anchors, the local repeats among them set apart."""

    def run(key: tuple, docs: pa.Table, names: pa.Table) -> pa.Table:
        if not docs.num_rows or not names.num_rows:
            return _WINDOWS.empty_table()
        block = key[0].as_py()
        shared = np.unique(np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) + (b << 32) for b, x in zip(names.column("bucket").to_pylist(), names.column("low").to_pylist(), strict=True)]))
        raw, ids, marks = _unpack(docs)
        by = np.lexsort((marks, ids))
        raw, ids, marks = raw.take(pa.array(by)), ids[by], marks[by]
        held = []
        for lo, hi in _slices(raw):
            w = W.Words(raw.slice(lo, hi - lo))
            start, window, anchor, _ = anchors(w, k)
            bucket, low = _split(anchor, bits)
            full = low.astype(np.int64) + (bucket << 32)
            ok = shared[np.minimum(np.searchsorted(shared, full), len(shared) - 1)] == full
            start = start[ok]
            doc = w.doc[start]
            held.append((bucket[ok].astype(np.int32), low[ok], window[ok], (lo + doc).astype(np.int32), (start - w.first[doc]).astype(np.int32)))
        bucket, low, window, doc, start = (np.concatenate([x[j] for x in held]) for j in range(5))
        held.clear()
        # rows stand in the order of id, mark and start, and a stable sort keeps it among equal windows
        order = np.lexsort((low, window))
        w_, l_ = window[order], low[order]
        at = np.flatnonzero(np.r_[True, (w_[1:] != w_[:-1]) | (l_[1:] != l_[:-1])]) if len(order) else np.zeros(0, int)
        lead = order[np.repeat(at, np.diff(np.r_[at, len(order)]))]
        later = (ids[doc[order]] != ids[doc[lead]]) | (start[order] != start[lead])
        del w_, l_, lead
        back, ahead = np.sort(order[later]), order[~later]
        ahead = ahead[np.lexsort((ahead, low[ahead], bucket[ahead]))]
        blocks = np.full(len(bucket), block, np.int32)
        ident, mark = ids[doc], marks[doc]
        zero = np.zeros(len(back), np.int64)
        return pa.concat_tables([
            _emit(0, bucket[ahead], blocks[ahead], low[ahead], ident[ahead], mark[ahead], start[ahead], window[ahead]),
            _emit(1, zero, blocks[back], zero, ident[back], mark[back], start[back], None),
        ])

    return run


def _runs_of(table: pa.Table):
    """Packed runs, one entry each: columns of _COLUMNS, block, and where its windows begin among all hashes."""
    joined = lambda c, t: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)])
    low, ident, mark, start, size = (joined(c, t) for c, t in _COLUMNS)
    block = np.repeat(table.column("block").to_numpy(), [len(x.as_buffer()) // 4 for x in table.column("low")])
    size = size.astype(np.int64)
    return low, ident, mark, start, size, block, np.cumsum(size) - size, joined("hashes", np.uint64)


def _settle(last: bool, most: int = 250_000):
    """For a bucket (or a part of one): equal windows of different blocks; all but the first are repeats.

    Windows of one anchor are looked at together, and of as many anchors at a time as make `most` windows, so a bucket
    is never held unpacked.
    """

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        low, ident, mark, start, size, block, begin, hashes = _runs_of(table)
        by = np.argsort(low, kind="stable")
        weight = np.cumsum(size[by])
        new = np.r_[np.flatnonzero(np.r_[True, low[by][1:] != low[by][:-1]]), len(by)]
        out, at = [_WINDOWS.empty_table()], 0
        while at < len(new) - 1:
            before = weight[new[at] - 1] if new[at] else 0
            to = max(at + 1, int(np.searchsorted(weight[new[1:] - 1], before + most, "right")))
            out.extend(settle(by[new[at] : new[to]], bucket, low, ident, mark, start, size, block, begin, hashes))
            at = to
        return pa.concat_tables(out)

    def settle(runs, bucket, low, ident, mark, start, size, block, begin, hashes):
        many = size[runs]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        window = hashes[np.repeat(begin[runs], many) + step]
        start = np.repeat(start[runs].astype(np.int64), many) + step
        low, ident, mark, block = (np.repeat(x[runs].astype(np.int64), many) for x in (low, ident, mark, block))
        order, later = _firsts(low, window, ident, mark, start)
        back = order[later]
        back = back[np.lexsort((start[back], mark[back], ident[back], block[back]))]
        zero = np.zeros(len(back), np.int64)
        yield _emit(1, zero, block[back], zero, ident[back], mark[back], start[back], None)
        if not last:
            ahead = order[~later]
            ahead = ahead[np.lexsort((start[ahead], mark[ahead], ident[ahead], low[ahead], block[ahead]))]
            for b in np.unique(block[ahead]):
                x = ahead[block[ahead] == b]
                yield _emit(0, np.full(len(x), bucket), block[x], low[x], ident[x], mark[x], start[x], window[x])

    return run


def _cut(k: int):
    """For a block of documents: the texts without the words that repeats cover."""

    def run(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        raw, ids, marks = _unpack(docs)
        got = [np.concatenate([np.frombuffer(x, t) for x in repeats.column(c).to_pylist()] or [np.zeros(0, t)]).astype(np.int64) for c, t in _COLUMNS[1:]]
        order = np.lexsort((got[2], got[1], got[0]))
        ident, mark, start, size = (x[order] for x in got)
        keys = np.stack([ident, mark], 1)
        at = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else np.zeros(0, int)
        where = {(int(ident[i]), int(mark[i])): (i, j) for i, j in zip(at, np.r_[at[1:], len(keys)][: len(at)], strict=True)}
        kept, total, gone = [], [], []
        for text, i, m in zip(raw, ids.tolist(), marks.tolist(), strict=True):
            words = text.as_py().split()
            total.append(len(words))
            if (i, m) in where:
                lo, hi = where[i, m]
                delta = np.zeros(len(words) + 1, np.int32)
                np.add.at(delta, start[lo:hi], 1)
                np.add.at(delta, start[lo:hi] + size[lo:hi] + k - 1, -1)
                keep = np.cumsum(delta[:-1]) == 0
                words = list(compress(words, keep.tolist()))
            gone.append(total[-1] - len(words))
            kept.append(b" ".join(words))
        none = pa.array(ids == _NO_ID)
        doc_id = pa.array(ids, pa.int64(), mask=np.asarray(none)) if len(ids) else pa.array([], pa.int64())
        return pa.table([doc_id, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), as_text(kept), *(docs.column(c).combine_chunks() for c in docs.column_names if c == "carry")], names=["doc_id", "n_words", "n_removed", "kept", *(["carry"] if "carry" in docs.column_names else [])])

    return run


def _pack(batches):
    import zstandard

    c = zstandard.ZstdCompressor(level=3)
    for batch in W.pieces(batches, "text"):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "z", pa.array([c.compress(t) for t in raw], pa.binary()))


def remove_repeats(spark: SparkSession, docs: DataFrame, k: int = 20, carry: list[str] | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text without the words of windows that also start earlier.

    kept: the words left, joined by one space.  carry: other columns to bring along, as a struct
    `carry`.
    """
    kept, scratch = Scratch(spark, "substring-dedup"), Scratch(spark, "substring-dedup-work")
    rest = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carry")] if carry else []
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()["bytes"] or 0
    guess = found / 6
    blocks = max(1, math.ceil(guess / block_words))
    bits = _bits(guess / 6)
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    rows = docs.select(ident.alias("id"), text.alias("text"), F.pmod(F.xxhash64(ident, text), F.lit(blocks)).alias("block"), F.xxhash64(text).bitwiseAND(0x7FFFFFFF).cast("int").alias("mark"), *rest)
    kind = dict(rows.dtypes)

    named = rows.select("block", "text").mapInArrow(_name(k, bits), "bucket int, block binary, low binary, twice binary")
    shared = named.groupBy("bucket").applyInArrow(_share, "block long, bucket int, low binary")
    z = rows.select("id", "block", "mark", "text").mapInArrow(_pack, "id long, block long, mark int, z binary")
    windows = scratch.table(z.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_compare(k, bits), _WINDOWS_DDL))
    repeats = [windows.where("kind = 1")]
    ahead, parts = windows.where("kind = 0"), math.ceil(blocks / 1024)
    if parts > 1:  # a passage of every block meets in two steps
        step = scratch.table(ahead.groupBy("bucket", (F.col("block") % parts).alias("part")).applyInArrow(_settle(False), _WINDOWS_DDL))
        repeats.append(step.where("kind = 1"))
        ahead = step.where("kind = 0")
    repeats.append(ahead.groupBy("bucket").applyInArrow(_settle(True), _WINDOWS_DDL))
    gone = repeats[0]
    for x in repeats[1:]:
        gone = gone.union(x)
    gone = kept.table(gone.select("block", "id", "mark", "start", "size"))
    scratch.drop()  # the result reads what is kept only
    names, out = ["id long", "block long", "mark int", "z binary"], "doc_id long, n_words long, n_removed long, kept string"
    if carry:
        names.append(f"carry {kind['carry']}")
        out += f", carry {kind['carry']}"
    z = rows.select("id", "block", "mark", "text", *(["carry"] if carry else [])).mapInArrow(_pack, ", ".join(names))
    return z.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(_cut(k), out)

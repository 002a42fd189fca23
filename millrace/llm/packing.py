"""Operator 3: packing of tokenised documents into sequences of fixed capacity.

1. Tokenise: distinct words of a batch are encoded once (words never merge across white space in
   the word-level vocabulary) and spread back over the texts, end token last.  Documents longer
   than the capacity are cut into pieces of it.
2. Plan on the histogram of piece lengths, at most `capacity` numbers, on the driver: the
   configuration linear program (fewest bins so that every length is covered) is solved by
   multiplicative weights.  Lengths not yet covered weigh more; each step prices them and finds
   the best configuration by knapsack dynamic programming.  Multiplicities are rounded down to
   what the histogram holds, fullest configurations first, and the rest is packed by best fit
   with decreasing lengths, on counts.
3. Place: each piece gets its rank among those of its length, from counts per salted part and
   a rank within the part, so no length meets in one task; the plan maps (length, rank) to a
   sequence and an offset.

Defined cases: null and empty texts are one end token; ties and repeated rows are pieces of
their own; an empty table gives an empty result; other columns are ignored; a null doc_id is kept.
"""

from __future__ import annotations

import math
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.shared import Scratch

#: ASCII letters 1, ASCII signs but the apostrophe 2, all else 0: the tokenizer always cuts where 1 meets 2.
_KINDS = np.zeros(256, np.uint8)
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KINDS[[x for x in range(0x21, 0x7F) if not chr(x).isalnum() and x != 0x27]] = 2
_GROUP = 500
#: Over 1: a long piece is worth more than short ones of the same sum, as it is harder to place.
_SLOPE = 1.05


class Encoder:
    """Token ids of whole texts, by way of their distinct words (and the signs around them).

    Holds the ids of up to `most` words between the batches of a task.
    """

    def __init__(self, path: str, most: int = 1 << 20):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.forget()

    def forget(self) -> None:
        self.known, self.at, self.ids = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _encode(self, raw: list[bytes], alone: bool) -> tuple[np.ndarray, np.ndarray]:
        """ids of words one after the other, and how many each has."""
        words = [x.decode("utf-8", "replace") for x in raw]
        if alone:
            parts = [np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, np.uint32) for x in words]
            return np.concatenate(parts), np.array([len(x) for x in parts])
        groups = [words[i : i + _GROUP] for i in range(0, len(words), _GROUP)]
        ids, sizes = [], []
        for group, e in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            start = np.cumsum([0, *(len(w) + 1 for w in group)])
            at = np.array([o[0] for o in e.offsets], np.int64)
            sizes.append(np.bincount(np.searchsorted(start, at, "right") - 1, minlength=len(group)))
            ids.append(np.array(e.ids, np.uint32))
        return np.concatenate(ids), np.concatenate(sizes)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets), each text closed by the end token."""
        special = b"<|" in W.flat(texts)[0].tobytes()  # may be tokens of their own, in their own case
        w = W.Words(texts, W.SPACES) if special else W.Words(texts, W.SPACES, lower=True, kinds=_KINDS)
        uniq, where, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
        pos = np.minimum(np.searchsorted(self.known, uniq), max(0, len(self.known) - 1))
        new = self.known[pos] != uniq if len(self.known) else np.ones(len(uniq), bool)
        if new.any():
            ids, size = self._encode([w.word(k) for k in where[new]], special)
            self._add(uniq[new], ids, size)
            pos = np.searchsorted(self.known, uniq)
        size, start = np.diff(self.at)[pos], self.at[:-1][pos]
        per_word, from_ = size[inverse], start[inverse]
        total = np.r_[0, np.cumsum(per_word)]
        docs = np.arange(len(w.first) - 1)
        out = np.full(int(total[-1]) + len(docs), end, np.uint32)
        shift = np.repeat(docs, w.counts)
        place = np.repeat(total[:-1] + shift, per_word) + _within(per_word)
        out[place] = self.ids[np.repeat(from_, per_word) + _within(per_word)]
        offsets = total[w.first] + np.arange(len(w.first))
        if len(self.known) > self.most:
            self.forget()
        return out, offsets

    def _add(self, names: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        known = np.r_[self.known, names]
        sizes = np.r_[np.diff(self.at), size]
        starts = np.r_[self.at[:-1], len(self.ids) + np.cumsum(size) - size]
        order = np.argsort(known, kind="stable")
        known, sizes, starts = known[order], sizes[order], starts[order]
        pool = np.r_[self.ids, ids]
        self.ids = pool[np.repeat(starts, sizes) + _within(sizes)] if len(pool) else pool
        self.known, self.at = known, np.r_[0, np.cumsum(sizes)]


def _within(sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, end: int, capacity: int, with_ids: bool):
    def run(batches):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread for each task
        encoder = Encoder(path)
        for batch in W.pieces(batches, "text"):
            ids, at = encoder.encode(batch.column("text"), end)
            size = np.diff(at)
            many = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), many)
            piece = _within(many)
            start = piece * capacity
            length = np.minimum(capacity, size[doc] - start)
            lo = at[doc] + start
            view = memoryview(ids.astype("<u4", copy=False)).cast("B")
            spans = list(zip((lo * 4).tolist(), ((lo + length) * 4).tolist(), strict=True))
            cols = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(view[a:b]) for a, b in spans], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)], pa.int32()), pa.array(ids, pa.int32())))
                names.append("ids")
            yield pa.record_batch(cols, names=names)

    return run


def _knapsack(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value within each capacity, and the length put in last (0: none)."""
    price = np.full(capacity + 1, -np.inf)
    price[lengths] = value
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    least = int(lengths.min())
    for c in range(least, capacity + 1):
        gain = price[least : c + 1] + best[c - least :: -1][: c - least + 1]
        k = int(gain.argmax())
        if gain[k] > best[c - 1]:
            best[c], last[c] = gain[k], least + k
        else:
            best[c] = best[c - 1]
    return best, last


def _configuration(best: np.ndarray, last: np.ndarray, capacity: int) -> dict[int, int]:
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        if last[c] == 0:
            c -= 1
            continue
        out[int(last[c])] = out.get(int(last[c]), 0) + 1
        c -= int(last[c])
    return out


def solve(histogram: dict[int, int], capacity: int, steps: int = 400, rate: float = 4.0) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a bin, number of such bins)] that hold exactly the histogram's pieces.

    Multiplicative weights on the covering program: after each step the weight of a length is
    exp(-rate * covered share), so that the knapsack prices what is least covered.
    """
    count = {k: n for k, n in histogram.items() if n > 0}
    plan: list[tuple[tuple[int, ...], int]] = []
    if full := count.pop(capacity, 0):
        plan.append(((capacity,), full))
    if not count:
        return plan
    lengths = np.array(sorted(count))
    n = np.array([count[int(k)] for k in lengths], np.float64)
    index = {int(k): i for i, k in enumerate(lengths)}
    covered, found = np.zeros(len(n)), {}
    bins = float((lengths * n).sum()) / capacity
    for step in range(steps):
        share = covered / n
        weight = np.exp(-rate * math.sqrt(1 + step) * (share - share.min()))
        best, last = _knapsack(weight * (lengths / capacity) ** _SLOPE, lengths, capacity)
        config = _configuration(best, last, capacity)
        fits = min(n[index[k]] / a for k, a in config.items())
        size = max(min(bins / steps * 2, fits), 1e-9)
        key = tuple(sorted((k for k, a in config.items() for _ in range(a)), reverse=True))
        found[key] = found.get(key, 0.0) + size
        for k, a in config.items():
            covered[index[k]] += a * size
    scale = 1 / max(1e-12, float(np.mean(covered / n)))
    left = {int(k): int(v) for k, v in zip(lengths, n, strict=True)}
    for key, x in sorted(found.items(), key=lambda kv: (capacity - sum(kv[0]), -kv[1], kv[0])):
        if sum(key) < capacity:
            continue  # a bin with room is left to the best fit below
        need = {k: key.count(k) for k in set(key)}
        times = min(int(x * scale), *(left[k] // a for k, a in need.items()))
        if times:
            plan.append((key, times))
            for k, a in need.items():
                left[k] -= times * a
    return plan + best_fit(left, capacity)


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Largest length first, then what fills its bin best; whole runs of equal bins at a time."""
    left = {k: n for k, n in left.items() if n > 0}
    plan = []
    while left:
        top, used = max(left), {}
        rest = {k: n - (k == top) for k, n in left.items() if n - (k == top) > 0}
        bin_ = [top, *_fill(rest, capacity - top)]
        for k in bin_:
            used[k] = used.get(k, 0) + 1
        times = min(left[k] // a for k, a in used.items())
        plan.append((tuple(sorted(bin_, reverse=True)), times))
        for k, a in used.items():
            left[k] -= times * a
            if not left[k]:
                del left[k]
    return plan


def _fill(rest: dict[int, int], room: int) -> list[int]:
    """Pieces that fill the room as far as can be: greedy where that is exact, else by reachable sums."""
    out, space = [], room
    for k in sorted(rest, reverse=True):
        if k > space:
            continue
        a = min(rest[k], space // k)
        out += [k] * a
        space -= a * k
    if not space:
        return out
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for k in sorted(rest, reverse=True):
        if k > room:
            continue
        copies, size = min(rest[k], room // k), 1
        while copies:  # powers of two of one length
            a = min(size, copies)
            steps.append((reach, k, a))
            reach |= (reach << (k * a)) & mask
            copies -= a
            size *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    if total <= room - space:
        return out
    out = []
    for before, k, a in reversed(steps):
        if not before >> total & 1:
            out += [k] * a
            total -= k * a
    return out


class Plan:
    """Where the pieces of each length go: by rank, the sequence and the offset."""

    def __init__(self, bins: list[tuple[tuple[int, ...], int]]):
        taken: dict[int, int] = {}
        rows, base = [], 0
        for config, times in bins:
            offset = 0
            for k in config:
                rows.append((k, taken.get(k, 0), base, offset))
                taken[k] = taken.get(k, 0) + times
                offset += k
            base += times
        rows.sort()
        self.length, self.rank, self.base, self.offset = (np.array([r[j] for r in rows], np.int64) for j in range(4))
        self.sequences = base
        self.key = (self.length << 44) + self.rank

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, (length << 44) + rank, "right") - 1
        return self.base[k] + rank - self.rank[k], self.offset[k]


def _placed(plan):
    def run(batches):
        for batch in batches:
            seq, offset = plan.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            keep = batch.select([c for c in batch.schema.names if c != "rank"])
            yield keep.append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of every piece."""
    scratch = Scratch(spark, "packing")
    ddl = _PIECES + (", ids array<int>" if with_ids else "")
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    pieces = scratch.table(docs.select(doc_id, "text").mapInArrow(_pieces(tokenizer, end, capacity, with_ids), ddl))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(Plan(solve(histogram, capacity)))
    parts = max(64, sum(histogram.values()) // 500_000)
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(inner) - 1).join(base, ["length", "part"])
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    return ranked.select(*cols, (F.col("rank") + F.col("base")).cast("long").alias("rank")).mapInArrow(_placed(plan), ddl + ", sequence_id long, offset long")

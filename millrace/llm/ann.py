"""Operator 7: nearest neighbours by inner product, by multi-index hashing.

1. Codes: on a bounded sample, vectors are centred, turned to their principal axes and rotated so
   that signs lose least (iterative quantisation), from eight random starts.  Each vector becomes
   8 * 64 bits.  One more coordinate makes all norms equal first, so inner product and angle
   order alike.
2. Index: in each block of vectors a code's two substrings are indexed apart: each occupied value
   with the vectors that have it, so copies are probed once.  By the pigeonhole principle a code within
   Hamming radius r of a query has its first substring within r // 2 of the query's or its second
   within (r - 1) // 2, so probing all occupied values that near finds every such code.
   Substrings are long since neighbours are far: where the k-th nearest has an angle of about 66 degrees,
   as among evenly spread vectors, 37 % of all bits differ, and short substrings that near are
   shared by nearly all codes.
3. Radius: from the sample, how far codes of vectors of a given inner product may lie apart.  A
   query takes its own bound into all blocks: an inner product that its k-th nearest of all rows
   exceeds almost surely, read off a sample by rank.  In a block the k-th best found replaces the
   bound if it is better.  What the radius may miss is improbable; there is no cap on candidates.
4. All codes within the radius are reranked by the exact inner product in double precision.

Every row is indexed.  Queries are broadcast in blocks of at most `most_queries`.

Defined cases: vectors that are null, zero, of other than the usual length or hold null or
non-finite components take no part; ties go to the smaller id; rows without an id take no part; a
repeated query id is searched once for each of its vectors, under its id; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURNS, PARTS = 8, 2
BITS = TURNS * 64
#: Vectors in one index.
BLOCK = 65_536
#: Rows of the sample that rotations are learned on, and that a query's bound is read off.
LEARN = 4_000


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of codes, given as words along the last axis."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


class Codes:
    """Rotations to signs, and the Hamming radius to search for a found inner product."""

    def __init__(self, sample: np.ndarray, norm: float, seed: int = 3, quantile: float = 0.97):
        rng = np.random.default_rng(seed)
        self.norm = norm
        x = self._even(sample[:LEARN])
        self.mean = x.mean(0) if len(x) else np.zeros(sample.shape[1] + 1)
        z, d = x - self.mean, x.shape[1]
        self.turn = np.concatenate([self._rotation(z, d, rng) for _ in range(TURNS)], 1)
        self.edges, self.reach = self._reach(sample, quantile)

    @staticmethod
    def _rotation(z: np.ndarray, d: int, rng: np.random.Generator) -> np.ndarray:
        if d < 64 or len(z) <= 64:
            return rng.normal(size=(d, 64))
        axes = np.linalg.eigh(z.T @ z)[1][:, ::-1][:, :64]
        v, r = z @ axes, np.linalg.qr(rng.normal(size=(64, 64)))[0]
        for _ in range(15):
            u, _, wt = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ wt).T
        return axes @ r

    def _even(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0, self.norm**2 - (x**2).sum(1)))[:, None]], 1)

    def encode(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """A row of TURNS words for each vector."""
        y = np.concatenate([x * (self.norm / np.maximum(1e-300, np.sqrt((x**2).sum(1))))[:, None], np.zeros((len(x), 1))], 1) if query else self._even(x)
        return np.packbits((y - self.mean) @ self.turn > 0, axis=1).view(np.uint64).reshape(-1, TURNS)

    def _reach(self, sample: np.ndarray, quantile: float) -> tuple[np.ndarray, np.ndarray]:
        edges = np.r_[np.linspace(-1, 0.9, 39), 1 - np.geomspace(0.1, 0.0005, 24)[1:]]
        hist = np.zeros((len(edges), BITS + 1))
        some = sample[:LEARN]
        codes = self.encode(some)
        for lo in range(0, min(800, len(some)), 50):
            q = some[lo : lo + 50]
            cos = (q / np.sqrt((q**2).sum(1))[:, None]) @ some.T / self.norm
            far = _far(self.encode(q, True)[:, None], codes[None])
            other = np.arange(lo, lo + len(q))[:, None] != np.arange(len(some))[None]
            np.add.at(hist, (np.maximum(np.searchsorted(edges, cos[other], "right") - 1, 0), far[other]), 1)
        top = np.full(len(edges), BITS, np.int64)
        for k in range(len(edges)):
            if hist[k].sum() >= 50:
                top[k] = int(np.searchsorted(np.cumsum(hist[k]), quantile * hist[k].sum()))
            else:  # too few pairs: signs of a random rotation, with a margin
                p = math.acos(max(-1.0, min(1.0, edges[k]))) / math.pi
                top[k] = min(BITS, math.ceil(BITS * p + 2.5 * math.sqrt(BITS * p * (1 - p)) + 1))
        return edges, np.maximum.accumulate(top[::-1])[::-1]

    def radius(self, score: float, length: float) -> int:
        """How far to search when the k-th best has this inner product with a query of this norm."""
        cos = score / max(1e-300, length * self.norm)
        return int(self.reach[max(0, int(np.searchsorted(self.edges, cos, "right")) - 1)])


def bounds(sample: tuple[np.ndarray, np.ndarray], ids: np.ndarray, q: np.ndarray, k: int, rows: int) -> np.ndarray:
    """For each query an inner product that its k-th nearest of all rows exceeds almost surely.

    Of `rows` rows a sample of s holds about k * s / rows of the k nearest; the value at three
    standard deviations and three ranks beyond that is taken, or none if the sample is too short.
    """
    own, x = sample[0][:LEARN], sample[1][:LEARN]
    mean = k * len(x) / max(1, rows)
    rank = math.ceil(mean + 3 * math.sqrt(mean) + 3)
    out = np.full(len(q), -np.inf)
    if len(x) > rank:
        for lo in range(0, len(q), 500):
            score = q[lo : lo + 500] @ x.T
            score[ids[lo : lo + 500, None] == own[None]] = -np.inf
            out[lo : lo + 500] = np.partition(score, len(x) - rank, axis=1)[:, len(x) - rank]
    return out


class Index:
    """Multi-index hash table of a block of codes: for each substring its occupied values and who has them."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables, self.width = codes, [], TURNS // PARTS
        for p in range(PARTS):
            part = codes[:, p * self.width : (p + 1) * self.width]
            order = np.lexsort(part.T)
            part = part[order]
            start = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]).any(1)]) if len(part) else np.zeros(0, int)
            self.tables.append((np.ascontiguousarray(part[start].T), start, np.r_[start[1:], len(codes)][: len(start)], order))

    def parts(self, code: np.ndarray) -> list[np.ndarray]:
        """Distance of the query's substrings from each occupied value."""
        out = []
        for p, (value, *_) in enumerate(self.tables):
            far = np.zeros(value.shape[1], np.uint16)
            for w in range(self.width):
                far += np.bitwise_count(value[w] ^ code[p * self.width + w])
            out.append(far)
        return out

    def within(self, far: list[np.ndarray], radius: int) -> np.ndarray:
        """Row numbers of all codes with a substring near enough, by the pigeonhole principle."""
        found = []
        for p, ((_, start, end, order), d) in enumerate(zip(self.tables, far, strict=True)):
            k = np.flatnonzero(d <= (radius - p) // PARTS)
            size = end[k] - start[k]
            found.append(order[np.repeat(start[k] - (np.cumsum(size) - size), size) + np.arange(size.sum())])
        return np.unique(np.concatenate(found))


def search(index: Index, ids: np.ndarray, x: np.ndarray, model: Codes, query_id: int, q: np.ndarray, code: np.ndarray, k: int, bound: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
    """Row numbers and inner products of the k nearest of a block, nearest first, and how many codes were retrieved."""
    far = index.parts(code)
    length = float(np.sqrt((q**2).sum()))
    widest = model.radius(bound, length) if bound > -np.inf else BITS
    # a first radius that holds some k vectors, for a bound of the block's own
    _, start, end, _ = index.tables[0]
    near = np.argsort(far[0], kind="stable")[: k + 1]
    radius = min(widest, PARTS * int(far[0][near[np.searchsorted(np.cumsum(end[near] - start[near]), k + 1).clip(max=len(near) - 1)]]))
    while True:
        got = index.within(far, radius)
        rows = got[_far(index.codes[got], code) <= radius]
        rows = rows[ids[rows] != query_id]
        score = (x[rows] * q).sum(1)  # one order of addition for all rows, so copies tie
        order = np.lexsort((ids[rows], -score))[:k]
        rows, score = rows[order], score[order]
        best = max(bound, float(score[k - 1]) if len(score) >= k else -np.inf)
        want = min(widest, model.radius(best, length) if best > -np.inf else BITS)
        if want <= radius:
            return rows, score, len(got)
        radius = want


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.asarray(batch.column("v").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def _blocks(model, queries, k: int, width: int):
    def run(batches):
        ids_q, q, codes, bound = queries.value
        held, many = [], 0

        def found():
            ids, x = (np.concatenate([h[j] for h in held]) for j in range(2))
            index = Index(model.value.encode(x))
            out = []
            for i in range(len(ids_q)):
                rows, score, _ = search(index, ids, x, model.value, int(ids_q[i]), q[i], codes[i], k, bound[i])
                out.append((np.full(len(rows), ids_q[i]), ids[rows], score))
            yield pa.record_batch([pa.array(np.concatenate([o[j] for o in out]) if out else [], t) for j, t in enumerate(_FOUND.types)], schema=_FOUND)

        for batch in batches:
            held.append((batch.column("vec_id").to_numpy(), _vectors(batch, width)))
            many += batch.num_rows
            if many >= BLOCK:
                yield from found()
                held, many = [], 0
        if many:
            yield from found()

    return run


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda a: a != 0)


def nearest(spark: SparkSession, vectors: DataFrame, k: int = 20, every: int = 20, sample: int = 20_000, most_queries: int = 65_536) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row whose id is divisible by `every`."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, a: s + a * a))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("norm")).orderBy(F.desc("n"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    d, n, longest = sizes[0]["d"], sizes[0]["n"], sizes[0]["norm"]
    rows = rows.where(F.size("v") == d)
    share = max(1, math.ceil(1_000_000 * min(1.0, sample / n)))
    # by hash: `sample` rows in the mean
    few = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < share).orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(2 * sample).collect()
    few = np.array([r["vec_id"] for r in few], np.int64), np.array([r["v"] for r in few], np.float64).reshape(-1, d)
    model = Codes(few[1], longest)
    shared = spark.sparkContext.broadcast(model)
    asked = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, math.ceil(asked.count() / most_queries * 1.2))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // BLOCK)
    dealt = rows.repartition(parts, F.xxhash64("vec_id"))
    found = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).distinct().orderBy("vec_id").collect()  # about most_queries rows
        ids = np.array([r["vec_id"] for r in own], np.int64)
        q = np.array([r["v"] for r in own], np.float64).reshape(-1, d)
        queries = spark.sparkContext.broadcast((ids, q, model.encode(q, True), bounds(few, ids, q, k, n)))
        part = dealt.mapInArrow(_blocks(shared, queries, k, d), "query_id long, vec_id long, score double")
        found = part if found is None else found.union(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

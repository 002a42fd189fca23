"""Operator 4: Jaccard self-join of documents on word n-grams, by rare-first prefix filtering.

1. One scan makes each document's set of distinct n-gram fingerprints and folds it to a class
   (two fingerprints): documents of one class have the same set and stand for each other from
   there on.  A class is known by its first fingerprint, or both joined where the first is not
   its own.  The scan also adds up an n-gram frequency sketch: `sketch` counters in all, whatever
   the corpus.  Any total order of n-grams gives a right prefix filter, so colliding counters
   cost time only.
2. A second scan orders each set rare first and emits its prefix (n - ceil(t*n) + 1 n-grams):
   fingerprint, class, set size, position.  Prefixes are dealt by fingerprint in packed
   blocks; n-grams that the sketch knows to be hot are salted, so a list never meets in one task
   whole.
3. Lists with two classes or more stay.  First each list's neighbours by set size are paired; those
   pairs pass the length, positional, bitmap and suffix filters and are verified on whole texts;
   the links are closed to components.  Lists within one component end there.  The others pair
   their neighbours of different components once more, in some other orders that are the same
   for all lists, and dealt by new salts.  Then all remaining
   pairs of different components in a list are tried, large lists in pairs of blocks.  So a
   group of m near copies costs about m verifications, not m * m, and no link between different
   components is missed.
4. Each pair is verified once, on the exact sets of the whole texts, in cells of pairs that
   share their texts: a cell unpacks a text once, however many of its pairs hold it.

Defined cases: null, empty and blank texts have no n-grams, n_shingles 0, and stand alone; a
text with fewer than n words has one n-gram, its whole word sequence; equal texts, ties and
repeated rows share a class; an empty table gives an empty result; other columns are ignored.
Each row of a repeated doc_id keeps its own text, set and class; a null doc_id is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.shared import Scratch, add_chunks, components, scan

_CHUNK = 1 << 13
#: Pairs of entries that are held at once while a list is searched.
_BLOCK = 2000


def shingle_sets(texts: pa.Array, n: int):
    """For each text its sorted distinct n-gram fingerprints."""
    w = W.Words(texts, W.SPACES, lower=True)
    whole, ok = w.windows(n)
    first = w.first
    short = {k: W.window_hashes(w.hashes, k) for k in {int(c) for c in np.unique(w.counts) if 0 < c < n}}
    for d in range(len(first) - 1):
        lo, hi = first[d], first[d + 1]
        if hi - lo >= n:
            yield np.unique(whole[lo : hi - n + 1])
        elif hi > lo:
            yield short[hi - lo][lo : lo + 1]
        else:
            yield whole[:0]


def need(n, other, percent: int):
    """The least intersection of sets of these sizes that reaches percent / 100 of the union."""
    return -(-percent * (n + other) // (100 + percent))


def _class_id(u: np.ndarray) -> tuple[int, int]:
    one, two = W.mix(u).sum(dtype=np.uint64), W.mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(np.uint64(one).astype(np.int64)), int(np.uint64(two).astype(np.int64))


def node_of(key: tuple[int, int], clash: frozenset[int], turn: int) -> int:
    """A class's id: its first fingerprint, with the second mixed in if the first is in `clash`."""
    one, two = key
    return int(np.int64(one) ^ (np.int64(two) << np.int64(turn))) if one in clash else one


def parities(u: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's fingerprints falls in each of 256 slots, as four words.

    The bitmap filter: where parities differ, so do the sets, by a fingerprint at least.
    """
    odd = np.bincount(((u >> np.uint64(8)) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _classes(n: int, sketch: int):
    def run(batches):
        from pyspark import TaskContext

        counts, seen, shift = np.zeros(sketch, np.int64), set(), np.uint64(64 - (sketch.bit_length() - 1))
        for batch in W.pieces(batches, "text"):
            size, c1, c2, low, odd, parts, fresh = [], [], [], [], [], [], []
            for u in shingle_sets(batch.column("text"), n):
                k = _class_id(u)
                size.append(len(u))
                c1.append(k[0])
                c2.append(k[1])
                low.append(int(u[0] >> np.uint64(1)) if len(u) else 0)
                odd.append(parities(u))
                parts.append(partition_counts(u).tobytes())
                if len(u) and k not in seen:
                    seen.add(k)
                    fresh.append(u)
            if fresh:
                counts += np.bincount((np.concatenate(fresh) >> shift).astype(np.int64), minlength=sketch)
            m = batch.num_rows
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    *(pa.array(x, pa.int64()) for x in (size, c1, c2, low, *np.array(odd).reshape(-1, 4).T)),
                    pa.array(parts, pa.binary()),
                    *(pa.nulls(m, t) for t in (pa.int32(), pa.int32(), pa.bool_(), pa.binary())),
                ],
                names=_CLASS_NAMES,
            )
        if counts.any():
            slot = TaskContext.get().partitionId()
            chunks = [(c, counts[c * _CHUNK : (c + 1) * _CHUNK]) for c in range(math.ceil(sketch / _CHUNK))]
            chunks = [(c, x) for c, x in chunks if x.any()]
            k = len(chunks)
            yield pa.record_batch(
                [
                    *(pa.nulls(k, pa.int64()) for _ in range(9)),
                    pa.nulls(k, pa.binary()),
                    pa.array([slot] * k, pa.int32()),
                    pa.array([c for c, _ in chunks], pa.int32()),
                    pa.array([False] * k),
                    pa.array([x.tobytes() for _, x in chunks], pa.binary()),
                ],
                names=_CLASS_NAMES,
            )

    return run


_ODD = ("s0", "s1", "s2", "s3")
_CLASS_NAMES = ["doc_id", "n", "c1", "c2", "low", *_ODD, "parts", "slot", "chunk", "real", "data"]
_CLASS_DDL = "doc_id long, n long, c1 long, c2 long, low long, s0 long, s1 long, s2 long, s3 long, parts binary, slot int, chunk int, real boolean, data binary"
_ENTRY_DDL = "bucket int, salt int, h binary, node binary, n binary, pos binary"
_ENTRIES = pa.schema([("bucket", pa.int32()), ("salt", pa.int32()), ("h", pa.binary()), ("node", pa.binary()), ("n", pa.binary()), ("pos", pa.binary())])


def partition_counts(u: np.ndarray) -> np.ndarray:
    """How many of a set's fingerprints fall in each of 2^k equal ranges, k fixed by the set's size.

    The suffix filter: sets share at most the sum of the lesser counts.  Sets of other sizes
    are compared at the coarser of their divisions.
    """
    k = max(0, min(12, int(len(u)).bit_length() - 2))
    if not len(u):
        return np.zeros(1, np.uint16)
    return np.minimum(np.bincount((u >> np.uint64(64 - k)).astype(np.int64) if k else np.zeros(len(u), np.int64), minlength=1 << k), 65535).astype(np.uint16)


def overlap_bound(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(b, np.uint16).astype(np.int64)
    if x.max(initial=0) >= 65535 or y.max(initial=0) >= 65535:
        return 1 << 60
    k = min(len(x), len(y))
    return int(np.minimum(x.reshape(k, -1).sum(1), y.reshape(k, -1).sum(1)).sum())


def _prefixes(n: int, percent: int, counts, bits: int, hot: int, clash: frozenset[int], turn: int, flush: int = 400_000):
    """Packed blocks of prefix entries by (bucket, salt): the first `bits` bits of an n-gram, the 32 after them."""

    def rows(held: list[tuple]):
        h, node, size, pos = (np.concatenate([x[k] for x in held]) for k in range(4))
        low = (h << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        k = _salts(low.astype(np.int64) + (bucket << 32), bits, counts.value, hot)
        salt = np.where(k > 1, 1 + (node.astype(np.uint64) % k.astype(np.uint64)).astype(np.int64), 0)
        order = np.lexsort((low, salt, bucket))
        bucket, salt, low, node, size, pos = (x[order] for x in (bucket, salt, low, node, size, pos))
        cut = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (salt[1:] != salt[:-1])]) if len(h) else np.zeros(0, int)
        ends = np.r_[cut[1:], len(h)]
        packed = (pa.array([x[lo:hi].tobytes() for lo, hi in zip(cut, ends, strict=True)], pa.binary()) for x in (low, node, size.astype(np.uint32), pos.astype(np.uint32)))
        yield pa.record_batch([pa.array(bucket[cut], pa.int32()), pa.array(salt[cut], pa.int32()), *packed], schema=_ENTRIES)

    def run(batches):
        seen: set[int] = set()
        held, many = [], 0
        shift = np.uint64(64 - (len(counts.value).bit_length() - 1))
        for batch in W.pieces(batches, "text"):
            for u in shingle_sets(batch.column("text"), n):
                if not len(u):
                    continue
                node = node_of(_class_id(u), clash, turn)
                if node in seen:
                    continue
                seen.add(node)
                size = len(u)
                k = size - -(-percent * size // 100) + 1
                rare = np.argsort(counts.value[(u >> shift).astype(np.int64)], kind="stable")[:k]
                held.append((u[rare], np.full(k, node, np.int64), np.full(k, size, np.int64), np.arange(k)))
                many += k
            if many >= flush:
                yield from rows(held)
                held, many = [], 0
        if held:
            yield from rows(held)

    return run


def _salts(key: np.ndarray, bits: int, counts: np.ndarray, hot: int) -> np.ndarray:
    """In how many parts the list of each n-gram (its first bits + 32 bits) is dealt, by the sketch."""
    slot = key >> (bits + 32 - (len(counts).bit_length() - 1))
    return np.maximum(1, counts[slot] // hot)


_LIST_DDL = "h long, k int, node long, n int, pos int, a long, b long"
_LISTS = pa.schema([("h", pa.int64()), ("k", pa.int32()), ("node", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def _passes(na, nb, pa_, pb, percent):
    """Length and positional filters, for arrays of pairs that share an n-gram at these places."""
    lo, hi = np.minimum(na, nb), np.maximum(na, nb)
    return (100 * lo >= percent * hi) & (1 + np.minimum(na - pa_ - 1, nb - pb - 1) >= need(na, nb, percent))


def _alike(a: np.ndarray, b: np.ndarray, na, nb, percent: int) -> np.ndarray:
    """The bitmap filter: sets whose parities differ in few enough slots.  (numpy counts the bits of a signed number's magnitude.)"""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(-1, dtype=np.int64) <= na + nb - 2 * need(na, nb, percent)


def _neighbours(h, k, node, n, pos, comp, percent: int, orders: list[int | None], odd: np.ndarray | None = None) -> pa.Table:
    """Of these lists' entries those in lists of two components or more, and pairs of neighbours.

    orders: None by set size, a number by a hash of the class under this number, so that two
    classes that meet in many lists are mostly paired in all of them or in none.  A list that is
    dealt in k > 1 parts stays, since its other parts may hold other components.
    """
    pairs = []
    for seed in orders:
        rank = n if seed is None else W.mix(node.astype(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
        order = np.lexsort((node, rank, h))
        x, y = order[:-1], order[1:]
        ok = (h[x] == h[y]) & (comp[x] != comp[y]) & _passes(n[x], n[y], pos[x], pos[y], percent)
        x, y = x[ok], y[ok]
        if odd is not None:
            ok = _alike(odd[x], odd[y], n[x], n[y], percent)
            x, y = x[ok], y[ok]
        x, y = node[x], node[y]
        pairs.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
    pairs = np.unique(np.concatenate(pairs), axis=0)
    order = np.lexsort((node, h))
    h, k, node, n, pos, comp = (x[order] for x in (h, k, node, n, pos, comp))
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, int)
    mixed = np.minimum.reduceat(comp, at) < np.maximum.reduceat(comp, at) if len(h) else np.zeros(0, bool)
    keep = np.repeat(mixed, np.diff(np.r_[at, len(h)])) | (k > 1)
    e, m = int(keep.sum()), len(pairs)
    entry = [pa.concat_arrays([pa.array(v[keep], f.type), pa.nulls(m, f.type)]) for v, f in zip((h, k, node, n, pos), _LISTS, strict=False)]
    return pa.table([*entry, *(pa.concat_arrays([pa.nulls(e, pa.int64()), pa.array(pairs[:, c], pa.int64())]) for c in (0, 1))], schema=_LISTS)


def _lists(percent: int, counts, bits: int, hot: int):
    """The first lists, from the packed blocks of a bucket (or a part of its hot n-grams)."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        kinds = (("h", np.uint32), ("node", np.int64), ("n", np.uint32), ("pos", np.uint32))
        h, node, n, pos = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]).astype(np.int64) for c, t in kinds)
        order = np.lexsort((pos, node, h))
        h, node, n, pos = h[order], node[order], n[order], pos[order]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (node[1:] != node[:-1])]
        h, node, n, pos = h[fresh] + (bucket << 32), node[fresh], n[fresh], pos[fresh]
        return _neighbours(h, _salts(h, bits, counts.value, hot), node, n, pos, node, percent, [None])

    return run


def _odd(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in _ODD], 1)


def _again(percent: int, orders: list[int]):
    def run(table: pa.Table) -> pa.Table:
        h, k, node, n, pos, comp = (table.column(c).to_numpy() for c in ("h", "k", "node", "n", "pos", "comp"))
        return _neighbours(h, k, node, n, pos, comp, percent, orders, _odd(table))

    return run


def _cross(percent: int, most: int = 1 << 18):
    """All pairs of different components in each list of a group; block pairs meet across blocks only.

    Pairs are looked at `most` at a time.
    """

    def run(table: pa.Table) -> pa.Table:
        h, node, n, pos, comp, side = (table.column(c).to_numpy() for c in ("h", "node", "n", "pos", "comp", "side"))
        order = np.lexsort((node, n, h))
        h, node, n, pos, comp, side, odd = (x[order] for x in (h, node, n, pos, comp, side, _odd(table)))
        # from each entry to the last of its list that is not too large
        at = np.cumsum(np.r_[False, h[1:] != h[:-1]]) << 40
        many = np.searchsorted(at + n, at + 100 * n // percent, "right") - np.arange(len(h)) - 1
        total, found, lo = np.cumsum(many), [], 0
        while lo < len(h):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] - many[lo] + most, "right")))
            x = np.repeat(np.arange(lo, hi), many[lo:hi])
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(many[lo:hi]) - many[lo:hi], many[lo:hi])
            ok = (comp[x] != comp[y]) & ((side[x] != side[y]) | (side[x] == 0))
            x, y = x[ok], y[ok]
            ok = _passes(n[x], n[y], pos[x], pos[y], percent)
            x, y = x[ok], y[ok]
            ok = _alike(odd[x], odd[y], n[x], n[y], percent)
            x, y = node[x[ok]], node[y[ok]]
            found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0))
            lo = hi
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])

    return run


def _suffix(percent: int):
    """Pairs that pass the suffix filter."""

    def run(batches):
        for batch in batches:
            na, nb = batch.column("na").to_pylist(), batch.column("nb").to_pylist()
            ok = [overlap_bound(x, y) >= need(p, q, percent) for x, y, p, q in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), na, nb, strict=True)]
            yield batch.select(["a", "b", "la", "lb", "na", "nb"]).filter(pa.array(ok, pa.bool_()))

    return run


def pack_texts(batches):
    import zstandard

    c = zstandard.ZstdCompressor(level=3)
    for batch in W.pieces(batches, "text"):
        z = [c.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), pa.array(z, pa.binary())], names=["doc_id", "z"])


def _verify(n: int, percent: int, clash: frozenset[int], turn: int):
    """For a cell: its pairs that link, by the exact sets of its texts."""

    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        import zstandard

        d, sets = zstandard.ZstdDecompressor(), {}
        nodes, packed = texts.column("node").to_pylist(), texts.column("z").to_pylist()
        lo = 0
        while lo < len(nodes):
            held, size, hi = [], 0, lo
            while hi < len(nodes) and (size < 1 << 20 or not held):
                held.append(d.decompress(packed[hi]))
                size, hi = size + len(held[-1]), hi + 1
            for node, u in zip(nodes[lo:hi], shingle_sets(pa.array(held, pa.large_binary()), n), strict=True):
                if node not in sets and node_of(_class_id(u), clash, turn) == node:  # else another text of the same doc_id
                    sets[node] = u
            lo = hi
        a, b = (pairs.column(c).to_numpy() for c in ("a", "b"))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        edge = np.r_[np.flatnonzero(np.r_[True, a[1:] != a[:-1]]), len(a)] if len(a) else np.zeros(1, int)
        ok = np.zeros(len(a), bool)
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            lead = sets[int(a[lo])]
            while lo < hi:  # about a million fingerprints at a time
                size = np.cumsum([len(sets[x]) for x in b[lo:hi].tolist()])
                to = lo + max(1, int(np.searchsorted(size, 1 << 20, "right")))
                others = [sets[x] for x in b[lo:to].tolist()]
                flat = np.concatenate(others)
                hit = lead[np.minimum(np.searchsorted(lead, flat), len(lead) - 1)] == flat
                many = np.array([len(x) for x in others])
                both = np.add.reduceat(hit, np.cumsum(many) - many, dtype=np.int64)
                ok[lo:to] = 100 * both >= percent * (len(lead) + many - both)
                lo = to
        return pa.table([pa.array(a[ok], pa.int64()), pa.array(b[ok], pa.int64())], names=["a", "b"])

    return run


def jaccard_classes(
    spark: SparkSession,
    docs: DataFrame,
    n: int = 5,
    percent: int = 75,
    sketch: int = 1 << 19,
    hot: int = 4096,
    orders: int = 3,
    cell: int = 1 << 22,
    pairs_at_once: int = 10_000,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document; see the module's head.

    percent: two sets link when 100 * intersection >= percent * union.  sketch: counters of the
    frequency sketch (a power of two, eight bytes each, broadcast).  hot: entries of one n-gram
    that share a task.  orders: in how many orders neighbours are paired the second time.  cell: n-grams of
    the texts that a verifying task holds, about.  pairs_at_once: pairs that it compares, about.
    """
    kept, scratch = Scratch(spark, "ngram-join"), Scratch(spark, "ngram-join-work")
    texts = scan(docs, doc_id="doc_id", text="text").where("doc_id is not null")
    first = kept.table(texts.mapInArrow(_classes(n, sketch), _CLASS_DDL))
    # as many rows as sketch / _CHUNK: a fixed number of counters
    counts = np.zeros(sketch, np.int64)
    for row in add_chunks(first.where("chunk is not null").select("slot", "chunk", "real", "data")).toLocalIterator():
        counts[row["chunk"] * _CHUNK : (row["chunk"] + 1) * _CHUNK] = np.frombuffer(row["data"], np.int64)
    total = int(counts.sum())
    shared = spark.sparkContext.broadcast(counts)
    hot_at = max(hot, 4 * total // sketch)
    entries = max(1, total * (100 - percent) // 100)
    bits = max(0, min(20, math.ceil(math.log2(max(1, entries / 400_000)))))

    rows = first.where("doc_id is not null").select("doc_id", "n", "c1", "c2", "low", *_ODD, "parts")
    clash, turn = frozenset(), 0
    while True:
        node = F.when(F.col("c1").isin(list(clash)), F.col("c1").bitwiseXOR(F.shiftleft("c2", turn))).otherwise(F.col("c1")) if clash else F.col("c1")
        same = (F.min("c2") == F.max("c2")) & (F.min("c1") == F.max("c1"))
        nodes = rows.where("n > 0").groupBy(node.alias("node")).agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in ("low", *_ODD)), F.first("parts").alias("parts"), same.alias("same"), F.min("c1").alias("c1"), F.max("c1").alias("d1"))
        nodes = kept.table(nodes)
        # of 10^11 documents a few hundred are to be expected, so they may be listed
        new = {x for row in nodes.where("not same").select("c1", "d1").toLocalIterator() for x in row}
        if not new:
            break
        clash, turn = clash | new, turn + bool(clash)
    rows = rows.select("doc_id", "n", node.alias("node"))
    nodes = nodes.select("node", "rep", "n", "low", *_ODD, "parts")

    def linked(pairs: DataFrame, packed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of pairs of classes (a, b): those tried and those that link.

        A cell is a pair of buckets of least fingerprints, which alike sets mostly share, so a text goes to few
        cells.  A cell whose texts weigh more than `cell`, or whose pairs are more than `pairs_at_once`, is cut to a grid.
        """
        side = lambda s, **cols: nodes.select(F.col("node").alias(s), *(F.col(c).alias(f"{x}{s}") for x, c in cols.items()))
        first = dict(l="low", n="n", **{c: c for c in _ODD})
        tried = pairs.distinct().join(side("a", **first), "a").join(side("b", **first), "b")
        least = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / (100 + percent))
        differ = sum((F.bit_count(F.col(f"{c}a").bitwiseXOR(F.col(f"{c}b"))) for c in _ODD), F.lit(0))
        tried = tried.where(differ <= F.col("na") + F.col("nb") - 2 * least).select("a", "b", "la", "lb", "na", "nb")
        tried = tried.join(side("a", x="parts"), "a").join(side("b", x="parts"), "b").select("a", "b", "la", "lb", "na", "nb", "xa", "xb")
        tried = scratch.table(tried.mapInArrow(_suffix(percent), "a long, b long, la long, lb long, na long, nb long"))
        grid = max(64, math.ceil((tried.agg(F.sum(F.col("na") + F.col("nb")).alias("size")).first()["size"] or 0) / cell / 64))
        place = lambda c: F.pmod(F.xxhash64(c), F.lit(grid))
        tried = tried.withColumn("i", place("la")).withColumn("j", place("lb"))

        def ends(rows: DataFrame, *keys: str) -> DataFrame:
            return rows.select(*keys, F.col("a").alias("node"), F.col("na").alias("n")).union(rows.select(*keys, F.col("b").alias("node"), F.col("nb").alias("n"))).distinct()

        weight = ends(tried, "i", "j").select("i", "j", "n", F.lit(0).alias("m")).union(tried.select("i", "j", F.lit(0), F.lit(1)))
        grain = F.greatest(2 * F.sum("n") / cell, F.sqrt(F.sum("m") / pairs_at_once))
        heavy = weight.groupBy("i", "j").agg(F.ceil(grain).alias("k")).where("k > 1")
        cut = tried.join(scratch.table(heavy), ["i", "j"], "left").withColumn("k", F.coalesce("k", F.lit(1)))
        cut = cut.withColumn("p", F.pmod(F.xxhash64("a"), "k")).withColumn("q", F.pmod(F.xxhash64("b"), "k"))
        keys = ["i", "j", "p", "q"]
        held = ends(cut, *keys).join(packed, "node").select(*keys, "node", "z").toDF("hi", "hj", "hp", "hq", "node", "z")
        found = cut.groupBy(*keys).cogroup(held.groupBy("hi", "hj", "hp", "hq")).applyInArrow(_verify(n, percent, clash, turn), "a long, b long")
        return tried.select("a", "b"), scratch.table(found)

    def split(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        return found.where("a is null").select("h", "k", "node", "n", "pos"), found.where("a is not null").select("a", "b")

    def mixed(members: DataFrame, comps: DataFrame) -> DataFrame:
        return members.join(comps, "node", "left").join(nodes.select("node", *_ODD), "node").withColumn("comp", F.coalesce("component", "node"))

    packed = texts.mapInArrow(_prefixes(n, percent, shared, bits, hot_at, clash, turn), _ENTRY_DDL)
    members, near = split(scratch.table(packed.groupBy("bucket", "salt").applyInArrow(_lists(percent, shared, bits, hot_at), _LIST_DDL)))
    # the parts of a hot list: their smallest members meet the smallest of all
    who = F.struct("n", "node", "pos")
    part = F.pmod("node", "k")
    parts = members.where("k > 1").groupBy("h", part.alias("part")).agg(F.min(who).alias("x"))
    tops = parts.groupBy("h").agg(F.min("x").alias("y"))
    spread = parts.join(tops, "h").where(f"x.node != y.node and 100 * y.n >= {percent} * x.n").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    # the texts of all classes that may be tried from here on, by class
    reps = members.select("node").distinct().join(nodes, "node").select("node", F.col("rep").alias("doc_id"))
    z = texts.mapInArrow(pack_texts, "doc_id long, z binary").join(reps.hint("merge"), "doc_id")
    z = scratch.table(z.groupBy("node", F.xxhash64("z").alias("x")).agg(F.first("z").alias("z")).select("node", "z"))
    done, links = linked(near.union(spread.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), z)

    comps = components(links, scratch)
    group = F.when(F.col("k") == 1, F.shiftright("h", 32)).otherwise(F.xxhash64("h", F.pmod(F.xxhash64("node", F.lit(1)), "k")))
    again = mixed(members, comps).withColumn("g", group).select("g", "h", "k", "node", "n", "pos", "comp", *_ODD)
    members, near = split(scratch.table(again.groupBy("g").applyInArrow(_again(percent, list(range(orders))), _LIST_DDL)))
    near = near.join(done, ["a", "b"], "left_anti")
    tried, new = linked(near, z)
    done, links = done.union(tried), links.union(new)

    comps = components(links, scratch)
    members = mixed(members, comps)
    many = members.groupBy("h").agg(F.count("*").alias("many"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    rest = members.join(many, "h").withColumn("k", F.ceil(F.col("many") / _BLOCK).cast("int"))
    rest = rest.withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    side = F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2)
    group = F.when(F.col("many") < 200, F.shiftright("h", 27)).otherwise(F.col("h"))
    block = F.when(F.col("k") == 1, -1).otherwise(F.least("i", "j"))
    rest = rest.select("h", "node", "n", "pos", "comp", *_ODD, side.alias("side"), group.alias("g"), block.alias("i"), F.greatest("i", "j").alias("j"))
    more = rest.groupBy("g", "i", "j").applyInArrow(_cross(percent), "a long, b long").join(done, ["a", "b"], "left_anti")
    _, late = linked(more, z)

    comps = components(links.union(late), scratch).join(nodes.select("node", "rep"), "node")
    best = comps.groupBy("component").agg(F.min("rep").alias("best"))
    comps = kept.table(comps.join(best, "component").select("node", "best"))
    scratch.drop()  # the result reads what is kept only
    found = rows.join(nodes.select("node", "rep"), "node", "left").join(comps, "node", "left")
    alone = F.when(F.col("n") > 0, F.coalesce("best", "rep")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))

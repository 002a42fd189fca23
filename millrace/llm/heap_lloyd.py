"""Codes of vectors by Lloyd's iteration with heaps of bounds, on whole numbers.

Every part position of the vectors has its own codebook.  A part keeps one number, its slack: a lower
bound of its distance to every other entry minus an upper bound of the distance to its own.  Each
packed block of vectors holds one min-heap of slacks for every part position and entry.  When entries
move, the slack of a part shrinks by at most its entry's move plus the largest move of another; those
drifts add up in one counter per entry, so no slack is touched.  A round pops exactly the parts whose
slack the counter has passed (in a heap they hang together at the top), compares them with all
entries again, and pushes them into the heap of the entry found.  All other parts keep their entry,
ties included: a tie has no slack and is popped.

A round is one narrow pass that reads the blocks' table and writes the next one in the shared folder;
what comes back is the change of the sums of moved parts, added up as decimals.  The driver holds
the codebooks, their sums and the counters only.

Distances are exact integers (in doubles while those hold them, else in longs); slacks are rounded
down and counters up, so a wrong bound costs a comparison, never an entry.

Cases: rows whose vector is null or holds null, NaN or infinity are dropped; an empty table gives no
rows; a codebook has as many entries as there are rows, at most `entries`; null ids come last when
the first entries are chosen, repeated ids by their vectors; repeated rows stay; null labels are one
label.  Vectors of unlike length, or of a length that `parts` does not divide, raise ValueError, as
does a component beyond LARGEST / scale.  Columns besides the three are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.shared import Scratch, finite, one_width, scan

#: Vectors of a packed block.
BLOCK_ROWS = 16_384
#: Largest component: squares of differences, added up over a vector of 1,000 components, fit a long.
LARGEST = 1 << 25
#: Relative rounding that bounds are given.
LOOSE = 1e-9


class Books(NamedTuple):
    """entries: part, entry, place -> integer; counters: part, entry -> drift so far, rounded up."""

    entries: np.ndarray
    counters: np.ndarray

    def moved_to(self, after: np.ndarray) -> Books:
        """The books with other entries, and counters advanced by what the moves can cost a slack."""
        moves = np.sqrt(((after - self.entries).astype(np.float64) ** 2).sum(2)) * (1 + LOOSE)
        cost = moves.copy()
        for p in range(len(moves)):
            for j in range(moves.shape[1]):
                cost[p, j] += max(np.delete(moves[p], j), default=0.0)
        return Books(after, self.counters + cost * (1 + LOOSE))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For parts x (rows) the nearest entry, ties to the lower index, and the slack, rounded down."""
    if len(x) and max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) < 1 << 22 and x.shape[1] <= 64:
        a, b = x.astype(np.float64), entries.astype(np.float64)  # all sums below 2^53: exact
        far = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    else:
        far = ((x[:, None, :].astype(np.int64) - entries[None]) ** 2).sum(2)
    own = far.argmin(1)
    near = np.sqrt(far[np.arange(len(x)), own])
    if far.shape[1] == 1:
        return own, np.full(len(x), np.inf)
    far[np.arange(len(x)), own] = far.max(initial=0)
    other = np.sqrt(far.min(1))
    return own, other - near - LOOSE * (other + near + 1)


class Heap:
    """A min-heap of slacks in an array, with the vector that each belongs to; many are popped and pushed at once."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray, made: bool = True):
        self.keys, self.rows = keys, rows
        if not made:
            order = np.argsort(keys, kind="stable")  # a sorted array is a heap
            self.keys, self.rows = keys[order], rows[order]

    def violated(self, counter: float) -> np.ndarray:
        """Places of all keys up to the counter; below a key that is larger nothing is looked at."""
        found, at = [], np.zeros(min(1, len(self.keys)), np.int64)
        while len(at := at[self.keys[at] <= counter]):
            found.append(at)
            at = np.concatenate([2 * at + 1, 2 * at + 2])
            at = at[at < len(self.keys)]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def replace(self, at: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> None:
        """Take out what stands at these places and put these in."""
        n, m = len(self.keys), len(self.keys) - len(at) + len(keys)
        gone = np.zeros(max(n, m), bool)
        gone[at], gone[n:] = True, True
        all_keys, all_rows = np.empty(max(n, m)), np.empty(max(n, m), self.rows.dtype)
        all_keys[:n], all_rows[:n] = self.keys, self.rows
        # what stays but lies behind the new end moves forward, then the new ones
        tail = np.flatnonzero(~gone[m:]) + m
        holes = np.flatnonzero(gone[:m])
        all_keys[holes] = np.concatenate([all_keys[tail], keys])
        all_rows[holes] = np.concatenate([all_rows[tail], rows])
        self.keys, self.rows = all_keys[:m], all_rows[:m]
        self._mend(holes)

    def _mend(self, places: np.ndarray) -> None:
        """Restore the order after these places were overwritten."""
        n = len(self.keys)
        # every place above an overwritten one is settled after it, level by level: those of a level share no child
        todo = np.zeros(n, bool)
        while len(places):
            todo[places] = True
            places = np.unique((places[places > 0] - 1) // 2)
            places = places[~todo[places]]
        places = np.flatnonzero(todo)
        level = np.frexp((places + 1).astype(np.float64))[1]
        for k in range(int(level.max(initial=0)), 0, -1):
            self._sift(places[level == k])

    def _sift(self, at: np.ndarray) -> None:
        n = len(self.keys)
        while len(at):
            left, right = 2 * at + 1, 2 * at + 2
            low = at
            for child in (left, right):
                inside = child < n
                better = np.zeros(len(at), bool)
                better[inside] = self.keys[child[inside]] < self.keys[low[inside]]
                low = np.where(better, child, low)
            down = low != at
            a, b = at[down], low[down]
            self.keys[a], self.keys[b] = self.keys[b], self.keys[a]
            self.rows[a], self.rows[b] = self.rows[b], self.rows[a]
            at = b


class Block:
    """Vectors (rows x parts x places) and the heaps of their parts."""

    def __init__(self, x: np.ndarray, heaps: list[list[Heap]]):
        self.x, self.heaps = x, heaps

    @classmethod
    def of(cls, x: np.ndarray, books: Books) -> Block:
        heaps = []
        for p in range(x.shape[1]):
            own, slack = nearest(x[:, p], books.entries[p])
            keys = slack + books.counters[p][own]
            heaps.append([Heap(keys[k], k.astype(np.int32), made=False) for j in range(books.entries.shape[1]) for k in [np.flatnonzero(own == j)]])
        return cls(x, heaps)

    def sums(self) -> np.ndarray:
        """part, entry -> sums of its parts' components, then their count."""
        return np.array([[[*self.x[h.rows, p].sum(0), len(h.rows)] for h in own] for p, own in enumerate(self.heaps)], np.int64)

    def settle(self, books: Books) -> tuple[np.ndarray, int]:
        """Pop, compare and push what the counters have passed; the change of sums() and how many parts were compared."""
        change, compared = np.zeros((*books.entries.shape[:2], self.x.shape[2] + 1), np.int64), 0
        for p, own in enumerate(self.heaps):
            popped = [h.violated(c) for h, c in zip(own, books.counters[p], strict=True)]
            rows = np.concatenate([h.rows[at] for h, at in zip(own, popped, strict=True)])
            if not len(rows):
                continue
            compared += len(rows)
            was = np.repeat(np.arange(len(own)), [len(at) for at in popped])
            now, slack = nearest(self.x[rows, p], books.entries[p])
            keys = slack + books.counters[p][now]
            for j, (h, at) in enumerate(zip(own, popped, strict=True)):
                if len(at) or (now == j).any():
                    h.replace(at, keys[now == j], rows[now == j])
            moved = np.flatnonzero(was != now)
            step = np.hstack([self.x[rows[moved], p].astype(np.int64), np.ones((len(moved), 1), np.int64)])
            np.subtract.at(change[p], was[moved], step)
            np.add.at(change[p], now[moved], step)
        return change, compared

    def codes(self) -> np.ndarray:
        out = np.empty(self.x.shape[:2], np.uint8)
        for p, own in enumerate(self.heaps):
            for j, h in enumerate(own):
                out[h.rows, p] = j
        return out

    def errors(self, books: Books, codes: np.ndarray) -> np.ndarray:
        return sum(((self.x[:, p].astype(np.int64) - books.entries[p][codes[:, p]]) ** 2).sum(1) for p in range(self.x.shape[1]))


class _Table:
    """Blocks as rows of a table: ids, labels, vectors, heaps, the last change of sums and the number of parts compared."""

    def __init__(self, ids: pa.DataType, label: pa.DataType, parts: int, places: int, entries: int):
        self.parts, self.places, self.entries = parts, places, entries
        self.schema = pa.schema([("ids", pa.list_(ids)), ("labels", pa.list_(label)), ("x", pa.binary()), ("keys", pa.binary()), ("rows", pa.binary()), ("sizes", pa.list_(pa.int32())), ("change", pa.list_(pa.int64())), ("compared", pa.int64())])

    def row(self, ids: pa.Array, labels: pa.Array, block: Block, change: np.ndarray, compared: int) -> pa.RecordBatch:
        flat = [h for own in block.heaps for h in own]
        one = lambda values, kind: pa.array([values], kind)
        columns = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (ids, labels)]
        columns += [one(block.x.astype("<i4").tobytes(), pa.binary()), one(b"".join(h.keys.astype("<f8").tobytes() for h in flat), pa.binary()), one(b"".join(h.rows.astype("<i4").tobytes() for h in flat), pa.binary())]
        columns += [one([len(h.keys) for h in flat], pa.list_(pa.int32())), one(change.ravel().tolist() if change.any() else [], pa.list_(pa.int64())), one(compared, pa.int64())]
        return pa.record_batch(columns, schema=self.schema)

    def blocks(self, batches):
        for batch in batches:
            for k in range(batch.num_rows):
                at = {name: batch.column(name)[k] for name in ("ids", "labels", "x", "keys", "rows", "sizes")}
                x = np.frombuffer(at["x"].as_buffer(), "<i4").reshape(-1, self.parts, self.places)
                ends = np.cumsum(at["sizes"].as_py())
                keys, rows = (np.split(np.frombuffer(at[name].as_buffer(), kind), ends[:-1]) for name, kind in (("keys", "<f8"), ("rows", "<i4")))
                heaps = [Heap(a.copy(), b.copy()) for a, b in zip(keys, rows, strict=True)]
                yield at["ids"].values, at["labels"].values, Block(x, [heaps[p * self.entries : (p + 1) * self.entries] for p in range(self.parts)])

    def pack(self, books: Books, scale: int):
        """Rows (vec_id, label, v) to blocks with all parts assigned."""

        def run(batches):
            held, many = [], 0

            def block():
                ids, labels = (pa.concat_arrays([h[j] for h in held]) for j in range(2))
                made = Block.of(np.concatenate([h[2] for h in held]), books)
                yield self.row(ids, labels, made, made.sums(), len(ids) * self.parts)

            for batch in batches:
                c = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
                x = np.floor(c * scale)
                if len(x) and np.abs(x).max() > LARGEST:
                    raise ValueError(f"a component is beyond {LARGEST} / {scale}")
                held.append((batch.column("vec_id"), batch.column("label"), x.astype(np.int32).reshape(batch.num_rows, self.parts, self.places)))
                many += batch.num_rows
                if many >= BLOCK_ROWS:
                    yield from block()
                    held, many = [], 0
            if many:
                yield from block()

        return run

    def settle(self, books: Books):
        def run(batches):
            for ids, labels, block in self.blocks(batches):
                change, compared = block.settle(books)
                yield self.row(ids, labels, block, change, compared)

        return run

    def result(self, books: Books):
        """(vec_id, label, code, error), a small batch at a time."""

        def run(batches):
            for ids, labels, block in self.blocks(batches):
                block.settle(books)
                codes = block.codes()
                errors = block.errors(books, codes)
                for lo in range(0, len(ids), 4096):
                    text = [row.tobytes().hex() for row in codes[lo : lo + 4096]]
                    yield pa.record_batch([ids.slice(lo, 4096), labels.slice(lo, 4096), pa.array(text, pa.string()), pa.array(errors[lo : lo + 4096], pa.int64())], names=["vec_id", "label", "code", "error"])

        return run


class Coded(NamedTuple):
    """rows: (vec_id, label, code, error, label_error); books: part, entry -> integers in order; compared: parts compared with a codebook, by assignment."""

    rows: DataFrame
    books: list[list[int]]
    compared: list[int]


def _label_sums(rows: DataFrame, share: int = 1024) -> DataFrame:
    """label_error beside each row.  A label with at least 1/share of the rows, of which there are at most `share`, is looked up in a broadcast table, so no hot label meets in one task."""
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    least = rows.count() // share + 1
    same = F.col("rows.label").eqNullSafe(F.col("sums.label"))
    hot = F.broadcast(sums.where(F.col("n") >= least)).alias("sums")
    columns = [F.col(f"rows.{c}") for c in rows.columns] + [F.col("label_error")]
    found = rows.alias("rows").join(hot, same, "left").select(*columns)
    rest = found.where(F.col("label_error").isNull()).drop("label_error").alias("rows").join(sums.where(F.col("n") < least).alias("sums"), same).select(*columns)
    return found.where(F.col("label_error").isNotNull()).union(rest)


def compress(spark: SparkSession, vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, ids: str = "vec_id", vector: str = "embedding", label: str = "label") -> Coded:
    """Codes of all usable vectors after `rounds` rounds of assignment and replacement, and one more assignment."""
    scratch = Scratch(spark, "codes")
    rows = scan(vectors, vec_id=ids, label=label, v=vector).withColumn("v", F.col("v").cast("array<double>"))
    rows = rows.where(finite(F.col("v")))
    kind = {f.name: f.dataType for f in rows.schema.fields}
    out_ddl = f"vec_id {kind['vec_id'].simpleString()}, label {kind['label'].simpleString()}, code string, error long"
    width = one_width(rows)
    if width is None:
        return Coded(spark.createDataFrame([], out_ddl + ", label_error long"), [[] for _ in range(parts)], [])
    if width % parts:
        raise ValueError(f"{width} components are no {parts} equal parts")
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    start = np.floor(np.array([r["v"] for r in first], np.float64).reshape(len(first), width) * scale)
    if np.abs(start).max(initial=0) > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} / {scale}")
    start = start.astype(np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    books = Books(start, np.zeros(start.shape[:2]))
    blocks = _Table(to_arrow_type(kind["vec_id"]), to_arrow_type(kind["label"]), parts, width // parts, len(first))
    ddl = f"ids array<{kind['vec_id'].simpleString()}>, labels array<{kind['label'].simpleString()}>, x binary, keys binary, rows binary, sizes array<int>, change array<long>, compared long"

    state = scratch.table(rows.mapInArrow(blocks.pack(books, scale), ddl))
    sums, compared = np.zeros((*start.shape[:2], width // parts + 1), object), []
    for k in range(rounds):
        if k:
            state = scratch.table(state.mapInArrow(blocks.settle(books), ddl))
        change = state.select(F.posexplode("change").alias("at", "value")).groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
        for r in change.collect():
            sums.flat[r["at"]] += int(r["value"])
        compared.append(state.agg(F.sum("compared")).first()[0])
        counts = sums[:, :, -1:]
        after = np.where(counts > 0, sums[:, :, :-1] // np.maximum(counts, 1), books.entries.astype(object)).astype(np.int64)
        books = books.moved_to(after)
    coded = scratch.table(state.mapInArrow(blocks.result(books), out_ddl))
    flat = [[[int(x) for x in entry] for entry in book] for book in books.entries]
    return Coded(_label_sums(coded), [[x for entry in book for x in entry] for book in flat], compared)

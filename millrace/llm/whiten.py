"""Whitening of embeddings by matrix-free block subspace iteration.

The rows become integers once: x = floor(scale * c).  The fit list, each distinct x once, is a table
of packed blocks in the shared folder; every pass over it multiplies the centred rows by an
orthonormal block Q and adds up Xt(XQ), so no covariance matrix is formed and a task holds one block
of rows and dimensions x columns sums.  On the driver, which sees dimensions x columns numbers only:
Rayleigh-Ritz in the block, residuals |Vq - eq| of the wanted components, QR for the next block.
The passes end when every residual is below `certified` of the largest eigenvalue.  If they shrink
too slowly to end soon, because the spectrum is flat, the block is doubled; a block of all dimensions
is exact.

Sums are exact: S and the sums of squares are added as decimals, deviations as integers.

Cases: rows whose vector is null or holds null, NaN or infinity are dropped; an empty table gives no
rows; a null vec_id stays, repeated rows stay and count once in the fit; vectors of unlike length
raise ValueError.  A component of no variance (a fit list of one row, or of fewer dimensions than it
spans) has explained 0 and a null whitened value, and no part in identity_error.  There are at most
as many components as dimensions.  A deviation that does not fit a long raises OverflowError.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import CHUNKS, CHUNKS_DDL, Scratch, add_chunks, finite, one_width, scan

#: Largest |x|, which four bytes hold.
MOST = (1 << 31) - 1
#: Up to here the squares of a block add up within a long.
PLAIN = 1 << 24
#: Rows of a packed block of the fit list.
BLOCK_ROWS = 8192
#: Dimensions of a chunk of sums.
CHUNK_DIMS = 256
#: Passes that may lie ahead before the block is doubled instead.
PATIENCE = 6


def integers(column: pa.Array, scale: int, width: int) -> np.ndarray:
    """floor(scale * c) of a column of vectors, row by row."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    x = np.floor(c * scale)
    if len(x) and np.abs(x).max() > MOST:
        raise ValueError(f"a component is beyond {MOST} / {scale}")
    return x.astype(np.int64).reshape(-1, width)


def _distinct_keys(scale: int, width: int):
    def run(batches):
        for batch in batches:
            x = integers(batch.column("v"), scale, width).astype("<i4")
            keys = pa.Array.from_buffers(pa.binary(4 * width), len(x), [None, pa.py_buffer(x.tobytes())])
            yield pa.record_batch([keys.cast(pa.binary())], names=["x"])

    return run


def _pack(batches):
    held: list[bytes] = []
    for batch in batches:
        held += batch.column("x").to_pylist()
        while len(held) >= BLOCK_ROWS:
            yield pa.record_batch([pa.array([b"".join(held[:BLOCK_ROWS])], pa.binary())], names=["rows"])
            held = held[BLOCK_ROWS:]
    if held:
        yield pa.record_batch([pa.array([b"".join(held)], pa.binary())], names=["rows"])


def _blocks(batches, width: int):
    for batch in batches:
        for data in batch.column("rows"):
            yield np.frombuffer(data.as_buffer(), "<i4").reshape(-1, width).astype(np.float64)


def _moments(width: int):
    """Per task and dimension: rows, sum, sum of squares."""

    def run(batches):
        n, total, squares = 0, [0] * width, [0] * width
        for batch in batches:
            for data in batch.column("rows"):
                x = np.frombuffer(data.as_buffer(), "<i4").reshape(-1, width).astype(np.int64)
                n += len(x)
                x = x if not len(x) or np.abs(x).max() <= PLAIN else x.astype(object)
                total = [a + int(b) for a, b in zip(total, x.sum(0), strict=True)]
                squares = [a + int(b) for a, b in zip(squares, (x * x).sum(0), strict=True)]
        if n:
            yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array([str(a) for a in total]), pa.array([str(a) for a in squares])], names=["d", "n", "s", "q"])

    return run


def _sum_products(fit: DataFrame, width: int, columns: int, products) -> np.ndarray:
    """The sum over all blocks of products(block), an array of `width` rows and `columns` columns."""

    def run(batches):
        total = np.zeros((width, columns))
        some = False
        for x in products(batches):
            total += x
            some = True
        for k in range(0, width, CHUNK_DIMS) if some else ():
            part = np.ascontiguousarray(total[k : k + CHUNK_DIMS])
            yield pa.RecordBatch.from_pylist([{"slot": 0, "chunk": k // CHUNK_DIMS, "real": True, "data": part.tobytes()}], schema=CHUNKS)

    parts = fit.mapInArrow(run, CHUNKS_DDL).withColumn("slot", F.spark_partition_id())
    got = sorted((r["chunk"], r["data"]) for r in add_chunks(parts).collect())
    return np.concatenate([np.frombuffer(d, np.float64) for _, d in got]).reshape(width, columns)


class Fit(NamedTuple):
    """n rows with sums `total`; unit components (columns) with their eigenvalues; passes over the fit list."""

    n: int
    total: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray
    passes: int
    residual: float


def principal(fit: DataFrame, width: int, k: int, certified: float = 1e-13, seed: int = 7) -> Fit:
    """The k leading components of a packed fit list, `width` dimensions wide."""
    long = "decimal(38,0)"
    got = fit.mapInArrow(_moments(width), "d int, n long, s string, q string").groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast(long)).alias("s"), F.sum(F.col("q").cast(long)).alias("q")).collect()
    got = sorted((r["d"], int(r["n"]), int(r["s"]), int(r["q"])) for r in got)
    n, total = got[0][1] if got else 0, [s for _, _, s, _ in got]
    trace = math.fsum((n * q - s * s) / n**2 for _, _, s, q in got)  # integers until the division
    k = min(k, width)
    if trace == 0:
        return Fit(n, total, trace, np.zeros(k), np.eye(width)[:, :k], 0, 0.0)
    mean = np.array([s / n for s in total])
    rng = np.random.default_rng(seed)
    orth = lambda a: np.linalg.qr(a)[0]
    columns = min(width, k + max(8, 2 * k))
    q, before, passes = orth(rng.standard_normal((width, columns))), None, 0

    def pass_over(q):
        def products(batches):
            for x in _blocks(batches, width):
                x -= mean
                yield x.T @ (x @ q)

        return _sum_products(fit, width, q.shape[1], products) / n

    while True:
        y = pass_over(q)
        passes += 1
        small = q.T @ y
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image = q @ turn, y @ turn
        residual = float(np.linalg.norm(image[:, :k] - ritz[:, :k] * values[:k], axis=0).max() / values[0])
        if residual <= certified or q.shape[1] == width:
            break
        # passes that lie ahead at the rate of the last one
        ahead = math.inf if before is None or residual >= before else math.log(residual / certified) / math.log(before / residual)
        if before is not None and ahead > PATIENCE:
            more = min(width, 2 * q.shape[1]) - q.shape[1]
            q, before = orth(np.hstack([image, rng.standard_normal((width, more))])), None
        else:
            q, before = orth(image), residual
    return Fit(n, total, trace, values[:k].clip(min=0), ritz[:, :k], passes, residual)


def _deviations(x: np.ndarray, n: int, total: list[int]) -> list[int]:
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, total), default=0)
    if most**2 * max(1, len(total)) < 1 << 63:
        return ((n * x - np.array(total, np.int64)) ** 2).sum(1).tolist()
    out = ((n * x.astype(object) - np.array(total, object)) ** 2).sum(1).tolist()
    if max(out, default=0) >= 1 << 63:
        raise OverflowError("a deviation is beyond a long")
    return out


_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
_OUT_DDL = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def fit_list(rows: DataFrame, scratch: Scratch, scale: int, width: int) -> DataFrame:
    """Each distinct x of rows (v) once, in packed blocks.  Equal rows meet as counted keys: copies combine before the shuffle."""
    keys = rows.select("v").mapInArrow(_distinct_keys(scale, width), "x binary").distinct()
    return scratch.table(keys.mapInArrow(_pack, "rows binary"))


def whiten(spark: SparkSession, vectors: DataFrame, k: int = 4, scale: int = 256, certified: float = 1e-13) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component."""
    scratch = Scratch(spark, "whiten")
    rows = scan(vectors, vec_id="vec_id", v="embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    rows = rows.where(finite(F.col("v")))
    width = one_width(rows)
    if not width:
        return spark.createDataFrame([], _OUT_DDL)
    fit = fit_list(rows, scratch, scale, width)
    found = principal(fit, width, k, certified)
    n, total, mean = found.n, found.total, np.array([s / found.n for s in found.total])
    # below the rounding of the largest, a component has no variance
    live = int((found.values > 1e-12 * max(found.values[0], 1e-300)).sum()) if found.trace > 0 else 0
    project = found.components[:, :live] / np.sqrt(found.values[:live])

    def moments(batches):
        for x in _blocks(batches, width):
            w = (x - mean) @ project
            yield np.vstack([w.T @ w, w.sum(0)])

    error = 0.0
    if live:
        sums = _sum_products(fit, live + 1, live, moments) / n
        error = float(np.abs(sums[:live] - np.outer(sums[live], sums[live]) - np.eye(live)).max())
    explained = (found.values / found.trace if live else np.zeros(len(found.values))).tolist()
    scratch.drop()
    many = len(explained)

    def run(batches):
        for batch in batches:
            x = integers(batch.column("v"), scale, width)
            white = np.full((len(x), many), np.nan)
            white[:, :live] = (x - mean) @ project
            missing = np.tile(np.arange(many) >= live, len(x))
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), many)))
            deviation = np.repeat(np.array(_deviations(x, n, total), np.int64), many)
            columns = [ids, pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * many, n)), pa.array(deviation)]
            columns += [pa.array(white.ravel(), mask=missing), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * many, error))]
            yield pa.record_batch(columns, schema=_OUT)

    return rows.mapInArrow(run, _OUT_DDL)

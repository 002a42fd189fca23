"""Lexical, vector and fused retrieval."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators.components import spread

#: Query vectors that a scan holds.
MOST_QUERIES = 32_768
#: Components of the vectors that a task compares at once.
MOST_COMPONENTS = 1 << 22


def bm25(spark: SparkSession, docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 1.0, top: int = 5, bonus: float = 0.5) -> DataFrame:
    """(query_id, doc_id, score, rank): the best documents of each query.

    Only tokens that a query asks for leave the scan; a term that stands twice in a query adds twice.  If queries and
    documents have a subject_id, equal ones add `bonus`.
    """
    terms = queries.select("query_id", F.explode(text.query_terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    tokens = docs.select("doc_id", text.search_tokens(F.col("text")).alias("t")).select("doc_id", "t", F.size("t").alias("len"))
    stats = tokens.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    wanted = terms.select("term").distinct()
    tf = tokens.select("doc_id", "len", F.explode("t").alias("term")).join(wanted, "term").groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    rows = tf.join(df, "term").join(terms, "term").crossJoin(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = rows.groupBy("query_id", "doc_id").agg(F.sum(part * F.col("times")).alias("score"))
    if "subject_id" in docs.columns and "subject_id" in queries.columns:
        same = docs.select("doc_id", F.col("subject_id").alias("_d")).distinct()
        asked = queries.select("query_id", F.col("subject_id").alias("_q"))
        scored = scored.join(asked, "query_id").join(same, (scored["doc_id"] == same["doc_id"]) & (F.col("_d") == F.col("_q")), "left").select("query_id", scored["doc_id"], (F.col("score") + F.when(F.col("_d").isNotNull(), F.lit(bonus)).otherwise(F.lit(0.0))).alias("score"))
    return top_k(scored, ["query_id"], [F.desc(F.round("score", 9)), F.asc("doc_id")], top)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _digits(score: np.ndarray) -> np.ndarray:
    """Scores in units of the ninth digit, rounded as Spark's round does; null scores (-inf) below all, NaN above all."""
    x = np.abs(np.where(np.isfinite(score), score, 0)) * 1e9
    whole = np.floor(x + 0.5)
    near = np.flatnonzero(np.abs(x - np.floor(x) - 0.5) < 1e-4)  # the decimal digits decide
    if len(near):
        values, at = np.unique(np.abs(score[near]), return_inverse=True)
        whole[near] = np.array([int(Decimal(repr(v)).quantize(Decimal("1e-9"), ROUND_HALF_UP).scaleb(9)) for v in values.tolist()], float)[at]
    out = (np.sign(score, where=np.isfinite(score), out=np.zeros(len(score))) * whole).astype(np.int64)
    return np.where(np.isnan(score), 1 << 40, np.where(np.isneginf(score), -(1 << 40), out))


def _by_width(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors by their number of components; null vectors under -1."""
    width = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    own = np.repeat(width, np.maximum(width, 0))
    at = {int(w): np.flatnonzero(width == w) for w in np.unique(width)}
    return {w: (rows, values[own == w].reshape(len(rows), max(w, 0))) for w, rows in at.items()}


def _norm(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * x[:, d]
    return np.sqrt(out)


def _unit(x: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return np.divide(x, norm[:, None], out=np.zeros_like(x), where=((norm > 0) & np.isfinite(norm))[:, None]).astype(np.float32)


class _Best:
    """The k best rows of each query so far: by score to nine digits, then by id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.key = np.full((queries, k), np.iinfo(np.int64).min)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.score = np.full((queries, k), -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        own = np.unique(query)
        all_q = np.concatenate([np.repeat(own, self.k), query])
        key, ids, score = (np.concatenate([old[own].ravel(), new]) for old, new in ((self.key, _digits(score)), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, -key - 1, all_q))  # -key - 1: the least number has no negative
        start = np.flatnonzero(np.r_[True, np.diff(all_q[order]) > 0])
        top = order[(start[:, None] + np.arange(self.k)).ravel()]  # each query has k rows at least, the old ones
        for name, new in (("key", key), ("id", ids), ("score", score)):
            getattr(self, name)[own] = new[top].reshape(-1, self.k)


def _few(ids: np.ndarray, same: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the k best of a query: of equal vectors (same) those of least ids, enough of them without the query's own."""
    order = np.lexsort((ids, same))
    for keys, most in (((same, ids), k), ((same,), 2 * k)):
        new = np.r_[True, np.any([np.diff(x[order]) != 0 for x in keys], axis=0)] if len(order) else np.zeros(0, bool)
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        order = order[place < most]
    return order


def _compare(best: _Best, at: np.ndarray, ids_q: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
    """Add the pairs of queries (numbers at) and rows of one width: products in single precision tell which are worth a score in double."""
    k, slack = best.k, 2e-9 + (q.shape[1] + 8) * 2.4e-7
    norm_q, norm_x = _norm(q), _norm(x)
    unit_q, unit_x = _unit(q, norm_q), _unit(x, norm_x)
    odd_q, odd_x = ~((norm_q > 0) & np.isfinite(norm_q)), ~((norm_x > 0) & np.isfinite(norm_x))
    for lo in range(0, len(q), 512):
        rows = at[lo : lo + 512]
        for vo in range(0, len(x), 8192):
            near = unit_q[lo : lo + 512] @ unit_x[vo : vo + 8192].T
            own = ids_q[rows][:, None] == ids[None, vo : vo + 8192]
            odd = odd_q[lo : lo + 512, None] | odd_x[None, vo : vo + 8192]
            near[own | odd] = -8
            least = np.where(best.key[rows, -1] > -(1 << 39), best.key[rows, -1] * 1e-9 - slack, -4)
            if near.shape[1] > k and (least < -2).any():
                some = np.flatnonzero(least < -2)
                kth = np.partition(near[some], near.shape[1] - k, axis=1)[:, near.shape[1] - k]
                least[some] = np.where(kth < -2, -4, kth - 2 * slack)
            near[odd & ~own] = 4  # products tell nothing of these
            i, j = np.nonzero(near >= least[:, None].astype(np.float32))
            for part in range(0, len(i), 1 << 16):
                a, b = i[part : part + (1 << 16)] + lo, j[part : part + (1 << 16)] + vo
                dot = np.zeros(len(a))
                for d in range(q.shape[1]):  # the order of additions that the expression `cosine` has
                    dot += q[a, d] * x[b, d]
                by = norm_q[a] * norm_x[b]
                score = np.where(by == 0, -np.inf, np.divide(dot, by, out=np.zeros(len(a)), where=by != 0))
                best.add(at[a], ids[b], score)


def _best_of_task(queries, k: int):
    def run(batches):
        ids_q, by_width = queries.value
        best = _Best(len(ids_q), k)

        def block(held):
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table.column("vec_id").to_numpy()
            found = _by_width(table.column("v").combine_chunks())
            for w, (at, q) in by_width.items():
                for v, (rows, x) in found.items():
                    if w == v and w >= 0:
                        same = np.unique(np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, 8 * w))).ravel(), return_inverse=True)[1] if w else np.zeros(len(x), int)
                        few = _few(ids[rows], same, k)
                        _compare(best, at, ids_q, q, ids[rows][few], x[few])
                    else:  # no score: only the least ids can be among the best
                        few = ids[rows][_few(ids[rows], np.zeros(len(rows), int), k)]
                        a, b = np.repeat(np.arange(len(at)), len(few)), np.tile(few, len(at))
                        other = ids_q[at][a] != b
                        best.add(at[a[other]], b[other], np.full(other.sum(), -np.inf))

        held, size = [], 0
        with np.errstate(invalid="ignore", over="ignore"):
            for batch in batches:
                held.append(batch)
                size += len(batch.column("v").flatten()) + batch.num_rows
                if size >= MOST_COMPONENTS:
                    block(held)
                    held, size = [], 0
            if held:
                block(held)
        for lo in range(0, len(ids_q), 8192):
            there = best.key[lo : lo + 8192] > np.iinfo(np.int64).min
            score = best.score[lo : lo + 8192][there]
            query = np.repeat(ids_q[lo : lo + 8192], k)[there.ravel()]
            yield pa.record_batch([pa.array(query, pa.int64()), pa.array(best.id[lo : lo + 8192][there], pa.int64()), pa.array(score, pa.float64(), mask=np.isneginf(score))], names=["query_id", "vec_id", "score"])

    return run


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, vec_id, score, rank): exact nearest vectors of query vectors (query_id, q); ids are whole numbers.

    Queries travel in blocks of about MOST_QUERIES, a scan for each block.  A task compares all queries with a block of
    vectors at once, as products of matrices, and holds k rows for each query.  Pairs whose product may reach the k-th score are scored
    in double precision.  Without a score (null vectors or components, other lengths, zero vectors) a row comes after all others.
    """
    v = lambda c: F.when(F.forall(c, lambda a: a.isNotNull()), c.cast("array<double>"))
    rows = spread(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v(F.col("embedding")).alias("v")).where("vec_id is not null"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), v(F.col("q")).alias("v")).where("query_id is not null")
    blocks = max(1, -(-asked.count() // MOST_QUERIES))
    found = None
    for b in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        column = some.column("v").combine_chunks()
        shared = vectors.sparkSession.sparkContext.broadcast((some.column("query_id").to_numpy(), _by_width(column) if len(column) else {}))
        best = rows.mapInArrow(_best_of_task(shared, k), "query_id long, vec_id long, score double")
        found = best if found is None else found.union(best)
    return top_k(found, ["query_id"], [F.desc(F.round("score", 9)), F.asc("vec_id")], k)


def fuse(lists: list[DataFrame], key: str, group: str = "query_id", c: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (c + rank) over the lists."""
    rows = None
    for one in lists:
        part = one.select(group, key, (F.lit(1.0) / (F.lit(c) + F.col("rank"))).alias("w"))
        rows = part if rows is None else rows.union(part)
    return rows.groupBy(group, key).agg(F.sum("w").alias("rrf"))


def search(docs: DataFrame, query: str, columns: list[str], limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """Total hits of a case-blind substring, and the first of them by id."""
    q = query.lower()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(q)), F.lit(False))
    found = docs.where(hit)
    return found.agg(F.count("*").alias("total")), found.orderBy("doc_id").limit(limit)


def search_all(zones: dict[str, tuple[DataFrame, str, list[str]]], query: str, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """A case-blind substring in several tables: (zone, total), and (zone, key) of the first hits of each.

    zones: by name a table, its key column and the columns to search.
    """
    q, totals, firsts = query.lower(), None, None
    for name, (df, key, columns) in sorted(zones.items()):
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(q)), F.lit(False))
        found = df.where(hit).select(F.lit(name).alias("zone"), F.col(key).cast("string").alias("key"), F.col(key).alias("_order"))
        total = found.agg(F.count("*").alias("total")).select(F.lit(name).alias("zone"), "total")
        first = found.orderBy("_order").limit(limit).select("zone", "key")
        totals = total if totals is None else totals.union(total)
        firsts = first if firsts is None else firsts.union(first)
    return totals, firsts

"""A stored inverted index: postings in blocks of documents, each with the most that it can add to a score.

Documents are dealt by a hash of their id into blocks of about `BLOCK`; a row holds one term's postings in one block, so a term
that stands in every document is as many small rows as there are blocks, never one group.  Rows are stored by a hash
of the term.  A query reads its terms' partitions, at first only the bounds: the blocks with the highest sums are
scored, their k-th score is a threshold, and of all other blocks only those whose sum reaches it are read.
The answer is that of scoring everything.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators.components import TASK_ROWS, cut, dealt
from millrace.operators.retrieval import top_k

BLOCK = 128
#: The columns of a row's postings, as arrays of one length.
POSTING = ("doc_id", "tf", "len")
#: Folders of an index.
PARTS = 64


class Index(NamedTuple):
    rows: DataFrame
    n: int
    avg_len: float
    k1: float
    b: float


def _weight(tf: Column, length: Column, avg: float, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg))


def part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def build(docs: DataFrame, path: str, k1: float = 1.2, b: float = 1.0) -> Index:
    """Write the index of docs (doc_id, text) under a path; texts are tokenised here and never again."""
    spark = docs.sparkSession
    tokens = cut(docs.select("doc_id", text.search_tokens(F.col("text")).alias("t")).select("doc_id", "t", F.size("t").cast("long").alias("len")))
    stats = tokens.agg(F.count("*").alias("n"), F.avg("len").alias("a"), F.sum("len").alias("all")).first()
    n, avg = stats["n"], float(stats["a"] or 0) or 1.0
    # each document travels once, its tokens as one text, to its block's task; terms are counted and gathered there
    block = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n // BLOCK))))
    packed = tokens.withColumn("block", block).withColumn("t", F.when(F.col("len") > 0, F.array_join("t", " ")))
    own = dealt(packed, "block", rows=stats["all"] or 0).withColumn("t", F.split("t", " ")).withColumn("_no", F.monotonically_increasing_id())
    tf = own.select("doc_id", "_no", "len", "block", F.explode("t").alias("term")).groupBy("block", "_no", "doc_id", "len", "term").agg(F.count("*").alias("tf"))
    rows = tf.groupBy("block", "term").agg(F.collect_list(F.struct("doc_id", F.col("tf").cast("int").alias("tf"), F.col("len").cast("int").alias("len"))).alias("p"))  # about BLOCK
    # arrays of numbers travel, not rows within rows; what follows from them is added where they are written.  The terms of
    # a folder are dealt to so many tasks that none has more than some TASK_ROWS
    rows = rows.select("block", "term", *[F.col(f"p.{c}").alias(c) for c in POSTING], part(F.col("term")).alias("part"))
    share = F.pmod(F.xxhash64(F.lit(1), "term"), F.lit(-(-(stats["all"] or 1) // (PARTS * TASK_ROWS))))
    rows = dealt(rows.withColumn("share", share), "part", "share", rows=stats["all"] or 0)
    bound = F.array_max(F.zip_with("tf", "len", lambda tf, length: _weight(tf, length, avg, k1, b)))
    rows = rows.select("block", "term", F.size("tf").cast("long").alias("df"), bound.alias("bound"), *POSTING, "part")
    rows.sortWithinPartitions("part", "term", "block").write.partitionBy("part").parquet(f"{path}/postings")
    spark.createDataFrame([(n, avg, k1, b)], "n long, avg_len double, k1 double, b double").write.parquet(f"{path}/stats")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    s = spark.read.parquet(f"{path}/stats").first()
    rows = spark.read.parquet(f"{path}/postings")
    return Index(rows.withColumn("postings", F.arrays_zip(*POSTING)), s["n"], s["avg_len"], s["k1"], s["b"])


def search(index: Index, queries: DataFrame, top: int = 5) -> DataFrame:
    """(query_id, doc_id, score, rank): the best documents of each query, as `retrieval.bm25` has them."""
    terms = queries.select("query_id", F.explode(text.query_terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    terms = cut(terms.withColumn("part", part(F.col("term"))))
    touched = sorted(r[0] for r in terms.select("part").distinct().collect())  # at most PARTS
    own = index.rows.where(F.col("part").isin(touched))
    # rows of other terms never travel
    own = own.join(terms.select("part", "term").distinct(), ["part", "term"], "left_semi")
    bounds = cut(own.select("part", "term", "block", "df", "bound"))
    df = bounds.groupBy("term").agg(F.sum("df").alias("all"))
    idf = F.log(1 + (F.lit(index.n) - F.col("all") + 0.5) / (F.col("all") + 0.5))
    weights = terms.join(df, "term").withColumn("w", F.col("times") * idf)
    sums = cut(bounds.select("term", "block", "bound").join(weights, "term").groupBy("query_id", "block").agg(F.sum(F.col("w") * F.col("bound")).alias("most")))

    def scored(blocks: DataFrame) -> DataFrame:
        asked = weights.select("query_id", "term", "part", "w").join(blocks.select("query_id", "block"), "query_id")
        hits = own.select("part", "term", "block", *POSTING).join(asked, ["part", "term", "block"]).select("query_id", "w", F.explode(F.arrays_zip(*POSTING)).alias("p"))
        part_of = F.col("w") * _weight(F.col("p.tf"), F.col("p.len"), index.avg_len, index.k1, index.b)
        return hits.groupBy("query_id", F.col("p.doc_id").alias("doc_id")).agg(F.sum(part_of).alias("score"))

    order = Window.partitionBy("query_id").orderBy(F.desc("most"), "block")
    first = cut(sums.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= top).drop("_k"))
    best = cut(scored(first))
    least = best.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("_k") == top).select("query_id", F.col("score").alias("least"))
    # scores are compared to nine digits, so a block that comes that near is read as well
    more = sums.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("most") >= F.col("least") - 1e-8))
    return top_k(best.unionByName(scored(more)), ["query_id"], [F.desc(F.round("score", 9)), F.asc("doc_id")], top)


def context(lists: list[DataFrame], exact: DataFrame, roots: DataFrame, top: int, c: int = 60) -> DataFrame:
    """(query_id, doc_id, score, exact, place): what an answer is written from.

    lists: ranked candidates (query_id, doc_id, rank), fused by reciprocal ranks.  exact: (query_id, doc_id) that satisfy the
    question's relation; they count as rank 0 and are in whatever `top` is.  roots: (doc_id, root) of copies; of one root only
    the best candidate stays.
    """
    rank = lambda df, r: df.select("query_id", "doc_id", (F.lit(1.0) / (F.lit(c) + r)).alias("w"))
    parts = rank(exact, F.lit(0)).withColumn("exact", F.lit(True))
    for one in lists:
        parts = parts.unionByName(rank(one, F.col("rank")).withColumn("exact", F.lit(False)))
    rows = parts.groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"), F.max("exact").alias("exact"))
    rows = rows.join(roots.select("doc_id", "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    best = [F.desc("exact"), F.desc(F.round("score", 9)), F.asc("doc_id")]
    rows = top_k(rows, ["query_id", "root"], best, 1).drop("rank")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*best))
    return rows.withColumn("place", place).where(F.col("exact") | (F.col("place") <= top)).select("query_id", "doc_id", "score", "exact", "place")

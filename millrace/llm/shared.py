"""What the operators share: the shared folder, tables that cut lineage, components of links."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset (tests, one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows in an Arrow batch: texts are long, and a task holds a batch twice in the JVM and once in Python.
BATCH_ROWS = 1000


class Scratch:
    """Tables of one operator call, under the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
        self._k = 0
        small_batches(spark)

    def table(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Write and reread: the plan that follows starts from files that every executor can read again."""
        self._k += 1
        path = f"{self.root}/{self._k}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Remove the folder; only when nothing reads its tables any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of at most BATCH_ROWS rows, unless the session already asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def scan(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names: columns that a table has besides never clash."""
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()])


def finite(v: Column) -> Column:
    """Whether a vector is there and holds neither null nor NaN nor infinity."""
    return v.isNotNull() & F.forall(v, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) != float("inf")))


def one_width(vectors: DataFrame) -> int | None:
    """The length of all vectors; None if there are none."""
    found = vectors.agg(F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b")).first()
    if found["a"] != found["b"]:
        raise ValueError(f"vectors of {found['a']} and of {found['b']} components")
    return found["a"]


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every end of the links (a, b) that is not a root; root: the smallest node reachable."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        x, y = up[x], up[y]
        apart = x != y
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]
    below = up != np.arange(len(nodes))
    return nodes[below], nodes[up[below]]


def _contract(batches):
    got = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if got:
        node, root = forest(*(np.concatenate(x) for x in zip(*got, strict=True)))
        yield pa.record_batch([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["a", "b"])


def components(edges: DataFrame, scratch: Scratch, most: int = 1 << 20) -> DataFrame:
    """(node, component) for each end of the links (a, b); component: the smallest node reachable.

    Each task contracts about `most` links to a forest of stars.  As long as one task is not
    enough, a round of alternating large and small stars follows: it links each node's
    neighbours to the smallest of them, by grouped aggregations with partial sums and joins that
    adaptive execution may split, so long chains halve and the next contraction finds more.  The
    loop ends when one task held all links or a round changes nothing, which every graph reaches:
    links only ever move to smaller nodes.
    """
    a, b = F.col("a"), F.col("b")
    down = lambda x: x.where("a != b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    links, before = scratch.table(down(edges)), None
    while True:
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        parts = math.ceil(state["n"] / most)
        if state == before or parts < 2:
            links = links.coalesce(1).mapInArrow(_contract, "a long, b long") if parts == 1 else links
            break
        before = state
        both = links.repartition(parts, F.xxhash64("a", "b")).mapInArrow(_contract, "a long, b long")
        both = scratch.table(both.union(both.select(b.alias("a"), a.alias("b"))))
        least = both.groupBy("a").agg(F.least(F.min("b"), a).alias("m"))
        large = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).union(least.where("m < a").select("a", F.col("m").alias("b")))
        large = scratch.table(large.where("a != b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(b.alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        links = scratch.table(down(small))
    links = scratch.table(links)
    return links.select(a.alias("node"), b.alias("component")).union(links.select(b.alias("node"), b.alias("component")).distinct())


def as_text(values: list[bytes]) -> pa.Array:
    """A text column of these bytes, as they are."""
    x = pa.array(values, pa.binary())
    return pa.StringArray.from_buffers(len(x), x.buffers()[1], x.buffers()[2], x.buffers()[0], x.null_count)


def add_chunks(df: DataFrame, scratch: Scratch | None = None, fan: int = 64) -> DataFrame:
    """(slot int, chunk int, data binary of int64) added up per chunk, in two rounds of streams.

    A task holds one running sum for each chunk dealt to it, never the rows of a chunk.
    """

    def fold(key: list[str]):
        def run(batches):
            sums: dict[tuple, object] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    k = tuple(row[c] for c in key)
                    v = np.frombuffer(row["data"], np.float64 if row["real"] else np.int64)
                    sums[k] = (sums[k][0] + v, row["real"]) if k in sums else (v.copy(), row["real"])
            for k, (v, real) in sums.items():
                at = dict(zip(key, k, strict=True))
                yield pa.RecordBatch.from_pylist([{"slot": at.get("slot", 0), "chunk": at["chunk"], "real": real, "data": v.tobytes()}], schema=CHUNKS)

        return run

    n = tasks(df.sparkSession)
    first = df.withColumn("slot", F.col("slot") % fan).repartition(n, "slot", "chunk").mapInArrow(fold(["slot", "chunk"]), CHUNKS_DDL)
    return first.repartition(n, "chunk").mapInArrow(fold(["chunk"]), CHUNKS_DDL)


CHUNKS = pa.schema([("slot", pa.int32()), ("chunk", pa.int32()), ("real", pa.bool_()), ("data", pa.binary())])
CHUNKS_DDL = "slot int, chunk int, real boolean, data binary"

"""Connected components, pointer jumping and bounded breadth-first search on DataFrames."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, where all executors read and write; a temporary one only in local mode where that is unset."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="millrace-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """End the lineage in the shared folder: rows are computed and written once, as a compressed table whose readers take the columns and the splits that they need."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table of fewer partitions than there are cores dealt out to all of them; a larger table as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows that a task aggregates or sorts.
TASK_ROWS = 500_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Rows dealt out by keys to so many tasks that each holds some TASK_ROWS of them, however large the table; rows: their number, if it is known."""
    rows = df.count() if rows is None else rows
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)), *keys)


def _stars(most: int):
    """Links (a, b) to links of the same components, each node to the least one reached: about `most` at a time."""

    def run(batches):
        up = {}

        def root(x):
            top = x
            while (y := up[top]) != top:
                top = y
            while up[x] != top:
                up[x], x = top, up[x]
            return top

        def out():
            ends = [(x, y) for x in up if (y := root(x)) != x]
            for lo in range(0, len(ends), 65536):
                part = ends[lo : lo + 65536]
                yield pa.record_batch([pa.array([e[k] for e in part], kind) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            kind = batch.schema.field("a").type
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                up.setdefault(a, a)
                up.setdefault(b, b)
                x, y = root(a), root(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) >= most:
                yield from out()
                up.clear()
        if up:
            yield from out()

    return run


def contracted(links: DataFrame, most: int = 2 * TASK_ROWS) -> DataFrame:
    """(a, b): links of the same components as these, where they stand: stars of what a task holds together."""
    kind = links.schema["a"].dataType.simpleString()
    return links.mapInArrow(_stars(most), f"a {kind}, b {kind}")


def _settled(links: DataFrame) -> bool:
    """Whether links (a, b) of lesser b are stars: each node either has one lesser neighbour or is one itself."""
    ends = links.select(F.col("a").alias("x"), F.lit(1).alias("n"), F.lit(False).alias("low")).union(links.select(F.col("b").alias("x"), F.lit(0).alias("n"), F.lit(True).alias("low")))
    rows = ends.groupBy("x").agg(F.sum("n").alias("n"), F.max("low").alias("low"))
    return rows.where("n > 1 or (low and n > 0)").limit(1).count() == 0


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component) of an undirected graph (a, b); component: the least node reachable.

    Tasks contract the links that they hold to stars. Then large star, then small star: each node's greater
    neighbours, then its lesser ones, are linked to the least of them, until all links are stars, as they must
    become: they only move to lesser nodes.  Links that come with their component together, as those of a block or of
    a class do, are settled without such a round.  Aggregations combine before the shuffle.
    """
    link = lambda x, y: [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]
    links = cut(contracted(edges.select(*link(F.col("a"), F.col("b"))).where("a != b")).distinct())
    while not _settled(links):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("b", "m").union(low.select(F.col("a").alias("b"), "m"))
        links = cut(small.select(*link(F.col("b"), F.col("m"))).where("a != b").distinct())
    found = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = found.union(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
    if nodes is None:
        return found
    return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def resolve_pointers(pointers: DataFrame) -> DataFrame:
    """(node, root) of (node, target) chains, one target for each node; nodes of a cycle, and those that lead into it, get its least node.

    Each round doubles how far a pointer reaches and remembers the least node passed.  After as many rounds as
    the node count has binary digits a pointer has either ended or gone round its cycle.
    """
    n = max(1, pointers.count())
    here = cut(pointers.select("node", F.col("target").alias("root"), F.col("target").alias("least")))
    for _ in range(n.bit_length() + 1):
        nxt = here.select(F.col("node").alias("root"), F.col("root").alias("next"), F.col("least").alias("further"))
        step = cut(here.join(nxt, "root", "left"))
        moved = step.where("next is not null and next != root").limit(1).count()
        here = step.select("node", F.coalesce("next", "root").alias("root"), F.least("least", F.coalesce("further", "least")).alias("least"))
        if not moved:
            break
    # a root that still points elsewhere stands in a cycle, whose least node its own walk has passed
    inside = pointers.where("node != target").select(F.col("node").alias("root"))
    inside = here.join(inside, "root", "left_semi").select(F.col("root").alias("node")).distinct()
    lows = here.join(inside, "node").select(F.col("node").alias("root"), F.col("least").alias("low"))
    here = here.join(lows, "root", "left").select("node", F.coalesce("low", "root").alias("root"))
    return here.select("node", "root")


def reach(spark: SparkSession, edges: DataFrame, seeds: DataFrame, hops: int | None = None) -> DataFrame:
    """(node, depth) within `hops` of the seeds over undirected edges (a, b): one join and one anti join a hop; without hops, all that is reachable.

    Both directions are written once; each hop reads them again.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    seen = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    depth = 0
    while hops is None or depth < hops:
        depth += 1
        new = frontier.join(both, frontier["node"] == both["a"]).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = cut(new.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = cut(seen.union(frontier))
    return seen

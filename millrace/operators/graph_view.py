"""The graph as a maintained view of its log: order-dependent merges as validity intervals, deltas by touched keys.

Log rows: seq, idempotency_key, op, id, type, src, dst, ref, props map<string,string>, at.  Ops: create_node (id),
create_edge (src, dst, type), merge and unmerge (src: member, dst: canonical, ref), supersede (src: new, dst: old,
at), delete_node (id).  Rows of other ops are not read.

Nothing is replayed in order.  An edge is valid from its event to the first later event that ends it: the
deletion of an end, or an unmerge of its two ends that names its ref (an unmerge without ref ends all edges in
its direction, one with a ref those that are no merge too).  These first later events are interval joins; the state
of a member, whether a merge still holds, follows from the intervals at its last unmerge.

`advance` takes a state and a delta, log rows that come after it, to the next state: only the rows of nodes
that the delta names, and of the ends of their edges, change.  From an empty state it is the full replay.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.components import cut
from millrace.operators.graph import first_per_key
from millrace.operators.intervals import next_after, stab

OPS = ("create_node", "create_edge", "merge", "unmerge", "supersede", "delete_node")
#: Parts of a stored view.
PARTS = 64

NODES = "id string, label string, first_seq long, deleted_seq long, props map<string,string>, canonical_id string, merged boolean, merge_seq long, closed_at string"
#: An edge stands in the parts of both its ends: node is one of them.
EDGES = "node string, seq long, type string, src string, dst string, ref string, ended long"
REFUSED = "seq long, type string, src string, dst string, reason string"
KEYS = "idempotency_key string, seq long"


class View(NamedTuple):
    """nodes, edges (with the seq that ended them), refused edges, and the idempotency keys that were applied."""

    nodes: DataFrame
    edges: DataFrame
    refused: DataFrame
    keys: DataFrame

    def live_edges(self) -> DataFrame:
        """(seq, type, src, dst, ref) of edges that hold now."""
        return self.edges.where("ended is null and node = src").select("seq", "type", "src", "dst", "ref")

    def as_of(self, seq: int) -> DataFrame:
        """Edges that held right after an event."""
        return self.edges.where((F.col("node") == F.col("src")) & (F.col("seq") <= seq) & (F.col("ended").isNull() | (F.col("ended") > seq))).select("seq", "type", "src", "dst", "ref")


def empty(spark: SparkSession) -> View:
    return View(*(_no_rows(spark, ddl) for ddl in (NODES, EDGES, REFUSED, KEYS)))


def _no_rows(spark: SparkSession, ddl: str) -> DataFrame:
    """An empty table that Spark knows to be empty, so that joins with it fall away."""
    return spark.range(1).where("false").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(ddl)])


def merge_intervals(view: View) -> DataFrame:
    """(member, canonical, ref, seq, ended) of every merge that was valid: from its event to what ended it."""
    return view.edges.where("type = 'SAME_AS' and node = src").select(F.col("src").alias("member"), F.col("dst").alias("canonical"), "ref", "seq", "ended")


def _ended(edges: DataFrame, delta: DataFrame) -> DataFrame:
    """Edges, a row each, with `ended` set where it was not and the delta ends them."""
    gone = delta.where("op = 'delete_node'").select(F.col("id").alias("node"), F.col("seq").alias("s"))
    undone = delta.where("op = 'unmerge'").select("src", "dst", F.coalesce("ref", F.lit("")).alias("ref"), F.col("seq").alias("s"))
    named = undone.where("ref <> ''")
    # merges are ended by their own ref, other edges by any
    kind = F.when(F.col("type") == "SAME_AS", F.concat(F.lit("="), "ref")).otherwise("*")
    refs = named.withColumn("_kind", F.explode(F.array(F.concat(F.lit("="), "ref"), F.lit("*")))).drop("ref")
    rows = edges.where("ended is null").withColumn("t", F.col("seq")).withColumn("_kind", kind)
    for end in ("src", "dst"):
        rows = next_after(rows, gone.withColumnRenamed("node", end), [end], "t", "s", f"_{end}")
    rows = next_after(rows, undone.where("ref = ''").drop("ref"), ["src", "dst"], "t", "s", "_any")
    rows = next_after(rows, refs, ["src", "dst", "_kind"], "t", "s", "_ref")
    rows = rows.withColumn("ended", F.least("_src", "_dst", "_any", "_ref"))
    return rows.select(*edges.columns).unionByName(edges.where("ended is not null"))


def _edges(view: View, new: DataFrame, delta: DataFrame) -> DataFrame:
    """The edges of a view and new ones (seq, type, src, dst, ref) after a delta, in the parts of the ends that were read or are new."""
    flag = lambda end: (F.col("node") == F.col(end)).alias(f"at_{end}")
    names = ["seq", "type", "src", "dst", "ref"]
    new = new.select(*names, F.lit(True).alias("at_src"), F.lit(True).alias("at_dst"), F.lit(None).cast("long").alias("ended"))
    rows = view.edges.select(*names, flag("src"), flag("dst"), "ended").unionByName(new)
    rows = rows.groupBy(*names).agg(F.max("at_src").alias("at_src"), F.max("at_dst").alias("at_dst"), F.max("ended").alias("ended"))
    ends = F.array_distinct(F.array_compact(F.array(F.when(F.col("at_src"), F.col("src")), F.when(F.col("at_dst"), F.col("dst")))))
    return _ended(rows, delta).select(F.explode(ends).alias("node"), *names, "ended")


def _pointers(nodes: DataFrame, edges: DataFrame, delta: DataFrame) -> DataFrame:
    """(id, canonical_id, merged, merge_seq) of members that the delta merges or unmerges.

    The last valid merge gives the pointer.  The last unmerge after it clears it if none of the member's merges held
    right after; merges that held then are found by their intervals.
    """
    merges = edges.where("type = 'SAME_AS' and node = src").select(F.col("src").alias("member"), "dst", "seq", "ended")
    # only the first mention of a seq counts when a delta is applied again
    last = merges.join(delta.where("op = 'merge'").select("seq"), "seq", "left_semi").groupBy("member").agg(F.max_by("dst", "seq").alias("dst"), F.max("seq").alias("seq"))
    undone = delta.where("op = 'unmerge'").groupBy(F.col("src").alias("member")).agg(F.max("seq").alias("u"))
    rows = undone.join(last, "member", "full").join(nodes.select(F.col("id").alias("member"), "first_seq", F.col("canonical_id").alias("c0"), F.col("merged").alias("m0"), F.col("merge_seq").alias("s0")), "member")
    rows = rows.withColumn("u", F.when(F.col("u") > F.col("first_seq"), F.col("u")))
    at = F.coalesce("seq", "s0")
    held = stab(rows.where(F.col("u").isNotNull()).select("member", "u"), merges.select("member", F.col("seq").alias("from"), F.col("ended").alias("to")), ["member"], "u", "from", "to").select("member").distinct().withColumn("held", F.lit(True))
    rows = rows.join(held, "member", "left")
    cleared = F.col("u").isNotNull() & (at.isNull() | (F.col("u") > at)) & F.col("held").isNull()
    pointer = F.when(~cleared, F.coalesce("dst", "c0"))
    return rows.select(F.col("member").alias("id"), pointer.alias("canonical_id"), F.when(cleared, F.lit(False)).otherwise(F.when(F.col("dst").isNotNull(), F.lit(True)).otherwise(F.col("m0"))).alias("merged"), at.alias("merge_seq"))


def _merged_nodes(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Nodes with what the delta makes, renames and deletes; pointers as they were."""
    made = delta.where("op = 'create_node' and id is not null")
    new = made.groupBy("id").agg(F.min("seq").alias("n_seq"), F.min_by("type", "seq").alias("n_label"))
    props = made.select("id", "seq", F.explode("props").alias("k", "v")).groupBy("id", "k").agg(F.max_by("v", "seq").alias("v"))
    props = props.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("n_props"))  # keys of one node
    gone = delta.where("op = 'delete_node'").groupBy("id").agg(F.max("seq").alias("n_gone"))
    rows = old.join(new, "id", "full").join(props, "id", "left").join(gone, "id", "left")
    first = F.coalesce("first_seq", "n_seq")
    deleted = F.coalesce(F.when(F.col("n_gone") > first, F.col("n_gone")), F.col("deleted_seq"))
    none = F.create_map().cast("map<string,string>")
    both = F.map_concat(F.map_filter(F.coalesce("props", none), lambda k, v: ~F.map_contains_key(F.coalesce("n_props", none), k)), F.coalesce("n_props", none))
    label = F.when(deleted.isNotNull(), "Deleted").otherwise(F.coalesce("label", "n_label"))
    return rows.select("id", label.alias("label"), first.alias("first_seq"), deleted.alias("deleted_seq"), both.alias("props"), "canonical_id", "merged", "merge_seq", "closed_at")


class _Step(NamedTuple):
    """A delta without repeats, the nodes as it makes them, the edges that it asks for and all edges after it."""

    delta: DataFrame
    nodes: DataFrame
    asked: DataFrame
    edges: DataFrame


def _step(view: View, delta: DataFrame) -> _Step:
    delta = first_per_key(delta.where(F.col("op").isin(*OPS)))
    delta = cut(delta.join(view.keys.select("idempotency_key"), "idempotency_key", "left_anti"))
    nodes = cut(_merged_nodes(view.nodes, delta))
    known = nodes.select("id", "first_seq")
    asked = delta.where("op in ('create_edge', 'merge', 'supersede')")
    kind = F.when(F.col("op") == "merge", "SAME_AS").when(F.col("op") == "supersede", "SUPERSEDES").otherwise(F.col("type"))
    asked = asked.select("seq", "op", kind.alias("type"), "src", "dst", F.when(F.col("op") == "merge", F.coalesce("ref", F.lit(""))).alias("ref"), F.col("at").cast("string").alias("at"))
    ends = asked.join(known.toDF("src", "s_first"), "src", "left").join(known.toDF("dst", "d_first"), "dst", "left")
    stood = F.coalesce((F.col("s_first") < F.col("seq")) & (F.col("d_first") < F.col("seq")), F.lit(False))
    ends = cut(ends.withColumn("stood", stood))
    return _Step(delta, nodes, ends, cut(_edges(view, ends.where("stood"), delta)))


def merge_history(view: View, delta: DataFrame) -> DataFrame:
    """`merge_intervals` after a delta, without the pointers of its nodes."""
    return merge_intervals(view._replace(edges=_step(view, delta).edges))


def advance(view: View, delta: DataFrame) -> View:
    """The view after a delta.  view: at least the rows of all nodes that the delta names, with all their edges."""
    delta, nodes, ends, edges = _step(view, delta)
    good = ends.where("stood")
    bad = ends.where("not stood and op <> 'supersede'").select("seq", "type", "src", "dst", F.when(F.col("op") == "merge", "merge_missing_node").otherwise("dangling_ref").alias("reason"))
    pointers = _pointers(nodes, edges, delta)
    closed = good.where("op = 'supersede'").groupBy(F.col("dst").alias("id")).agg(F.max_by("at", "seq").alias("n_closed"))
    # pointers come under other names; a member without a row keeps what it had
    moved = pointers.select("id", F.col("canonical_id").alias("n_canonical"), F.col("merged").alias("n_merged"), F.col("merge_seq").alias("n_merge"), F.lit(True).alias("moved"))
    rows = nodes.join(moved, "id", "left").join(closed, "id", "left")
    pick = lambda new, old: F.when(F.col("moved"), F.col(new)).otherwise(F.col(old)).alias(old)
    nodes = rows.select("id", "label", "first_seq", "deleted_seq", "props", pick("n_canonical", "canonical_id"), pick("n_merged", "merged"), pick("n_merge", "merge_seq"), F.coalesce("n_closed", "closed_at").alias("closed_at"))
    keys = view.keys.unionByName(delta.select("idempotency_key", "seq")).dropDuplicates(["idempotency_key"])
    return View(cut(nodes), edges, view.refused.unionByName(bad).dropDuplicates(["seq"]), keys)


def part(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


_TABLES = {"nodes": (NODES, "id"), "edges": (EDGES, "node"), "refused": (REFUSED, "src"), "keys": (KEYS, "idempotency_key")}


def stored(spark: SparkSession, root: str, parts: dict[str, list[int]] | None = None) -> View:
    """A stored view, or only the named parts of each of its tables."""
    out = []
    for name, (ddl, key) in _TABLES.items():
        try:
            rows = spark.read.schema(f"{ddl}, part int").parquet(f"{root}/{name}").where(F.col(key).isNotNull())
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = _no_rows(spark, f"{ddl}, part int")
        out.append((rows.where(F.col("part").isin(parts[name])) if parts is not None else rows).drop("part"))
    return View(*out)


def _parts_of(rows: DataFrame) -> list[int]:
    """The parts that keys (key) stand in: at most PARTS numbers."""
    return sorted(r[0] for r in rows.where("key is not null").select(part(F.col("key"))).distinct().collect())


def touched(view: View, delta: DataFrame) -> dict[str, list[int]]:
    """The parts of each table that a delta can change.

    Nodes and edges: those of all named nodes, and of the other ends of edges of the nodes that it deletes.
    """
    named = delta.select(F.explode(F.array("id", "src", "dst")).alias("key"))
    first = _parts_of(named)
    gone = delta.where("op = 'delete_node'").select(F.col("id").alias("node")).distinct()
    others = view.edges.where(part(F.col("node")).isin(first)).join(gone, "node", "left_semi").select(F.when(F.col("src") == F.col("node"), F.col("dst")).otherwise(F.col("src")).alias("key"))
    of_edges = sorted({*first, *_parts_of(others)})
    return {"nodes": first, "edges": of_edges, "refused": _parts_of(delta.select(F.col("src").alias("key"))), "keys": _parts_of(delta.select(F.col("idempotency_key").alias("key")))}


def maintain(spark: SparkSession, root: str, delta: DataFrame) -> View:
    """Apply a delta to the view stored under a root; reads and rewrites the touched parts only.

    All rows are computed before the first is written, and the keys, by which a delta is known to be
    applied, are written last; an interrupted call is repeated with the same delta.  One writer at a time.
    """
    delta = cut(delta)
    # the other ends are looked up in the named nodes' own parts
    named = _parts_of(delta.select(F.explode(F.array("id", "src", "dst")).alias("key")))
    near = stored(spark, root, {"nodes": named, "edges": named, "refused": [], "keys": []})
    parts = touched(near, delta)
    after = advance(stored(spark, root, parts), delta)
    ready = {name: cut(df) for name, df in zip(_TABLES, after, strict=True)}
    for name, df in ready.items():
        ddl, key = _TABLES[name]
        marks = spark.createDataFrame([(k,) for k in parts[name]], "part int")
        # a row without a key stands in each touched part, so that a part that lost all its rows is rewritten too
        bare = marks.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields], "part")
        full = df.withColumn("part", part(F.col(key))).unionByName(bare)
        full.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{root}/{name}")
    return stored(spark, root)

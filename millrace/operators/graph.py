"""A property graph as tables: replay of an append-only log, reads, scope and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.components import reach, resolve_pointers
from millrace.operators.order import numbered

#: Log rows: seq, idempotency_key, op, id, type, from, to, member, canonical, ref, props, at.


def first_per_key(log: DataFrame) -> DataFrame:
    """The first event of each idempotency key; later ones are repeats."""
    w = Window.partitionBy("idempotency_key").orderBy("seq")
    return log.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def replay_nodes(log: DataFrame) -> DataFrame:
    """(id, label, props, first_seq, deleted): upserts merge properties, the last value of each wins."""
    made = log.where("op = 'create_node'")
    label = made.groupBy("id").agg(F.min("seq").alias("first_seq"), F.min_by("type", "seq").alias("label"))
    props = made.select("id", "seq", F.explode_outer("props").alias("k", "v")).where("k is not null").groupBy("id", "k").agg(F.max_by("v", "seq").alias("v"))
    props = props.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
    gone = log.where("op = 'delete_node'").groupBy("id").agg(F.max("seq").alias("deleted_seq"))
    rows = label.join(props, "id", "left").join(gone, "id", "left")
    return rows.select("id", F.when(F.col("deleted_seq") > F.col("first_seq"), "Deleted").otherwise(F.col("label")).alias("label"), "props", "first_seq", "deleted_seq")


def replay_edges(log: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose ends stood when they came, and those in quarantine; deletes drop what came before them."""
    made = log.where("op = 'create_edge'").select("seq", "type", F.col("from").alias("src"), F.col("to").alias("dst"))
    known = nodes.select(F.col("id"), "first_seq", "deleted_seq")
    ends = made.join(known.toDF("src", "s_first", "s_gone"), "src", "left").join(known.toDF("dst", "d_first", "d_gone"), "dst", "left")
    stood = F.coalesce((F.col("s_first") < F.col("seq")) & (F.col("d_first") < F.col("seq")), F.lit(False))
    cut = F.coalesce(F.col("s_gone") > F.col("seq"), F.lit(False)) | F.coalesce(F.col("d_gone") > F.col("seq"), F.lit(False))
    edges = ends.where(stood & ~cut).select("seq", "type", "src", "dst")
    return edges, ends.where(~stood).select("seq", "type", "src", "dst", F.lit("dangling_ref").alias("reason"))


def canonical_of(log: DataFrame) -> DataFrame:
    """(node, root) after merges and unmerges: the last event of each member and canonical decides."""
    last = log.where("op in ('merge', 'unmerge')").groupBy("member", "canonical").agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq")).where("op = 'merge'")
    return resolve_pointers(last.groupBy("member").agg(F.max_by("canonical", "seq").alias("target")).withColumnRenamed("member", "node"))


def equivalence_classes(log: DataFrame) -> DataFrame:
    return canonical_of(log).groupBy("root").agg(F.array_sort(F.collect_list("node")).alias("members"))


def supersede(assertions: DataFrame, log: DataFrame) -> DataFrame:
    """Close what later events supersede."""
    ends = log.where("op = 'supersede'").groupBy(F.col("id").alias("assertion_id")).agg(F.min("at").alias("closed_at"))
    return assertions.join(ends, "assertion_id", "left").withColumn("tx_to", F.coalesce("tx_to", "closed_at")).drop("closed_at")


def at_time(log: DataFrame, at: Column) -> DataFrame:
    """The log as far as it was written at a time; events without a time pass."""
    return log.where(F.col("at").isNull() | (F.col("at") <= at))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def neighbours(edges: DataFrame, node: Column | None = None) -> DataFrame:
    rows = both_ways(edges)
    return rows.where(F.col("src") == node).select("dst") if node is not None else rows


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree); each end counts, map-side sums first."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def merge_audit(log: DataFrame) -> DataFrame:
    """(member, canonical, resolution_ref, decided_by, seq, live): every merge, and whether no later unmerge took it back."""
    rows = log.where("op in ('merge', 'unmerge')")
    ended = rows.where("op = 'unmerge'").groupBy("member", "canonical").agg(F.max("seq").alias("undone"))
    by = F.coalesce(F.try_element_at("props", F.lit("decided_by")), F.lit("pipeline"))
    made = rows.where("op = 'merge'").select("member", "canonical", F.coalesce("ref", F.lit("")).alias("resolution_ref"), by.alias("decided_by"), "seq")
    live = F.col("undone").isNull() | (F.col("undone") < F.col("seq"))
    return made.join(ended, ["member", "canonical"], "left").withColumn("live", live).drop("undone")


def rollbacks(log: DataFrame, wrong: DataFrame) -> DataFrame:
    """The unmerge events that take back live merges of (member, resolution_ref); a merge that is not there gives none.

    They are numbered after the log's last event, in the order of the merges that they end.
    """
    found = merge_audit(log).where("live").join(wrong.select("member", "resolution_ref").distinct(), ["member", "resolution_ref"], "left_semi")
    last = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    rows = numbered(found, [F.asc("seq"), F.asc("member")], "_k").join(F.broadcast(last))  # one row
    return rows.select((F.col("last") + F.col("_k")).alias("seq"), F.lit("unmerge").alias("op"), "member", "canonical", F.col("resolution_ref").alias("ref"))


def supersede_edges(log: DataFrame) -> DataFrame:
    """The SUPERSEDES edge that each supersede event leaves: from the new version to the old one."""
    return log.where("op = 'supersede'").select("seq", F.lit("SUPERSEDES").alias("type"), F.col("new_id").alias("src"), F.col("id").alias("dst"))


def named_edges(edges: DataFrame) -> DataFrame:
    """Edges with their ids, numbered in the order of the log."""
    return numbered(edges, [F.asc("seq")], "_k").withColumn("edge_id", F.format_string("edge-%04d", "_k")).drop("_k")


def investigation(edges: DataFrame, classes: DataFrame, nodes: DataFrame, seed: Column, limit: int = 100, include: list[str] | None = None) -> DataFrame:
    """(part, src, dst, type, truncated): what is said about an entity and what bears on it.

    edges: (seq, src, dst, type).  classes: (node, root), entities folded into their representatives; nodes: (id,
    deleted).  Claims ABOUT any member of the seed's class come first in the log's order, at most `limit` of them,
    then evidence that SUPPORTS or CONTRADICTS these; the class shows as its representative.  truncated: more claims
    were there.
    """
    live = nodes.where(~F.coalesce("deleted", F.lit(False))).select(F.col("id"))
    rows = edges.where(F.col("type").isin(*include)) if include else edges
    root = classes.where(F.col("node") == seed).select("root").union(classes.sparkSession.range(1).select(seed.alias("root"))).limit(1)
    members = classes.join(root, "root", "left_semi").select("node").union(root.select(F.col("root").alias("node"))).distinct()
    about = rows.where("type = 'ABOUT'")
    sides = about.select("seq", "type", F.col("src").alias("node"), F.col("dst").alias("claim")).union(about.select("seq", "type", F.col("dst").alias("node"), F.col("src").alias("claim")))
    said = sides.join(members, "node", "left_semi").join(live.withColumnRenamed("id", "claim"), "claim", "left_semi").groupBy("claim").agg(F.min("seq").alias("seq"))
    more = said.orderBy("seq", "claim").limit(limit + 1)
    kept = more.orderBy("seq", "claim").limit(limit)
    full = more.agg((F.count("*") > limit).alias("truncated"))
    claims = kept.crossJoin(F.broadcast(root)).select(F.lit("claim").alias("part"), F.col("root").alias("src"), F.col("claim").alias("dst"), F.lit("ABOUT").alias("type"))  # limit rows, one root
    bears = rows.where("type in ('SUPPORTS', 'CONTRADICTS')")
    both = bears.select("seq", "type", F.col("src").alias("evidence"), F.col("dst").alias("claim")).union(bears.select("seq", "type", F.col("dst").alias("evidence"), F.col("src").alias("claim")))
    first = both.join(kept.select("claim"), "claim", "left_semi").join(live.withColumnRenamed("id", "evidence"), "evidence", "left_semi")
    first = first.groupBy("evidence").agg(F.min_by(F.struct("claim", "type"), F.struct("seq", "claim")).alias("x"))
    evidence = first.select(F.lit("evidence").alias("part"), F.col("evidence").alias("src"), F.col("x.claim").alias("dst"), F.col("x.type").alias("type"))
    return claims.union(evidence).crossJoin(F.broadcast(full))  # one row


def relation_paths(found: DataFrame) -> DataFrame:
    """Paths of an investigation as text: from/type/to."""
    return found.select(F.concat_ws("/", F.col("src").cast("string"), "type", F.col("dst").cast("string")).alias("path"))


def independence(assertions: DataFrame) -> DataFrame:
    """Per subject: evidence and independent sources over all assertions, and the share that repeats another."""
    rows = assertions.groupBy("subject_id").agg(F.sum("evidence").alias("evidence_count"), F.sum("independent").alias("independent_source_count"))
    ratio = F.when(F.col("evidence_count") > 0, F.round(1 - F.col("independent_source_count") / F.col("evidence_count"), 4)).otherwise(F.lit(0.0))
    return rows.withColumn("dedup_ratio", ratio)


def impact_ratio(spark: SparkSession, edges: DataFrame, seeds: DataFrame, hops: int | None, types: list[str] | None = None) -> DataFrame:
    """(nodes, touched, ratio): how much of the graph a change of the seeds touches."""
    everything = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().agg(F.count("*").alias("nodes"))
    return everything.crossJoin(impact(spark, edges, seeds, hops, types).agg(F.count("*").alias("touched"))).withColumn("ratio", F.coalesce(F.try_divide("touched", "nodes"), F.lit(0.0)))  # one row each


def partial_events(log: DataFrame, scope: DataFrame) -> DataFrame:
    """The events of the log that a recomputation of the scope has to replay: those that name a node in it."""
    names = F.array_compact(F.array(*[F.col(c).cast("string") for c in ("id", "from", "to", "member", "canonical") if c in log.columns]))
    hit = log.select("seq", F.explode(names).alias("node")).join(scope.select(F.col("node").cast("string").alias("node")), "node", "left_semi")
    return log.join(hit.select("seq").distinct(), "seq", "left_semi")


def as_of_claim(assertions: DataFrame, claim: Column, at: Column) -> DataFrame:
    """The first current assertion of a claim whose valid time holds the instant; open ends hold all."""
    held = (F.col("claim_id") == claim) & F.col("tx_to").isNull() & (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))
    return assertions.where(held).orderBy("tx_from", "assertion_id").limit(1)


def to_archive(tiers: DataFrame) -> DataFrame:
    """Cold nodes without live neighbours in the hot tier may go: (node) from (node, tier, hot_neighbours)."""
    return tiers.where("tier = 'cold' and hot_neighbours = 0").select("node")


def impact(spark: SparkSession, edges: DataFrame, seeds: DataFrame, hops: int | None, types: list[str] | None = None) -> DataFrame:
    rows = edges.where(F.col("type").isin(types)) if types else edges
    return reach(spark, rows.select(F.col("src").alias("a"), F.col("dst").alias("b")), seeds, hops)


def subgraph(edges: DataFrame, scope: DataFrame) -> DataFrame:
    """Edges with both ends in scope."""
    s = scope.select("node")
    return edges.join(s.withColumnRenamed("node", "src"), "src", "left_semi").join(s.withColumnRenamed("node", "dst"), "dst", "left_semi")


def temperature(last: Column, now: Column, window_s: int = 7 * 86400) -> Column:
    """hot, cold, or unknown where there was no access."""
    return F.when(last.isNull(), "unknown").when(F.unix_timestamp(now) - F.unix_timestamp(last) <= window_s, "hot").otherwise("cold")


def synthetic(spark: SparkSession, n: int, per_node: int = 3) -> tuple[DataFrame, DataFrame]:
    """A deterministic graph for load tests: n nodes, each linked to a few hashed others."""
    nodes = spark.range(n).select(F.format_string("n%d", "id").alias("id"))
    edges = spark.range(n * per_node).select(F.format_string("n%d", F.floor(F.col("id") / per_node)).alias("src"), F.format_string("n%d", F.pmod(F.xxhash64("id"), F.lit(n))).alias("dst"), F.lit("RELATED").alias("type"))
    return nodes, edges.where("src != dst")


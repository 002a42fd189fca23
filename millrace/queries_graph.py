"""Further named queries: the maintained graph, intervals, blocks of claims."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import claims, graph_view, intervals
from millrace.operators.components import cut, shared_folder
from millrace.queries import _CLAIMS_SQL, _claims, _t, query

#: Events as a graph log: sign-ups make users; views and most purchases link them; clicks merge a user into one of ten; errors undo merges; some purchases delete.
_LOG_SQL = """
l AS (SELECT event_id AS seq, CASE WHEN event_type = 'signup' THEN 'create_node' WHEN event_type = 'click' THEN 'merge' WHEN event_type = 'error' THEN 'unmerge'
    WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN 'delete_node' ELSE 'create_edge' END AS op,
  'u' || user_id AS u, CASE WHEN event_type IN ('click', 'error') THEN 'u' || (user_id % 10) ELSE 'u' || ((user_id + event_id) % 150) END AS dst,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE 'r' || (event_id % 3) END AS ref FROM events),
f AS (SELECT u AS id, min(seq) AS first_seq FROM l WHERE op = 'create_node' GROUP BY 1),
g AS (SELECT l.u AS id, l.seq FROM l JOIN f ON l.u = f.id WHERE op = 'delete_node' AND seq > first_seq),
e AS (SELECT seq, CASE WHEN op = 'merge' THEN 'SAME_AS' ELSE 'LINK' END AS type, u AS src, dst, CASE WHEN op = 'merge' THEN ref END AS ref FROM l JOIN f a ON u = a.id JOIN f b ON dst = b.id
  WHERE op IN ('merge', 'create_edge') AND a.first_seq < seq AND b.first_seq < seq),
n AS (SELECT u AS src, dst, ref, seq FROM l WHERE op = 'unmerge'),
c AS (SELECT e.seq, min(x) AS ended FROM e JOIN (SELECT e.seq, g.seq AS x FROM e JOIN g ON g.id IN (e.src, e.dst) AND g.seq > e.seq
    UNION ALL SELECT e.seq, n.seq FROM e JOIN n ON e.src = n.src AND e.dst = n.dst AND n.seq > e.seq AND (n.ref = '' OR e.ref IS NULL OR e.ref = n.ref)) z USING (seq) GROUP BY 1),
i AS (SELECT e.*, ended FROM e LEFT JOIN c USING (seq))
"""


def _log(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    op = F.when(kind == "signup", "create_node").when(kind == "click", "merge").when(kind == "error", "unmerge").when((kind == "purchase") & (F.col("event_id") % 7 == 0), "delete_node").otherwise("create_edge")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    other = F.concat(F.lit("u"), F.when(kind.isin("click", "error"), F.col("user_id") % 10).otherwise((F.col("user_id") + F.col("event_id")) % 150).cast("string"))
    ref = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")))
    alone = op.isin("create_node", "delete_node")
    rows = _t(spark, sf, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("idempotency_key"), op.alias("op"), F.when(alone, user).alias("id"), F.lit("LINK").alias("type"), F.when(~alone, user).alias("src"), F.when(~alone, other).alias("dst"), ref.alias("ref"))
    return rows.withColumn("props", F.create_map().cast("map<string,string>")).withColumn("at", F.lit(None).cast("string"))


@query(f"WITH {_LOG_SQL} SELECT src AS member, dst AS canonical, ref, seq, ended FROM i WHERE type = 'SAME_AS'")
def merge_validity(spark, sf):
    """From when to when each merge held, over the whole log."""
    return graph_view.merge_history(graph_view.empty(spark), _log(spark, sf))


@query(f"""WITH {_LOG_SQL},
m AS (SELECT src AS id, max(seq) AS m, arg_max(dst, seq) AS dst FROM i WHERE type = 'SAME_AS' GROUP BY 1),
u AS (SELECT n.src AS id, max(seq) AS u FROM n JOIN f ON n.src = f.id WHERE seq > first_seq GROUP BY 1),
h AS (SELECT DISTINCT u.id FROM u JOIN i ON i.src = u.id AND type = 'SAME_AS' AND i.seq <= u AND (ended IS NULL OR u < ended)),
k AS (SELECT src AS id, count(*) AS links FROM i WHERE ended IS NULL GROUP BY 1)
SELECT f.id, CASE WHEN f.id IN (SELECT id FROM g) THEN 'Deleted' ELSE 'LINK' END AS label, CASE WHEN u IS NULL OR u < m OR f.id IN (SELECT id FROM h) THEN m.dst END AS canonical_id, coalesce(links, 0) AS links
FROM f LEFT JOIN m USING (id) LEFT JOIN u USING (id) LEFT JOIN k USING (id)""")
def maintained_graph(spark, sf):
    """Nodes with where they point to and how many edges leave them, kept up to date through three deltas of the log."""
    log, root = cut(_log(spark, sf)), f"{shared_folder(spark)}/view-{uuid.uuid4().hex}"
    last = log.agg(F.max("seq")).first()[0]
    view = graph_view.empty(spark)
    for lo, hi in ((-1, last // 2), (last // 2, last - last // 10), (last - last // 10, last)) if last is not None else ():
        view = graph_view.maintain(spark, root, log.where((F.col("seq") > lo) & (F.col("seq") <= hi)))
    links = view.live_edges().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("links"))
    return view.nodes.join(links, "id", "left").select("id", "label", "canonical_id", F.coalesce("links", F.lit(0)).alias("links"))


@query("""SELECT p.event_id, v.version_id FROM (SELECT event_id, (user_id + 1) % 150 AS user_id, ts FROM events WHERE event_type = 'purchase') p
JOIN (SELECT event_id AS version_id, user_id, ts AS from_ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_ts FROM events) v ON p.user_id = v.user_id AND from_ts <= p.ts AND (to_ts IS NULL OR p.ts < to_ts)""")
def version_at_instant(spark, sf):
    """The version of one user that held when another bought: a join of instants with validity intervals."""
    from pyspark.sql import Window

    e = _t(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    versions = e.select(F.col("event_id").alias("version_id"), "user_id", intervals.micros(F.col("ts")).alias("from_us"), intervals.micros(F.lead("ts").over(w)).alias("to_us"))
    asked = e.where("event_type = 'purchase'").select("event_id", ((F.col("user_id") + 1) % 150).alias("user_id"), intervals.micros(F.col("ts")).alias("at_us"))
    return intervals.stab(asked, versions, ["user_id"], "at_us", "from_us", "to_us").select("event_id", "version_id")


@query("""WITH s AS (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS line, epoch_us(l_shipdate) AS lo, epoch_us(l_shipdate) + CAST(l_quantity AS BIGINT) * 86400000000 AS hi FROM lineitem)
SELECT a.line AS line_a, b.line AS line_b FROM s a JOIN s b ON a.l_partkey = b.l_partkey AND a.line < b.line AND a.lo < b.hi AND b.lo < a.hi""")
def overlapping_deliveries(spark, sf):
    """Lines of one part whose days of delivery overlap: a join of intervals with intervals."""
    start = intervals.micros(F.col("l_shipdate"))
    s = _t(spark, sf, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_a"), start.alias("lo_a"), (start + F.col("l_quantity").cast("long") * 86_400_000_000).alias("hi_a"))
    other = s.toDF("l_partkey", "line_b", "lo_b", "hi_b")
    return intervals.overlaps(s, other, ["l_partkey"], ("lo_a", "hi_a"), ("lo_b", "hi_b")).where("line_a < line_b").select("line_a", "line_b")


@query(f"""WITH c AS ({_CLAIMS_SQL}), p AS (SELECT a.subject_id, a.predicate, CASE WHEN a.polarity <> b.polarity THEN 'polarity' ELSE 'value' END AS kind FROM c a JOIN c b ON a.subject_id = b.subject_id AND a.predicate = b.predicate AND a.claim_id < b.claim_id WHERE a.polarity <> b.polarity OR a.object_id <> b.object_id),
n AS (SELECT subject_id, predicate, count(*) FILTER (WHERE kind = 'polarity') AS n_polarity, count(*) FILTER (WHERE kind = 'value') AS n_value FROM p GROUP BY ALL)
SELECT subject_id, predicate, count(*) AS n_claims, coalesce(any_value(n_polarity), 0) AS n_polarity, coalesce(any_value(n_value), 0) AS n_value FROM c LEFT JOIN n USING (subject_id, predicate) GROUP BY ALL""")
def conflict_summary(spark, sf):
    """How many conflicts each block of claims holds, without its pairs."""
    return claims.conflict_summary(_claims(spark, sf)).drop("polarity_pair", "value_pair")


@query(f"""WITH c AS ({_CLAIMS_SQL}), w AS (SELECT *, l_shipdate AS d FROM c), p AS (SELECT a.doc_id AS s, CASE WHEN a.polarity <> b.polarity THEN 'polarity' ELSE 'value' END AS kind FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.predicate = b.predicate AND a.claim_id < b.claim_id WHERE a.polarity <> b.polarity OR a.object_id <> b.object_id)
SELECT kind, count(*) AS n FROM p GROUP BY 1""")
def hot_conflicts(spark, sf):
    """Conflicts by kind where a block is all that a supplier's lines say: blocks of hundreds of claims."""
    from pyspark.sql import functions as F

    s = claims.conflict_summary(_claims(spark, sf).withColumn("subject_id", F.col("doc_id")))
    return s.agg(F.sum("n_polarity").alias("polarity"), F.sum("n_value").alias("value")).select(F.expr("stack(2, 'polarity', polarity, 'value', value) AS (kind, n)")).where("n > 0")

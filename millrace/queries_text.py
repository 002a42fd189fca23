"""Further named queries over texts: dictionaries of names, plans of questions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import dictionary, evidence, observed, postings
from millrace.operators.components import shared_folder
from millrace.plans import chain, investigation
from millrace.queries import _CHAIN_SQL, _SQL, RULES, _names, _t, query

#: Names of two words, as the benchmark's texts have them; a second word that begins the first would let a name overlap itself.
_PAIRS_SQL = """
w AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z]{2,}') AS ws FROM benchmark),
n AS (SELECT DISTINCT ws[i] || ' ' || ws[i + 1] AS surface FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM w) WHERE NOT starts_with(ws[i], ws[i + 1]))
"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    w = _t(spark, sf, "benchmark").select(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), 0).alias("ws"))
    pairs = w.select(F.explode(F.arrays_zip(F.slice("ws", 1, F.greatest(F.size("ws") - 1, F.lit(0))).alias("a"), F.slice("ws", 2, F.size("ws")).alias("b"))).alias("p"))
    return pairs.where("not startswith(p.a, p.b)").select(F.concat_ws(" ", "p.a", "p.b").alias("surface")).distinct()


@query(f"""WITH {_PAIRS_SQL},
p AS (SELECT doc_id, text, surface, i, len(parts) AS k, sum(len(part)) OVER (PARTITION BY doc_id, surface ORDER BY i) + (i - 1) * len(surface) AS s
  FROM (SELECT doc_id, text, surface, parts, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS part
    FROM (SELECT doc_id, text, surface, string_split(text, surface) AS parts FROM documents, n WHERE contains(text, surface))))
SELECT doc_id, surface, CAST(s AS BIGINT) AS start_at, CAST(s + len(surface) AS BIGINT) AS end_at FROM p
WHERE i < k AND NOT regexp_matches(substr(text, CAST(s AS BIGINT), 1), '^[\\p{{L}}\\p{{N}}]$') AND NOT regexp_matches(substr(text, CAST(s AS BIGINT) + len(surface) + 1, 1), '^[\\p{{L}}\\p{{N}}]$')""")
def dictionary_mentions(spark, sf):
    """Where names of two words stand in all documents as whole words."""
    found = dictionary.occurrences(_t(spark, sf, "documents").select("doc_id", "text"), _pairs(spark, sf))
    return found.select("doc_id", "surface", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"))


@query(f"""WITH {_PAIRS_SQL},
s AS (SELECT surface, 'e-' || surface AS entity_id FROM n UNION ALL SELECT regexp_extract(surface, '^[^ ]+'), 'e-' || surface FROM n WHERE strpos(surface, ' ') > 9),
q AS (SELECT conv_id * 1000 + turn AS question_id, trim(coalesce(text, ''), ' ') AS raw FROM conversations),
k AS (SELECT DISTINCT 'e-' || surface AS subject FROM n WHERE ascii(surface) % 2 = 0),
l AS MATERIALIZED (SELECT question_id, lower(raw) AS low FROM q),
c AS MATERIALIZED (SELECT question_id, surface, entity_id, low FROM l, s WHERE contains(low, lower(surface))),
m AS (SELECT DISTINCT question_id, surface, entity_id FROM c WHERE regexp_matches(low, '(^|[^a-z0-9])' || lower(surface) || '($|[^a-z0-9])')),
b AS (SELECT question_id, entity_id AS subject, arg_min(surface, (-len(surface), surface)) AS surface FROM m GROUP BY ALL),
h AS (SELECT question_id, list(upper(surface)) AS held FROM b GROUP BY 1),
r AS (SELECT q.question_id, held, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS subject FROM (SELECT question_id, raw, regexp_extract_all(raw, '[A-Z]{{2,}}') AS l FROM q) q LEFT JOIN h USING (question_id)),
f AS (SELECT question_id, subject, min(pos) AS pos FROM r WHERE NOT coalesce(list_bool_or(list_transform(held, lambda x: contains(x, subject))), false) GROUP BY ALL),
o AS (SELECT question_id, 0 AS part, -len(surface) AS pos, subject, surface FROM b UNION ALL SELECT question_id, 1, pos, subject, subject FROM f),
z AS (SELECT * FROM o UNION ALL SELECT question_id, 1, 1, '?subject', NULL FROM q WHERE question_id NOT IN (SELECT question_id FROM o))
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY part, pos, surface, z.subject) AS no, z.subject, surface, k.subject IS NOT NULL AS known,
  CASE WHEN k.subject IS NULL THEN 'insufficient_evidence' END AS gap_reason FROM z LEFT JOIN k USING (subject)""")
def question_subclaims(spark, sf):
    """What each turn of a conversation asks about: names of two words or, if long, by their first word."""
    pairs = _pairs(spark, sf)
    entity = F.concat(F.lit("e-"), "surface")
    alias = F.substring_index("surface", " ", 1)
    names = pairs.select("surface", entity.alias("entity_id")).union(pairs.where(F.length(alias) >= 9).select(alias, entity))
    known = pairs.where("ascii(surface) % 2 = 0").select(entity.alias("subject"))
    asked = _t(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))
    return evidence.plan_subclaims(asked, names, known).withColumn("no", F.col("no").cast("long"))


@query(_CHAIN_SQL + """SELECT 'mentions' AS stage, count(*) AS n_rows, 0 AS n_rejected, true AS passed FROM r UNION ALL SELECT 'resolved', count(*), 0, true FROM r
UNION ALL SELECT 'claims', count(*), 0, true FROM claims""")
def chain_report(spark, sf):
    """What a run of the chain says of itself: rows and rejects of each stage, from the metric table that it wrote."""
    path = f"{shared_folder(spark)}/metrics-{uuid.uuid4().hex}"
    run = observed.Run(spark, path, "chain")
    chain.run(_t(spark, sf, "documents"), _names(spark), RULES, run)
    run.flush()
    report = observed.phase_report(observed.read(spark, path), {"claims": ("reject_rate", 0.5)})
    return report.select("stage", F.col("rows").cast("long").alias("n_rows"), F.col("rejected").cast("long").alias("n_rejected"), "passed")


@query(_SQL["bm25_topk"])
def bm25_postings(spark, sf):
    """The rows of bm25_topk, from an index that is built once and read by terms and blocks."""
    index = postings.build(_t(spark, sf, "documents"), f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}")
    q = spark.createDataFrame([(1, "the tion and the"), (2, "der und sch")], "query_id int, query string")
    return postings.search(index, q).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _investigated(spark: SparkSession, sf: str) -> investigation.Investigation:
    pairs = _pairs(spark, sf)
    entity = F.concat(F.lit("e-"), "surface")
    alias = F.substring_index("surface", " ", 1)
    names = pairs.select("surface", entity.alias("entity_id")).union(pairs.where(F.length(alias) >= 9).select(alias, entity))
    held = pairs.where("ascii(surface) % 2 = 0").select(entity.alias("subject_id"), F.lit("located_in").alias("predicate"), F.lit(None).cast("string").alias("object_id"))
    asked = _t(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))
    index = postings.build(_t(spark, sf, "documents"), f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}")
    return investigation.run(asked, names, held, index)


@query(f"""SELECT question_id, count(*) AS planned, count(*) FILTER (WHERE NOT known) AS gaps, round(avg(CAST(known AS INTEGER)), 6) AS coverage,
CASE WHEN avg(CAST(known AS INTEGER)) >= 0.9 THEN 'coverage' ELSE 'no_new_evidence' END AS terminated_by FROM ({_SQL["question_subclaims"]}) GROUP BY 1""")
def investigation_outcomes(spark, sf):
    """How the investigation of each turn of a conversation ended."""
    return _investigated(spark, sf).outcome.withColumn("coverage", F.round("coverage", 6))

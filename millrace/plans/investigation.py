"""Investigations as one call, for many questions at once: plan, coverage, counter-evidence, retrieval for the gaps, and why they ended."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import evidence, postings
from millrace.operators.components import cut

#: The subject of a question that names none.
NOBODY = "?subject"


class Investigation(NamedTuple):
    """subclaims: (question_id, no, subject, surface, evidence, covered, gain); counter: hypotheses to search against the gaps;
    retrieved: (question_id, no, doc_id, score, rank) for the gaps; outcome: (question_id, planned, gaps, coverage, terminated_by)."""

    subclaims: DataFrame
    counter: DataFrame
    retrieved: DataFrame
    outcome: DataFrame


def run(questions: DataFrame, names: DataFrame, claims: DataFrame, index: postings.Index, budget: int = 8, threshold: float = 0.9, top: int = 5) -> Investigation:
    """questions: (question_id, question); names: (surface, entity_id); claims: (subject_id, predicate, object_id), the evidence there is.

    A run only reads, so it takes one step and no second one can add evidence: it ends by budget if one step spends it, by
    coverage if enough subclaims have evidence, else because nothing new can come.
    """
    n = claims.where("subject_id is not null").groupBy(F.col("subject_id").alias("subject")).agg(F.count("*").alias("evidence"))
    plan = evidence.plan_subclaims(questions, names, n.select("subject")).drop("known", "gap_reason")
    rows = cut(plan.join(n, "subject", "left").withColumn("evidence", F.coalesce("evidence", F.lit(0))).withColumn("covered", F.col("evidence") > 0))
    by = rows.groupBy("question_id").agg(F.count("*").alias("planned"), F.count_if(~F.col("covered")).alias("gaps"))
    rows = rows.join(by.select("question_id", "planned"), "question_id").withColumn("gain", F.when(F.col("covered"), 0.0).otherwise(1 / F.col("planned"))).drop("planned")
    gaps = rows.where(~F.col("covered") & (F.col("subject") != NOBODY))
    asked = gaps.select("question_id", "no", F.col("subject").alias("subject_id"), F.coalesce("surface", "subject").alias("predicate"), F.lit(None).cast("string").alias("object"))
    counter = evidence.hypotheses(asked.select("subject_id", "predicate", "object").distinct())
    # equal gaps of many questions are searched once
    queries = gaps.select(F.lower(F.coalesce("surface", "subject")).alias("query")).distinct()
    found = postings.search(index, queries.select(F.col("query").alias("query_id"), "query"), top)
    retrieved = gaps.select("question_id", "no", F.lower(F.coalesce("surface", "subject")).alias("query_id")).join(found, "query_id").drop("query_id")
    coverage = 1 - F.col("gaps") / F.col("planned")
    ended = F.when(F.lit(budget <= 1), "budget").when(coverage >= threshold, "coverage").otherwise("no_new_evidence")
    return Investigation(rows, counter, retrieved, by.withColumn("coverage", coverage).withColumn("terminated_by", ended))

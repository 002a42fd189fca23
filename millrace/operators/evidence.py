"""Evidence counts, confidence, conclusions, ranking and investigation helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import dictionary
from millrace.operators.claims import conflicts_of
from millrace.operators.components import dealt
from millrace.operators.order import numbered


def support(n: Column) -> Column:
    """1 - 1 / (n + 1)."""
    return F.lit(1.0) - F.lit(1.0) / (n + 1)


def confidence(claims: DataFrame, contradictions: DataFrame | None = None) -> DataFrame:
    """Per (subject_id, predicate, object_id): documents, independent roots and the confidence value.

    claims: with doc_id and root_doc_id (a missing root is the document itself).  contradictions:
    (subject_id, predicate, object_id, contradicting).
    """
    key = ["subject_id", "predicate", "object_id"]
    rows = claims.select(*key, F.col("doc_id").alias("_d"), F.coalesce("root_doc_id", "doc_id").alias("_r"))
    none = {c: F.lit(None).cast(rows.schema[c].dataType) for c in ("_d", "_r")}
    # documents and roots stand under each other, so that one exchange serves both counts
    sides = F.explode(F.array(F.struct("_d", none["_r"].alias("_r")), F.struct(none["_d"].alias("_d"), "_r")))
    rows = dealt(rows.select(*key, sides.alias("x")).select(*key, "x.*"), *key, rows=2 * claims.count())
    rows = rows.groupBy(*key, "_d", "_r").agg(F.lit(1)).groupBy(*key).agg(F.count("_d").alias("evidence"), F.count("_r").alias("independent"))
    rows = rows.join(contradictions, key, "left") if contradictions is not None else rows.withColumn("contradicting", F.lit(0).cast("long"))
    s, c = support(F.col("independent")), support(F.coalesce("contradicting", F.lit(0)))
    return rows.withColumn("contradicting", F.coalesce("contradicting", F.lit(0).cast("long"))).withColumn("support", s).withColumn("contradiction", c).withColumn("coverage", (F.col("evidence") > 0).cast("double")).withColumn("confidence", s * (1 - c))


def conclusions(assertions: DataFrame, low: float = 0.4) -> DataFrame:
    """Per subject: mean support, contradiction and confidence, coverage, and how many questions stay open."""
    return assertions.groupBy("subject_id").agg(
        F.avg("support").alias("support"), F.avg("contradiction").alias("contradiction"), F.avg("confidence").alias("value"), F.avg("coverage").alias("coverage"),
        F.sum("independent").alias("independent"), F.count("*").alias("assertions"), F.count_if((F.col("confidence") < low) | (F.col("evidence") == 0)).alias("open_questions"),
    )


def signal(value: Column, contradiction: Column, independent: Column, low: int = 1, high: float = 0.8) -> Column:
    return F.when(contradiction > 0.5, "contradicted").when(independent <= low, "low_evidence").when(value >= high, "high_confidence").otherwise("normal")


def ranked(conclusion: DataFrame, key: str = "subject_id") -> DataFrame:
    """Places by value, then independence, then key."""
    return numbered(conclusion, [F.desc("value"), F.desc("independent"), F.asc(key)])


def coverage(planned: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Planned keys with their evidence, whether they are covered, and the gain of closing the gap: 1 / planned, 0 where covered."""
    n = evidence.groupBy(key).agg(F.count("*").alias("evidence"))
    rows = planned.join(n, key, "left").withColumn("evidence", F.coalesce("evidence", F.lit(0)))
    planned_n = planned.agg(F.count("*").alias("_planned"))
    rows = rows.withColumn("covered", F.col("evidence") > 0).crossJoin(F.broadcast(planned_n))  # one row
    return rows.withColumn("gain", F.when(F.col("covered"), F.lit(0.0)).otherwise(1 / F.col("_planned"))).drop("_planned")


def stop_rule(covered: Column, new_rate: Column, unresolved: Column, steps: Column, budget: Column) -> Column:
    """(covered and little new and nothing unresolved) or budget spent."""
    return ((covered >= 0.9) & (new_rate <= 0.05) & (unresolved == 0)) | (steps >= budget)


def plan_entities(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(question_id, entity_id, surface): entities named in a question, each by its longest surface that stands there.

    questions: (question_id, question); names: (surface, entity_id), of several words too and any number
    of them.  Without case, between characters that are no ASCII letters or digits; surfaces of one
    character are no names.  Of equally long surfaces of an entity the least counts.
    """
    asked = questions.select(F.col("question_id").alias("doc_id"), F.col("question").alias("text"))
    found = dictionary.occurrences(asked, names.select("surface", "entity_id").where(F.length("surface") >= 2).distinct(), words="ascii", fold=True)
    best = F.min_by("surface", F.struct(-F.length("surface"), F.col("surface")))
    return found.groupBy(F.col("doc_id").alias("question_id"), "entity_id").agg(best.alias("surface"))


def plan_subclaims(questions: DataFrame, names: DataFrame, known: DataFrame) -> DataFrame:
    """(question_id, no, subject, surface, known, gap_reason): what a question is about.

    First the named entities, longest surface first; then runs of capitals that no matched surface
    holds; a question that is itself a known subject stands for itself if it has no such run; a
    question without any of these is about `?subject`.  known: (subject) that have evidence; others are gaps.
    """
    raw = F.trim(F.coalesce("question", F.lit("")))
    said = plan_entities(questions, names)
    held = said.groupBy("question_id").agg(F.collect_set(F.upper("surface")).alias("held"), F.collect_set("entity_id").alias("ids"))
    subjects = known.select(F.col("subject").alias("raw")).distinct().withColumn("itself", F.lit(True))
    asked = questions.select("question_id", raw.alias("raw")).join(subjects, "raw", "left").join(held, "question_id", "left")
    runs = F.array_distinct(F.regexp_extract_all("raw", F.lit("[A-Z]{2,}"), 0))
    runs = F.when((F.size(runs) == 0) & F.coalesce("itself", F.lit(False)), F.array("raw")).otherwise(runs)
    none = F.array().cast("array<string>")
    taken = lambda r: F.exists(F.coalesce("held", none), lambda h: F.contains(h, r)) | F.array_contains(F.coalesce("ids", none), r)
    more = asked.select("question_id", F.filter(runs, lambda r: ~taken(r)).alias("runs"), (F.size(F.coalesce("ids", none)) > 0).alias("named"))
    more = more.withColumn("runs", F.when((F.size("runs") == 0) & ~F.col("named"), F.array(F.lit("?subject"))).otherwise(F.col("runs")))
    more = more.select("question_id", F.posexplode("runs").alias("at", "subject"))
    first = said.select("question_id", F.lit(0).alias("part"), (-F.length("surface")).alias("at"), F.col("entity_id").alias("subject"), "surface")
    rest = more.select("question_id", F.lit(1).alias("part"), "at", "subject", F.when(F.col("subject") != "?subject", F.col("subject")).alias("surface"))
    no = F.row_number().over(Window.partitionBy("question_id").orderBy("part", "at", "surface", "subject"))
    rows = first.union(rest).withColumn("no", no).join(known.select("subject").distinct().withColumn("known", F.lit(True)), "subject", "left")
    is_known = F.coalesce("known", F.lit(False))
    return rows.select("question_id", "no", "subject", "surface", is_known.alias("known"), F.when(~is_known, "insufficient_evidence").alias("gap_reason"))


def trace(statements: DataFrame, claims: DataFrame, records: DataFrame) -> DataFrame:
    """Each statement's claim and first extraction record, and whether the trail is whole."""
    first = records.groupBy("claim_id").agg(F.min("record_id").alias("record_id"))
    rows = statements.join(claims.select("claim_id", "doc_id"), "claim_id", "left").join(first, "claim_id", "left")
    return rows.withColumn("linked", F.col("doc_id").isNotNull() & F.col("record_id").isNotNull())


def counter_evidence(claims: DataFrame, subject: Column) -> DataFrame:
    """Conflicts among the claims of a subject; claims of others are left out before any pair is made."""
    return conflicts_of(claims, subject)


def by_predicate(assertions: DataFrame) -> DataFrame:
    """Mean confidence and number of assertions of each subject's predicates."""
    return assertions.groupBy("subject_id", "predicate").agg(F.avg("confidence").alias("value"), F.count("*").alias("assertions"))


def open_questions(assertions: DataFrame, low: float = 0.4) -> DataFrame:
    """Assertions of low confidence or without evidence, the least certain first."""
    return assertions.where((F.col("confidence") < low) | (F.col("evidence") == 0)).orderBy("confidence", "subject_id", "predicate", "object_id")


def confidence_summary(assertions: DataFrame) -> DataFrame:
    """(n, least, most, median) of the confidence; the median is exact."""
    return assertions.agg(F.count("confidence").alias("n"), F.min("confidence").alias("least"), F.max("confidence").alias("most"), F.percentile("confidence", 0.5).alias("median"))


def run_outcome(covered: DataFrame, budget: int, threshold: float = 0.9, steps: int = 1) -> DataFrame:
    """(coverage, gaps, terminated_by) of a read-only run: budget if its steps are spent, coverage if enough is covered, else no_new_evidence."""
    rows = covered.agg(F.coalesce(F.avg(F.col("covered").cast("int")), F.lit(0.0)).alias("coverage"), F.count_if(~F.col("covered")).alias("gaps"))
    ended = F.when(F.lit(steps >= budget), "budget").when(F.col("coverage") >= threshold, "coverage").otherwise("no_new_evidence")
    return rows.withColumn("terminated_by", ended)


def hypotheses(subjects: DataFrame) -> DataFrame:
    """Counter-hypotheses and the searches for them, for each (subject_id, predicate, object)."""
    about = F.concat_ws(" ", "subject_id", "predicate", F.coalesce("object", F.lit("")))
    kinds = F.array(F.struct(F.lit("negation").alias("kind"), F.concat(F.lit("not "), about).alias("query")), F.struct(F.lit("alternative").alias("kind"), F.concat_ws(" ", "subject_id", "predicate", F.lit("other than"), F.coalesce("object", F.lit("any"))).alias("query")))
    return subjects.select("subject_id", "predicate", F.explode(kinds).alias("h")).select("subject_id", "predicate", "h.*")


def routed_tier(gain: Column, cost: Column) -> Column:
    """Which reader a step goes to, by its gain for its cost."""
    ratio = F.try_divide(gain, cost)
    return F.when(ratio.isNull(), "skip").when(ratio >= 1, "large").when(ratio >= 0.2, "small").otherwise("skip")


def linkage(traced: DataFrame) -> DataFrame:
    """Share of statements whose trail is whole; null where there are none."""
    return traced.agg(F.count("*").alias("statements"), F.avg(F.col("linked").cast("int")).alias("linked_share"))


def dashboard(coverage_rows: DataFrame, independent: Column) -> DataFrame:
    return coverage_rows.agg(F.count("*").alias("planned"), F.count_if("covered").alias("covered"), F.round(F.avg(F.col("covered").cast("int")), 4).alias("coverage"), F.sum(independent).alias("independent"))


def evidence_rows(claims: DataFrame, assertions: DataFrame, subject: Column, cap: int = 50) -> DataFrame:
    """The first claims of a subject that an assertion stands on; `cap` is the report's length."""
    rows = claims.where(F.col("subject_id") == subject).join(assertions.select("claim_id").distinct(), "claim_id", "left_semi")
    return rows.orderBy("claim_id").limit(cap)


def by_signal(ranked_rows: DataFrame) -> DataFrame:
    """Ranked conclusions group by group of their signal, each in the order of the ranking."""
    return ranked_rows.orderBy("signal", "position")

"""Golden-set evaluation, regression, promotion gates, service levels and migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.metrics import confusion


def same_group(pairs: DataFrame, membership: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Golden pairs with `said`: whether both ends are in one group.  membership: (element, group)."""
    one = membership.select(F.col("element").alias(a), F.col("group").alias("_ga"))
    two = membership.select(F.col("element").alias(b), F.col("group").alias("_gb"))
    rows = pairs.join(one, a, "left").join(two, b, "left")
    return rows.withColumn("said", F.coalesce(F.col("_ga") == F.col("_gb"), F.lit(False))).drop("_ga", "_gb")


def found_pair(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Golden pairs with `said`: whether the unordered pair was found."""
    key = lambda df: df.withColumn("_lo", F.least("a", "b")).withColumn("_hi", F.greatest("a", "b"))
    hit = key(found).select("_lo", "_hi").distinct().withColumn("said", F.lit(True))
    return key(pairs).join(hit, ["_lo", "_hi"], "left").withColumn("said", F.coalesce("said", F.lit(False))).drop("_lo", "_hi")


def report(pairs: DataFrame, truth: Column, said: Column, least_precision: float, least_recall: float) -> DataFrame:
    """Confusion with its gate; a gate without golden pairs passes, and says that nothing was measured."""
    rows = confusion(pairs, truth, said).withColumn("measured", F.col("tp") + F.col("fp") + F.col("fn") > 0)
    return rows.withColumn("passed", ~F.col("measured") | ((F.col("precision") >= least_precision) & (F.col("recall") >= least_recall)))


def promotion(current: DataFrame, baseline: DataFrame | None, major_bump: bool = False, tolerance: float = 0.0) -> DataFrame:
    """init, promote, keep or blocked for each metric against the active baseline."""
    rows = current.select("metric", "value").join(baseline.select("metric", F.col("value").alias("base")), "metric", "left") if baseline is not None else current.select("metric", "value", F.lit(None).cast("double").alias("base"))
    act = F.when(F.lit(major_bump), "blocked").when(F.col("base").isNull(), "init").when(F.col("value") >= F.col("base") - tolerance, "promote").otherwise("keep")
    return rows.withColumn("action", act)


def active_baseline(baselines: DataFrame) -> DataFrame:
    """The greatest active version of each metric."""
    return baselines.where("active").groupBy("metric").agg(F.max_by("value", "version").alias("value"), F.max("version").alias("version"))


def service_levels(observed: DataFrame, targets: DataFrame) -> DataFrame:
    """(slo, value, outcome): pass, fail or not_measured against (slo, bound, at_least)."""
    rows = targets.join(observed, "slo", "left")
    ok = F.when(F.col("at_least"), F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    return rows.withColumn("outcome", F.when(F.col("value").isNull(), "not_measured").when(ok, "pass").otherwise("fail"))


def error_budget(outcomes: DataFrame, allowed: float) -> DataFrame:
    """Share of failures among what was measured, and whether it is within the budget."""
    rows = outcomes.agg(F.count_if(F.col("outcome") != "not_measured").alias("measured"), F.count_if(F.col("outcome") == "fail").alias("failed"))
    share = F.coalesce(F.try_divide("failed", "measured"), F.lit(0.0))
    return rows.withColumn("failed_share", share).withColumn("within", share <= allowed)


def migration(elements: DataFrame, level: Column, known: list[str]) -> DataFrame:
    """What becomes of each element when the ontology changes: kept, re-gated, or quarantined if its predicate is gone."""
    act = F.when(~F.col("predicate").isin(known), "quarantine").when(level == "major", "backfill").when(level == "minor", "regate").otherwise("keep")
    return elements.withColumn("action", act)


def scale(per_doc_ms: float, docs: int, speed_up: float = 1.0, cost_per_doc: float = 0.0, batch_discount: float = 0.5) -> dict[str, float]:
    """Time and cost of so many documents."""
    return {"hours": per_doc_ms * docs / max(speed_up, 1e-9) / 3.6e6, "cost": cost_per_doc * docs, "batch_cost": cost_per_doc * docs * batch_discount}


def merge_results(parts: DataFrame, key: str, numbers: list[str], lists: list[str]) -> DataFrame:
    """Results of several nodes as one: numbers add, lists join."""
    return parts.groupBy(key).agg(*[F.sum(c).alias(c) for c in numbers], *[F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in lists])


def runs(metric_rows: DataFrame, names: list[str]) -> DataFrame:
    """One row for each run: when it began, and its metrics side by side."""
    return metric_rows.groupBy("run_id").agg(F.min("recorded_at").alias("began"), *[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])


def metrics_report(pairs: DataFrame, gates: dict[str, tuple[float, float]]) -> DataFrame:
    """(slice, measured, tp, fp, fn, precision, recall, f1, wrong_merge_rate, passed) of golden pairs (slice, truth, said).

    gates: least precision and recall by slice.  A slice without golden pairs is not measured and passes nothing.
    """
    spark = pairs.sparkSession
    want = spark.createDataFrame([(k, float(p), float(r)) for k, (p, r) in sorted(gates.items())], "slice string, p double, r double")
    tp, fp, fn = F.count_if(F.col("truth") & F.col("said")), F.count_if(~F.col("truth") & F.col("said")), F.count_if(F.col("truth") & ~F.col("said"))
    rows = want.join(pairs.groupBy("slice").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")), "slice", "left")
    zero = lambda a, b: F.when(F.col("tp").isNotNull(), F.coalesce(F.try_divide(a, b), F.lit(0.0)))
    rows = rows.withColumn("precision", zero(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", zero(F.col("tp"), F.col("tp") + F.col("fn")))
    rows = rows.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("wrong_merge_rate", zero(F.col("fp"), F.col("tp") + F.col("fp")))
    passed = F.when(F.col("tp").isNotNull(), (F.col("precision") >= F.col("p")) & (F.col("recall") >= F.col("r")))
    return rows.select("slice", F.col("tp").isNotNull().alias("measured"), "tp", "fp", "fn", "precision", "recall", "f1", "wrong_merge_rate", passed.alias("passed"))


# The quality axes of an investigation with their gates; the first four must pass.
AXES = {"coverage": 0.9, "citation_linkage": 1.0, "citation_support": 0.95, "modality": 0.95, "independent_evidence": 0.9, "counter_evidence_recall": 0.8, "confidence_sign": 0.9}
HARD_AXES = ("coverage", "citation_linkage", "citation_support", "modality")


def quality_axes(counts: DataFrame, gates: dict[str, float] | None = None) -> DataFrame:
    """(question_id, axis, measured, value, passed) from (question_id, axis, good, total); nothing counted is not measured."""
    want = gates or AXES
    gate = F.create_map(*[F.lit(x) for k, v in sorted(want.items()) for x in (k, float(v))])
    value = F.try_divide("good", "total")
    rows = counts.where(F.col("axis").isin(*want)).groupBy("question_id", "axis").agg(F.sum("good").alias("good"), F.sum("total").alias("total"))
    return rows.select("question_id", "axis", value.isNotNull().alias("measured"), value.alias("value"), (value >= gate[F.col("axis")]).alias("passed"))


def quality_report(axes: DataFrame, hard: tuple[str, ...] = HARD_AXES) -> DataFrame:
    """Per question: how many axes were measured, and whether every hard one that was has passed."""
    held = ~F.col("axis").isin(*hard) | ~F.col("measured") | F.coalesce("passed", F.lit(False))
    return axes.groupBy("question_id").agg(F.count_if("measured").alias("measured_axes"), F.every(held).alias("gates_all_pass"))


def rebuild_gate(full_s: Column, incremental_s: Column, least: float = 10.0) -> Column:
    """Whether an incremental update beats a rebuild by the least ratio; null where it was not measured."""
    return F.when(incremental_s > 0, full_s / incremental_s >= least)


def backfill_events(migrated: DataFrame, version: str) -> DataFrame:
    """An event for each element that a migration wants evaluated again."""
    key = F.concat_ws(":", F.lit("backfill"), F.lit(version), F.col("element_id").cast("string"))
    return migrated.where("action = 'backfill'").select(key.alias("idempotency_key"), F.lit("S5").alias("stage"), F.lit("backfill").alias("event_type"), "element_id")

"""One micro-batch of promotion with its failures kept apart: a bad row never stops the others.

Every row is judged once: an envelope that breaks the contract, or a document with a defect, goes to quarantine and
the rest is promoted together.  If promotion itself fails, for a reason that is no row's, all that were to
be promoted go to retry with one more attempt, or to the dead letters at the last.  What became of each row is
written in one job, as a folder of the batch that a repeated batch replaces; Spark's checkpoint counts the
offsets as done after that, so rows are promoted at least once, and once only if the promotion is idempotent.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import ids
from millrace.operators.components import cut
from millrace.operators.filters import envelope_reasons
from millrace.operators.observed import Run
from millrace.streaming.promotion import ENVELOPE

#: Characters of an error that travel.
MOST_ERROR = 2048


def judged(batch: DataFrame, defect: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """The batch with `error`: why a row is not to be promoted, null if it is.

    defect: a column that says what is wrong with a row's document; it is asked only of envelopes that are valid.
    """
    wrong = F.array_join(envelope_reasons(batch), ",")
    own = defect(batch) if defect is not None else F.lit(None).cast("string")
    return batch.withColumn("error", F.when(wrong != "", wrong).otherwise(own))


def outcomes(rows: DataFrame, failure: str | None = None, retries: int = 3) -> DataFrame:
    """Envelopes with route and error for judged rows: quarantine for bad ones; the others are completed or, after a failure, retried until `retries` attempts."""
    bad = F.col("error").isNotNull()
    attempt = F.coalesce("attempt_count", F.lit(0)) + 1
    if failure is None:
        route, status, kind, stage, count = F.lit("primary"), F.lit("succeeded"), F.lit("normalization_completed"), F.lit("S3"), F.lit(0)
    else:
        route = F.when(attempt < retries, "retry").otherwise("dlq")
        status, kind, stage, count = F.when(attempt < retries, "retrying").otherwise("failed"), F.lit("raw_stored"), F.lit("S2"), attempt
    route = F.when(bad, "quarantine").otherwise(route)
    kind = F.when(bad, "raw_event_quarantined").otherwise(kind)
    error = F.left(F.when(bad, F.col("error")).otherwise(F.lit(failure)), F.lit(MOST_ERROR))
    count = F.when(bad, F.coalesce("attempt_count", F.lit(0))).otherwise(count).cast("int")
    name = F.when(route.isin("retry", "dlq"), F.concat(kind, F.lit("_"), route, F.lit("_"), count.cast("string"))).otherwise(kind)
    return rows.select(
        ids.typed_id("evt", name, F.col("idempotency_key"), sep=":").alias("event_id"), F.when(bad, "S2").otherwise(stage).alias("stage"), kind.alias("event_type"),
        F.when(bad, "quarantined").otherwise(status).alias("status"), "idempotency_key", count.alias("attempt_count"), "occurred_at", "payload", route.alias("route"), error.alias("error"),
    )


def consumer(root: str, promote: Callable[[DataFrame, int], None], defect: Callable[[DataFrame], Column] | None = None, retries: int = 3, metrics: Run | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: promotes what is sound, once each, and writes every row's outcome under root/batch=.../route=..."""

    def run(batch: DataFrame, number: int) -> None:
        start = time.monotonic()
        rows = cut(judged(batch, defect))  # judged once; promotion and outcomes read the same rows
        failure = None
        try:
            promote(rows.where("error is null").drop("error").dropDuplicates(["idempotency_key"]), number)
        except Exception as e:  # whatever it was, it is no row's fault: all of them try again
            failure = str(e) or type(e).__name__
        outcomes(rows, failure, retries).write.mode("overwrite").partitionBy("route").parquet(f"{root}/batch={number}")
        if metrics is not None and failure is None:
            n = rows.where("error is null").count()
            metrics.add("promotion_documents", n, batch=str(number))
            metrics.add("promotion_elapsed_s", time.monotonic() - start, batch=str(number))
            metrics.flush()

    return run


def routed(spark: SparkSession, root: str, *routes: str) -> DataFrame:
    """The outcomes of some routes (all without any), with their batch."""
    rows = spark.read.schema(f"{ENVELOPE}, error string, batch long, route string").parquet(root)
    return rows.where(F.col("route").isin(*routes)) if routes else rows

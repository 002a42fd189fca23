"""Metrics that runs report of themselves: counts observed in passing, seconds, and a table that they are appended to.

Rows are counted while they pass (`DataFrame.observe`), so no second pass is made.  What goes wrong with a metric
never fails the run: it is counted, and the run goes on.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from millrace.operators.components import cut

METRIC = "metric_id string, run_id string, job_id string, metric string, value double, labels map<string,string>, recorded_at timestamp"


class Run:
    """One run's metrics, flushed to a table under a path (Parquet, append only)."""

    def __init__(self, spark: SparkSession, path: str, job_id: str, run_id: str | None = None):
        self.spark, self.path, self.job_id = spark, path, job_id
        self.run_id, self.rows, self.failed = run_id or f"run-{uuid.uuid4().hex[:12]}", [], 0

    def add(self, metric: str, value: float | None, **labels: str) -> None:
        if value is not None:
            self.rows.append((f"met-{uuid.uuid4().hex}", self.run_id, self.job_id, metric, float(value), labels, dt.datetime.now(dt.UTC).replace(tzinfo=None)))

    def stage(self, name: str, df: DataFrame, rejected: Column | None = None) -> DataFrame:
        """The stage's rows, written once to the shared folder; rows, rejects and seconds are added as they pass."""
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        counts = [F.count(F.lit(1)).alias("rows"), F.count(F.when(rejected, 1)).alias("rejected")] if rejected is not None else [F.count(F.lit(1)).alias("rows")]
        start = time.monotonic()
        out = cut(df.observe(seen, *counts))
        took = time.monotonic() - start
        try:
            got = seen.get
            self.add("stage_rows", got["rows"], stage=name)
            self.add("stage_rejected", got.get("rejected", 0), stage=name)
            self.add("stage_seconds", took, stage=name)
        except Exception:
            self.failed += 1
        return out

    def flush(self) -> bool:
        """Append what has been added since the last flush; False if that failed, in which case it is kept for the next."""
        try:
            self.add("metrics_failed", self.failed)
            self.spark.createDataFrame(self.rows, METRIC).coalesce(1).write.mode("append").parquet(self.path)
            self.rows = []
            return True
        except Exception:
            self.failed += 1
            return False


class StreamMetrics(StreamingQueryListener):
    """Adds each micro-batch's rows and duration to a run and flushes it."""

    def __init__(self, run: Run):
        self.run = run

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        try:
            p = event.progress
            labels = {"query": p.name or str(p.id), "batch": str(p.batchId)}
            self.run.add("batch_rows", p.numInputRows, **labels)
            self.run.add("batch_ms", p.batchDuration, **labels)
            for name, row in p.observedMetrics.items():
                for metric, value in row.asDict().items():
                    self.run.add(f"{name}.{metric}", value, **labels)
            self.run.flush()
        except Exception:
            self.run.failed += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.run.flush()


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC).parquet(path)


def phase_report(metrics: DataFrame, gates: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """(run_id, stage, rows, rejected, seconds, reject_rate, passed) of a metric table.

    gates: stage -> (measure, most): the stage passes if the measure is at most that; a stage without a gate passes,
    a gate whose measure is missing does not.
    """
    stage = F.col("labels")["stage"]
    rows = metrics.where(F.col("metric").isin("stage_rows", "stage_rejected", "stage_seconds")).groupBy("run_id", stage.alias("stage"))
    pick = lambda m: F.max_by(F.when(F.col("metric") == m, F.col("value")), F.when(F.col("metric") == m, F.col("recorded_at"))).alias(m.removeprefix("stage_"))
    out = rows.agg(pick("stage_rows"), pick("stage_rejected"), pick("stage_seconds")).withColumn("reject_rate", F.round(F.try_divide("rejected", "rows"), 6))
    passed = F.lit(True)
    for name, (measure, most) in (gates or {}).items():
        passed = F.when(F.col("stage") == name, F.coalesce(F.col(measure) <= most, F.lit(False))).otherwise(passed)
    return out.withColumn("passed", passed)

"""Structured Streaming: envelopes, routing, idempotent promotion, dwell, alerts and windows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.filters import ROUTES, STAGES, VERSION, envelope_reasons

ENVELOPE = "event_id string, stage string, event_type string, status string, idempotency_key string, attempt_count int, occurred_at timestamp, payload string"


def topics(prefix: str = "events") -> list[str]:
    """A topic for each stage and route; the primary one bears the stage's name alone."""
    names = [f"{prefix}.{s.lower()}.{slug}.v{VERSION}" for s, slug in STAGES.items()]
    return [n if r == "primary" else f"{n}.{r}" for n in names for r in ROUTES]


def encode(envelopes: DataFrame) -> DataFrame:
    return envelopes.select(F.col("idempotency_key").alias("key"), F.to_json(F.struct(*envelopes.columns)).alias("value"))


def decode(messages: DataFrame) -> DataFrame:
    return messages.select("key", F.from_json("value", ENVELOPE).alias("e")).select("key", "e.*")


def routed(envelopes: DataFrame, retries: int = 3) -> DataFrame:
    """Envelopes with their route: invalid ones to quarantine, failed ones to retry and then to the dead letters."""
    bad = F.size(envelope_reasons(envelopes)) > 0
    failed = F.col("status") == "failed"
    route = F.when(bad, "quarantine").when(failed & (F.col("attempt_count") >= retries), "dlq").when(failed, "retry").otherwise("primary")
    return envelopes.withColumn("route", route)


def promote(key: str, path: str, parts: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: rows whose key the table lacks are appended, so that a repeated batch changes nothing.

    The table is kept in `parts` folders by a hash of the key; a batch reads the keys of its own folders only.
    """

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key]).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            touched = [r["_part"] for r in rows.select("_part").distinct().collect()]  # at most `parts`
            rows = rows.join(spark.read.schema(rows.schema).parquet(path).where(F.col("_part").isin(touched)).select(key), key, "left_anti")
        rows.write.mode("append").partitionBy("_part").parquet(path)

    return run


def file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 25) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Work through what there is and stop; offsets are committed after the sink."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_until_quiet(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, linger_s: float = 60.0, quiet_polls: int = 30) -> None:
    """Collect for `linger_s` before each batch, and stop after so many polls in a row that brought nothing."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(linger_s * 1000)} milliseconds").start()
    quiet, last = 0, None
    while quiet < quiet_polls and q.isActive:
        q.awaitTermination(max(1, round(linger_s)))
        now = q.lastProgress
        moved = now is not None and now["batchId"] != last and now["numInputRows"] > 0
        quiet, last = (0, now["batchId"]) if moved else (quiet + 1, last)
    if q.exception():
        raise q.exception()
    q.stop()


def distinct_events(stream: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, at: str, width: str, late: str = "1 hour", *keys: Column | str) -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, at: str, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))


def dwell(stream: DataFrame, key: str, at: str, kind: str, enter: str, leave: str) -> DataFrame:
    """(key, entered, left_at) as exits come; a re-entry and an orphan exit count for nothing."""

    def run(k: tuple, frames, state: GroupState):
        since = state.get[0] if state.exists else None
        out = []
        rows = pd.concat(list(frames)).sort_values(at)
        for t, what in zip(rows[at], rows[kind], strict=True):
            if what == enter and since is None:
                since = t
            elif what == leave and since is not None:
                out.append((str(k[0]), since, t))
                since = None
        if since is not None:
            state.update((since,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "entered", "left_at"])

    return stream.groupBy(key).applyInPandasWithState(run, "key string, entered timestamp, left_at timestamp", "since timestamp", "append", GroupStateTimeout.NoTimeout)


def fire_once(stream: DataFrame, key: Column, at: str, late: str = "30 days") -> DataFrame:
    return stream.withColumn("dedup_key", key).withWatermark(at, late).dropDuplicatesWithinWatermark(["dedup_key"])


def jumps(changes: DataFrame, least: float = 0.1) -> DataFrame:
    """Confidence changes that are large enough for an alert."""
    return changes.where(F.abs(F.col("after") - F.col("before")) >= least)


def alerts(events: DataFrame, watched: DataFrame, changes: DataFrame | None = None, least: float = 0.1) -> DataFrame:
    """(investigation_id, trigger, target, dedup_key): the alerts of a batch of log events, each once.

    events: (op, type, from, to, id, props).  watched: (investigation_id, target).  changes: (target, before, after,
    independent_before, independent_after) of the targets.  Triggers: a new CONTRADICTS edge to the target; a
    SUPERSEDES edge from or to it; a node of the target that is confirmed; more independent sources than before;
    a confidence that moved by `least` or more.
    """
    edge, kind = F.col("op") == "create_edge", F.col("type")
    ends = F.array(F.struct(F.col("to").alias("target"), F.when(kind == "CONTRADICTS", "contradicting_evidence").when(kind == "SUPERSEDES", "claim_changed").alias("trigger")),
                   F.struct(F.col("from").alias("target"), F.when(kind == "SUPERSEDES", "claim_changed").alias("trigger")))
    found = events.where(edge).select(F.explode(ends).alias("x")).select("x.target", "x.trigger")
    done = (F.col("op") == "create_node") & (F.try_element_at("props", F.lit("status")) == "confirmed")
    found = found.union(events.where(done).select(F.col("id").alias("target"), F.lit("plan_to_execution").alias("trigger")))
    if changes is not None:
        moved = F.array_compact(F.array(F.when(F.col("independent_after") > F.col("independent_before"), "new_independent_source"), F.when(F.abs(F.col("after") - F.col("before")) >= least, "confidence_threshold")))
        found = found.union(changes.select("target", F.explode(moved).alias("trigger")))
    rows = found.where("trigger is not null").distinct().join(watched, "target")
    return rows.select("investigation_id", "trigger", "target", F.concat_ws(":", "investigation_id", "trigger", "target").alias("dedup_key")).distinct()


def cadence(density: Column, high: float = 0.5, low: float = 0.1) -> Column:
    """How often a source is worth a visit: high, normal or low; normal where nothing was measured."""
    return F.when(density.isNull(), "normal").when(density >= high, "high").when(density < low, "low").otherwise("normal")


def adaptive_schedule(sources: DataFrame, now: Column, base_s: int = 3600) -> DataFrame:
    """(source, priority, interval_s, lag_s, overdue): half the base interval for high priority, four times for low.

    sources: (source, density, last).  A source that was never visited has no lag and is not overdue.
    """
    rows = sources.withColumn("priority", cadence(F.col("density")))
    interval = F.when(F.col("priority") == "high", base_s // 2).when(F.col("priority") == "low", base_s * 4).otherwise(base_s)
    lag = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp("last"))
    return rows.withColumn("interval_s", interval).withColumn("lag_s", lag).select("source", "priority", "interval_s", "lag_s", F.coalesce(F.col("lag_s") > F.col("interval_s"), F.lit(False)).alias("overdue"))


def outbox_add(box: DataFrame, refs: DataFrame) -> DataFrame:
    """The outbox with references that it lacks, by (source_id, doc_id); both stages of new ones are open."""
    new = refs.dropDuplicates(["source_id", "doc_id"]).join(box.select("source_id", "doc_id"), ["source_id", "doc_id"], "left_anti")
    return box.unionByName(new.withColumn("s1_acked", F.lit(False)).withColumn("s2_acked", F.lit(False)).select(*box.columns))


def outbox_pending(box: DataFrame, limit: int = 1000) -> DataFrame:
    """The next events to publish, in the order of (source_id, doc_id, stage), of at most `limit` references."""
    rows = box.where(~(F.col("s1_acked") & F.col("s2_acked"))).orderBy("source_id", "doc_id").limit(limit)
    stages = F.array(F.struct(F.lit("S1").alias("stage"), F.lit("document_fetched").alias("event_type"), ~F.col("s1_acked")), F.struct(F.lit("S2").alias("stage"), F.lit("raw_stored").alias("event_type"), ~F.col("s2_acked")))
    rows = rows.select("source_id", "doc_id", "url", F.explode(F.filter(stages, lambda s: s["col3"])).alias("s"))
    ref = F.concat(F.lit("raw://"), "source_id", F.lit("/"), "doc_id")
    return rows.select("source_id", "doc_id", "s.stage", "s.event_type", F.col("url").alias("input_ref"), ref.alias("output_ref")).orderBy("source_id", "doc_id", "stage")


def outbox_ack(box: DataFrame, sent: DataFrame) -> DataFrame:
    """The outbox after the broker took (source_id, doc_id, stage); what it did not take stays open."""
    got = sent.groupBy("source_id", "doc_id").agg(F.max(F.col("stage") == "S1").alias("a"), F.max(F.col("stage") == "S2").alias("b"))
    rows = box.join(got, ["source_id", "doc_id"], "left")
    yes = lambda c, x: (F.col(c) | F.coalesce(x, F.lit(False))).alias(c)
    return rows.select(*[yes("s1_acked", "a") if c == "s1_acked" else yes("s2_acked", "b") if c == "s2_acked" else F.col(c) for c in box.columns])


def freshness(now: Column, last: Column, expected_s: int) -> Column:
    lag = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(last))
    return F.struct(lag.alias("lag_s"), (lag > expected_s).alias("overdue"))

"""A batch with a bad row promotes the others; failures of the whole end in the dead letters at the third attempt."""

from pyspark.sql import functions as F

from millrace.operators import observed
from millrace.streaming import consume, promotion


def envelopes(spark, rows):
    return spark.createDataFrame([(f"e{k}", stage, "raw_stored", "succeeded", f"k{k}", attempt, payload) for k, stage, attempt, payload in rows], "event_id string, stage string, event_type string, status string, idempotency_key string, attempt_count int, payload string").withColumn("occurred_at", F.lit("2024-01-01").cast("timestamp")).select("event_id", "stage", "event_type", "status", "idempotency_key", "attempt_count", "occurred_at", "payload")


def stream(spark, path):
    return promotion.file_stream(spark, path, promotion.ENVELOPE)


def drain(df, sink, ck):
    q = df.writeStream.foreachBatch(sink).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


def test_a_bad_row_does_not_stop_the_others(spark, tmp_path):
    src, out, done = f"{tmp_path}/in", f"file://{tmp_path}/out", []
    envelopes(spark, [(1, "S2", 0, "{}"), (2, "nope", 0, "{}"), (3, "S2", 0, '{"broken": true}'), (4, "S2", 0, "{}"), (5, "S2", -1, "{}")]).coalesce(1).write.parquet(src)
    defect = lambda b: F.when(F.get_json_object("payload", "$.broken") == "true", "document is broken")
    run = observed.Run(spark, f"file://{tmp_path}/m", "promotion")
    sink = consume.consumer(out, lambda rows, n: done.extend(sorted(r["idempotency_key"] for r in rows.collect())), defect, metrics=run)
    drain(stream(spark, src), sink, f"{tmp_path}/ck")
    assert done == ["k1", "k4"]
    got = {r["idempotency_key"]: (r["route"], r["status"], r["error"]) for r in consume.routed(spark, out).collect()}
    assert got == {"k1": ("primary", "succeeded", None), "k4": ("primary", "succeeded", None), "k3": ("quarantine", "quarantined", "document is broken"), "k2": ("quarantine", "quarantined", "unknown_stage"), "k5": ("quarantine", "quarantined", "bad_attempt_count")}
    assert observed.read(spark, run.path).where("metric = 'promotion_documents'").first()["value"] == 2.0
    # the same batch once more replaces what it wrote
    sink(spark.read.schema(promotion.ENVELOPE).parquet(src), 0)
    assert consume.routed(spark, out).count() == 5


def test_failures_end_in_the_dead_letters_at_the_third_attempt(spark, tmp_path):
    src = f"{tmp_path}/in0"
    envelopes(spark, [(1, "S2", 0, "{}"), (2, "S2", 0, "{}"), (3, "nope", 0, "{}")]).coalesce(1).write.parquet(src)

    def fails(rows, number):
        raise OSError("the store is away")

    seen = []
    for k in range(3):
        out = f"file://{tmp_path}/out{k}"
        drain(stream(spark, src), consume.consumer(out, fails), f"{tmp_path}/ck{k}")
        rows = consume.routed(spark, out, "retry", "dlq")
        seen.append(sorted((r["idempotency_key"], r["route"], r["attempt_count"], r["error"]) for r in rows.collect()))
        src = f"{tmp_path}/in{k + 1}"
        rows.drop("route", "error", "batch").coalesce(1).write.parquet(src)
    text = "the store is away"
    assert seen == [[("k1", "retry", 1, text), ("k2", "retry", 1, text)], [("k1", "retry", 2, text), ("k2", "retry", 2, text)], [("k1", "dlq", 3, text), ("k2", "dlq", 3, text)]]
    # a retry that works is completed
    good = []
    drain(stream(spark, f"{tmp_path}/in1"), consume.consumer(f"file://{tmp_path}/again", lambda rows, n: good.append(rows.count())), f"{tmp_path}/ck9")
    assert good == [2] and {r["route"] for r in consume.routed(spark, f"file://{tmp_path}/again").collect()} == {"primary"}
    assert consume.routed(spark, f"file://{tmp_path}/again", "dlq").count() == 0

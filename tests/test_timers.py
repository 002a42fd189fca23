"""Streams with timers, stopped and started again from their checkpoints."""

import pytest
from pyspark.sql import functions as F

from millrace.streaming import timers

SCHEMA = "k string, kind string, at timestamp"


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    timers.use_rocksdb(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def feed(spark, path, rows):
    spark.createDataFrame(rows, "k string, kind string, s long").select("k", "kind", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(path)


def step(df, out, ck):
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


def test_an_alert_fires_once_whatever_the_gap(rocksdb, tmp_path):
    spark, src, out, ck = rocksdb, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck"
    day = 86_400
    for batch in ([("a", "x", 100), ("a", "x", 50), ("b", "x", 70)], [("a", "x", 400 * day), ("c", "x", 401 * day)], [("b", "x", 900 * day)]):
        feed(spark, src, batch)
        step(timers.fire_once(spark.readStream.schema(SCHEMA).parquet(src), F.col("k"), "at"), out, ck)  # a new query from the checkpoint
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [("a", 50_000_000), ("b", 70_000_000), ("c", 401 * day * 1_000_000)]


def test_dwell_ends_or_expires_across_restarts(rocksdb, tmp_path):
    spark, src, out, ck = rocksdb, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck"
    batches = (
        [("a", "in", 10), ("b", "in", 20), ("c", "out", 5), ("a", "in", 12)],
        [("a", "out", 40), ("d", "in", 35), ("a", "in", 45)],  # before the watermark has passed them
        [("z", "in", 5_000)],
        [("a", "out", 4_990), ("z", "out", 5_100)],
        [("y", "out", 20_000)],
    )
    for batch in batches:
        feed(spark, src, batch)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        step(timers.dwell(stream, "k", "at", "kind", "in", "out", most_s=1000, late="100 seconds"), out, ck)
    got = sorted((r["key"], int(r["entered"].timestamp()), int(r["ended"].timestamp()), r["outcome"]) for r in spark.read.parquet(out).collect())
    assert got == [("a", 10, 40, "left"), ("a", 45, 1045, "expired"), ("b", 20, 1020, "expired"), ("d", 35, 1035, "expired"), ("z", 5000, 5100, "left")]

"""Observed metrics, their failure, a stream's listener, and exact order statistics without a sort."""

import random
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import observed, order


def test_stages_report_rows_rejects_and_seconds(spark, tmp_path):
    run = observed.Run(spark, f"file://{tmp_path}/m", "job", "run-1")
    out = run.stage("a", spark.range(100).repartition(3), F.col("id") % 10 == 0)
    assert out.count() == 100 and run.flush()
    run.stage("b", spark.range(0))
    assert run.flush() and run.failed == 0
    got = {r["stage"]: (r["rows"], r["rejected"], r["reject_rate"], r["passed"]) for r in observed.phase_report(observed.read(spark, f"file://{tmp_path}/m"), {"a": ("reject_rate", 0.05), "b": ("rows", 5)}).collect()}
    assert got == {"a": (100.0, 10.0, 0.1, False), "b": (0.0, 0.0, None, True)}


def test_a_sink_that_fails_does_not_fail_the_run(spark, tmp_path):
    (tmp_path / "file").write_text("no folder")
    run = observed.Run(spark, f"file://{tmp_path}/file", "job")
    assert run.stage("a", spark.range(5)).count() == 5
    assert not run.flush() and run.failed == 1 and run.rows
    run.path = f"file://{tmp_path}/later"
    assert run.flush() and observed.read(spark, run.path).where("metric = 'stage_rows'").first()["value"] == 5.0


def test_a_stream_reports_its_batches(spark, tmp_path):
    spark.range(7).write.parquet(f"{tmp_path}/in")
    run = observed.Run(spark, f"file://{tmp_path}/m", "stream")
    listener = observed.StreamMetrics(run)
    spark.streams.addListener(listener)
    try:
        rows = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").observe("seen", F.max("id").alias("most"))
        q = rows.writeStream.format("noop").queryName("q").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(120)
        for _ in range(100):
            if (tmp_path / "m").exists() and observed.read(spark, run.path).where("metric = 'batch_rows'").count():
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    got = {r["metric"]: r["value"] for r in observed.read(spark, run.path).where("labels['query'] = 'q' and labels['batch'] = '0'").collect()}
    assert got["batch_rows"] == 7.0 and got["seen.most"] == 6.0 and run.failed == 0


@pytest.mark.parametrize("kind", ["long", "double"])
def test_places_of_sorted_values(spark, kind):
    r = random.Random(8)
    value = (lambda: r.choice([0, 0, 0, 5, r.randint(-9, 9), r.randint(-(10**15), 10**15)])) if kind == "long" else (lambda: r.choice([0.0, 1e-300, -1e300, 1e300, r.gauss(0, 1), r.gauss(0, 1e9)]))
    rows = [(r.choice(["a", "b", None]), r.choice([1, 2]), r.choice([None, value(), value(), value()])) for _ in range(500)] + [("empty", 1, None), ("one", 1, value())]
    df = spark.createDataFrame(rows, f"g string, h int, v {kind}")
    groups = {}
    for g, h, v in rows:
        if v is not None:
            groups.setdefault((g, h), []).append(v)
    for place, pick in ((F.floor(F.col("n") / 2), lambda v: sorted(v)[len(v) // 2]), (F.floor(F.lit(0.95) * (F.col("n") - 1)), lambda v: sorted(v)[int(0.95 * (len(v) - 1))])):
        got = {(x["g"], x["h"]): (x["at"], x["n"]) for x in order.at_place(df, ["g", "h"], "v", place, "at", buckets=8).collect()}
        assert got == {k: (pick(v), len(v)) for k, v in groups.items()}
    assert order.at_place(df, [], "v", F.lit(0), "least").first()["least"] == min(v for x in groups.values() for v in x)

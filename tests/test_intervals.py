"""Interval joins against all pairs."""

import random

import pytest

from millrace.operators import intervals


def plans(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("seed", range(2))
def test_points_and_spans_meet_as_in_all_pairs(spark, seed):
    r = random.Random(seed)
    edge = lambda: r.choice([r.randint(-50, 50), r.randint(-5, 5), r.randint(-(10**12), 10**12), 1 << 20, -(1 << 20)])
    points = [(k, r.choice([1, 2, None]), r.choice([None, edge(), edge(), edge()])) for k in range(150)]
    spans = []
    for k in range(150):
        lo = edge()
        spans.append((k, r.choice([1, 2, None]), r.choice([lo, lo, lo, None]), r.choice([None, lo, lo + 1, lo + r.randint(0, 100), lo + r.randint(0, 10**12)])))
    p = spark.createDataFrame(points, "p long, key int, t long")
    s = spark.createDataFrame(spans, "s long, key int, lo long, hi long")
    joined = intervals.stab(p, s, ["key"], "t", "lo", "hi")
    got = sorted((x["p"], x["s"]) for x in joined.collect())
    inf = float("inf")
    assert got == sorted((a, b) for a, k, t in points for b, j, lo, hi in spans if k is not None and k == j and t is not None and lo is not None and lo <= t < (inf if hi is None else hi))
    assert "NestedLoop" not in plans(joined) and "Cartesian" not in plans(joined)
    two = s.toDF("s2", "key", "lo2", "hi2")
    got = sorted((x["s"], x["s2"]) for x in intervals.overlaps(s, two, ["key"], ("lo", "hi"), ("lo2", "hi2")).collect())
    end = lambda lo, hi: inf if hi is None else hi
    real = [(i, k, lo, end(lo, hi)) for i, k, lo, hi in spans if k is not None and lo is not None and end(lo, hi) > lo]
    assert got == sorted((a, b) for a, k, l1, h1 in real for b, j, l2, h2 in real if k == j and l1 < h2 and l2 < h1)


def test_next_event(spark):
    r = random.Random(3)
    points = [(k, r.randint(0, 3), r.randint(0, 40)) for k in range(120)]
    events = [(r.randint(0, 3), r.randint(0, 40)) for _ in range(40)]
    p, e = spark.createDataFrame(points, "p long, key int, t long"), spark.createDataFrame(events, "key int, s long")
    got = sorted((x["p"], x["after"]) for x in intervals.next_after(p, e, ["key"], "t", "s", "after").collect())
    assert got == sorted((k, min((s for j, s in events if j == key and s > t), default=None)) for k, key, t in points)
    assert intervals.next_after(p, e.where("false"), ["key"], "t", "s", "after").where("after is not null").count() == 0


def test_next_event_takes_a_point_over_once(spark, monkeypatch):
    """Whatever the levels of the stretches between events: a point is one row of the pass, and a hot key is divided."""
    monkeypatch.setattr(intervals, "BINS", 8)
    r = random.Random(4)
    points = [(k, r.choice([1, 1, 1, 2, None]), r.choice([None, *range(0, 5000, 7)])) for k in range(300)]
    events = [(r.choice([1, 2, None]), r.randint(-50, 1 << r.randint(1, 14))) for _ in range(60)]
    p, e = spark.createDataFrame(points, "p long, key int, t long"), spark.createDataFrame(events, "key int, s long")
    got = intervals.next_after(p, e, ["key"], "t", "s", "after")
    assert "Generate" not in plans(got) and "Join" not in plans(got)
    want = [(k, None if key is None or t is None else min((s for j, s in events if j == key and s > t), default=None)) for k, key, t in points]
    assert sorted(((x["p"], x["after"]) for x in got.collect()), key=str) == sorted(want, key=str)

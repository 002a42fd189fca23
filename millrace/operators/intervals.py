"""Joins of points with intervals and of intervals with each other, as equi-joins.

An interval [lo, hi) of whole numbers stands in one or two bins of the level whose bins are as wide as
it is long, rounded up to a power of two; a point stands in one bin of every level that occurs.  So
points and intervals meet by (keys, level, bin), and the exact test drops what merely shares a bin,
which is a bounded share: a bin is less than twice as long as its intervals.  Long and open intervals
stand in coarse bins and are not cut into many.  A hot key is divided among its bins, and what is
still hot is a plain join that adaptive execution splits.

Null points and intervals without a beginning or length meet nothing; hi null: open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Open intervals end here; places are below it and above its negative.
OPEN = 1 << 61


def micros(t: Column) -> Column:
    """A time as a place."""
    return F.unix_micros(t.cast("timestamp"))


def stab(points: DataFrame, spans: DataFrame, keys: list[str], t: str, lo: str, hi: str) -> DataFrame:
    """Rows of both for every point in a span: equal keys (nulls meet nothing) and lo <= t < hi; other columns must differ in name.

    One pass over the spans finds the levels that occur, at most 63.
    """
    end = F.coalesce(F.col(hi), F.lit(OPEN))
    long = end - F.col(lo)
    level = F.when(long == 1, 0).otherwise(F.length(F.bin(long - 1)))
    cut = spans.where(F.col(lo).isNotNull() & (long > 0)).withColumn("_level", level)
    levels = sorted(r[0] for r in cut.select("_level").distinct().collect())
    shift = lambda x: F.call_function("shiftright", x, F.col("_level"))
    cut = cut.withColumn("_bin", F.explode(F.array_distinct(F.array(shift(F.col(lo)), shift(end - 1)))))
    asked = points.where(F.col(t).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bin", shift(F.col(t)))
    met = asked.join(cut, [*keys, "_level", "_bin"])
    return met.where((F.col(lo) <= F.col(t)) & (F.col(t) < F.coalesce(F.col(hi), F.lit(OPEN)))).drop("_level", "_bin")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str]) -> DataFrame:
    """Rows of both for every two spans that share a place, each pair once.

    Of two spans that overlap, either b's begins within a's, or a's begins within b's and not with it.
    """
    one = stab(b, a, keys, b_span[0], *a_span)
    two = stab(a, b, keys, a_span[0], *b_span).where(F.col(a_span[0]) != F.col(b_span[0]))
    held = lambda x, other, span: x.where((F.col(span[0]) < F.coalesce(F.col(span[1]), F.lit(OPEN))))
    return held(one, a, b_span).unionByName(held(two, b, a_span))


#: Bins over the range of all events, by which a hot key of `next_after` is divided.
BINS = 1 << 10


def next_after(points: DataFrame, events: DataFrame, keys: list[str], t: str, s: str, name: str) -> DataFrame:
    """Points with the first event of their keys after t, null if there is none.

    points: rows with (keys, t), a row for each wanted answer; equal (keys, t) get equal answers.
    events: (keys, s).  Points and events of a key meet in bins and are passed from the last place to the first, so that
    a point travels once.  A bin that holds points begins with the first event of later bins: that table has at most BINS
    rows a key.
    """
    from pyspark.sql import Window

    events = events.select(*keys, F.col(s).cast("long").alias("_at")).where(" and ".join(f"`{c}` is not null" for c in (*keys, "_at")))
    lo, hi = events.agg(F.min("_at"), F.max("_at")).first()
    shift = max(0, ((hi or 0) - (lo or 0)).bit_length() - BINS.bit_length() + 1)
    binned = lambda x: x.withColumn("_bin", F.shiftright(F.col("_at"), shift))
    events = binned(events)
    asked = binned(points.select(*keys, F.col(t).cast("long").alias("_at"), F.struct("*").alias("_row")))
    none = F.lit(None).cast("long")
    firsts = events.groupBy(*keys, "_bin").agg(F.min("_at").alias("_first"))
    cells = firsts.unionByName(asked.where("_bin is not null").select(*keys, "_bin", none.alias("_first")))
    cells = cells.groupBy(*keys, "_bin").agg(F.min("_first").alias("_first"))
    later = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(1, Window.unboundedFollowing)
    carried = cells.select(*keys, "_bin", F.min("_first").over(later).alias("_at")).where("_at is not null")
    marks = events.unionByName(carried.select(*keys, "_at", "_bin")).withColumn("_event", F.col("_at")).withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType))
    # of equal places the points come first: an event at a point is not after it
    down = Window.partitionBy(*keys, "_bin").orderBy(F.desc("_at"), F.col("_event").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = marks.unionByName(asked.withColumn("_event", none)).withColumn("_next", F.last("_event", True).over(down))
    return met.where("_row is not null").select("_row.*", F.col("_next").alias(name))

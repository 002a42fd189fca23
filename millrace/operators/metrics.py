"""Rates, dwell, freshness, budgets, golden-set metrics and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drill_down(df: DataFrame, keys: list[Column | str], measures: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(m).alias(f"sum_{m}") for m in measures], F.count("*").alias("n"))


def known_rate(ok: Column) -> Column:
    """Share of true among the known, to 4 digits; null if none is known."""
    return F.round(F.avg(ok.cast("int")), 4)


def dwell(entries: DataFrame, key: str, at: str, kind: str, enter: str, leave: str) -> DataFrame:
    """(key, entered, dwell_s): each entry with the exit that follows; re-entries and orphan exits do not count."""
    w = Window.partitionBy(key).orderBy(at)
    rows = entries.where(F.col(kind).isin(enter, leave)).withColumn("before", F.lag(kind).over(w))
    rows = rows.where(F.col("before").isNull() | (F.col("before") != F.col(kind)))
    w2 = Window.partitionBy(key).orderBy(at)
    rows = rows.withColumn("left_at", F.lead(at).over(w2)).where(F.col(kind) == enter)
    return rows.select(key, F.col(at).alias("entered"), (F.unix_micros("left_at") - F.unix_micros(at)).alias("dwell_us"))


def upper_median(values: Column) -> Column:
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def hourly(df: DataFrame, at: str, end: Column, hours: int = 24) -> DataFrame:
    """Counts of the last hours before end, with zeros for empty ones."""
    grid = df.sparkSession.range(hours).select((F.date_trunc("hour", end) - F.make_dt_interval(hours=F.col("id").cast("int"))).alias("hour"))
    n = df.groupBy(F.date_trunc("hour", F.col(at)).alias("hour")).agg(F.count("*").alias("n"))
    return grid.join(n, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def density(docs: Column, signals: Column) -> Column:
    """Signals per document; null where nothing was measured."""
    return F.try_divide(signals.cast("double"), F.nullif(docs.cast("double"), F.lit(0.0)))


def allocate(sources: DataFrame, budget: float) -> DataFrame:
    """Floors first, the surplus by density; uniform if nothing is measured; floors scaled if they exceed the budget.

    sources: (source, density, floor); a source without density keeps its floor.
    """
    everything = Window.partitionBy()
    floors = F.sum("floor").over(everything)
    d = F.greatest(F.col("density"), F.lit(0.0))
    total = F.sum(F.coalesce(d, F.lit(0.0))).over(everything)
    measured, n = F.count("density").over(everything), F.count("*").over(everything)
    surplus = F.lit(float(budget)) - floors
    share = F.when(measured == 0, surplus / n).when(total > 0, surplus * F.coalesce(d, F.lit(0.0)) / total).otherwise(F.when(F.col("density").isNotNull(), surplus / measured).otherwise(F.lit(0.0)))
    return sources.withColumn("allocated", F.round(F.when(floors >= budget, F.col("floor") * budget / floors).otherwise(F.col("floor") + share), 3))


def rolling_rate(df: DataFrame, day: str, ok: Column, days: int = 7) -> DataFrame:
    """Pass rate of each day and of the days up to it."""
    daily = df.groupBy(F.to_date(day).alias("day")).agg(F.count_if(ok).alias("passed"), F.count("*").alias("total"))
    w = Window.orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)  # one row a day
    return daily.select("day", "passed", "total", F.round(F.sum("passed").over(w) / F.sum("total").over(w), 6).alias("rolling_rate"))


def confusion(pairs: DataFrame, truth: Column, said: Column) -> DataFrame:
    """True and false positives and false negatives, with precision, recall and F1 (0 where undefined)."""
    tp, fp, fn = F.count_if(truth & said), F.count_if(~truth & said), F.count_if(truth & ~said)
    rows = pairs.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return rows.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def regression(baseline: DataFrame, current: DataFrame, tolerance_pp: float = 2.0) -> DataFrame:
    """(metric, before, after, delta_pp, regressed); a missing metric counts as 0."""
    rows = baseline.select("metric", F.col("value").alias("before")).join(current.select("metric", F.col("value").alias("after")), "metric", "full_outer")
    rows = rows.select("metric", F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(0.0)).alias("after"))
    return rows.withColumn("delta_pp", F.round((F.col("after") - F.col("before")) * 100, 6)).withColumn("regressed", F.col("delta_pp") < -tolerance_pp)


def next_commit(at_s: Column, interval_s: int) -> Column:
    """Seconds to the next commit boundary."""
    return F.greatest(F.lit(1), F.ceil(at_s / interval_s)) * interval_s - at_s


def fire_once(alerts: DataFrame, key: Column, at: str) -> DataFrame:
    """The first alert of each key; later ones are silent whatever their size."""
    w = Window.partitionBy("dedup_key").orderBy(at)
    return alerts.withColumn("dedup_key", key).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def lag(end: Column, committed: Column) -> Column:
    return F.sum(F.greatest(F.lit(0), end - F.greatest(F.lit(0), committed)))


def slo(value: Column, bound: float, at_least: bool = True) -> Column:
    """pass, fail, or not_measured for null."""
    ok = value >= bound if at_least else value <= bound
    return F.when(value.isNull(), "not_measured").when(ok, "pass").otherwise("fail")


def governance(fetches: DataFrame, source: str, at: str, *first: str) -> DataFrame:
    """(source, latest, n, ...): each source's last fetch, and the columns `first` as its earliest fetch had them."""
    return fetches.groupBy(source).agg(F.max(at).alias("latest"), F.count("*").alias("n"), *[F.min_by(c, at).alias(f"first_{c}") for c in first])


def overview(claims: DataFrame) -> DataFrame:
    """(kind, name, n): claims by predicate, and how many are in quarantine."""
    by = claims.groupBy(F.lit("predicate").alias("kind"), F.col("predicate").alias("name")).agg(F.count("*").alias("n"))
    return by.union(claims.agg(F.lit("status"), F.lit("quarantined"), F.count_if(F.col("status") == "quarantined")))


def first_of_groups(df: DataFrame, group: str, key: str, firsts: int = 5, least: int = 2, groups: int = 20) -> DataFrame:
    """(group, n, keys): groups of `least` rows or more, the first `groups` of them, each with its `firsts` least keys."""
    n = df.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(group).limit(groups)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(key))
    few = df.join(n.select(group), group, "left_semi").withColumn("_rn", rank).where(F.col("_rn") <= firsts)
    return n.join(few.groupBy(group).agg(F.array_sort(F.collect_list(key)).alias("keys")), group)


def age_minutes(now: Column, at: Column) -> Column:
    return F.round((F.unix_micros(now) - F.unix_micros(at)) / 60e6, 1)

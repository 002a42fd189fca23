"""Global order without a single task: range partitions, their sizes, and places within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.components import cut


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Rows with their place, from 1, in a total order.

    The rows are written once in range partitions, each with its partition's number: sizes and places are read
    from those files, so both come from the same partitions however their plans differ.  Each partition numbers
    its own rows; partitions start after the sizes of those before, a table of one row for each partition.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_p", "_base")
    rows = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order))).join(F.broadcast(base), "_p")
    return rows.withColumn(name, (F.col("_r") + F.col("_base")).cast("long")).drop("_p", "_r", "_base")


def round_robin(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Rows dealt to k shards in turn."""
    return numbered(df, order, "_at").withColumn("shard", F.pmod(F.col("_at") - 1, F.lit(k)).cast("int")).drop("_at")


def at_place(df: DataFrame, keys: list[str], value: str, place: Column, name: str, buckets: int = 256) -> DataFrame:
    """For each group the value at a place (from 0) of its sorted values, nulls and NaN left out; place may use the group's size `n`.

    Nothing is sorted.  Equal values are counted first, where they stand.  Each round lays a histogram of so many
    buckets over the range that holds a group's wanted value and keeps the bucket that it falls into, until that bucket
    is one value: the counts combine before they travel, so neither a hot group nor a hot value meets in
    a task, and a group costs `buckets` numbers a round.  A round always divides: least and greatest value differ in bucket.
    """
    usable = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    cells = cut(df.where(usable).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c")))
    mine = [F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]
    own = [f"_{i}" for i in range(len(keys))]
    same = lambda: [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)] or [F.lit(True)]
    state = cells.groupBy(*keys).agg(F.sum("_c").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    state = cut(state.select(*mine, "n", "_lo", "_hi", place.cast("long").alias("_want")).where((F.col("_want") >= 0) & (F.col("_want") < F.col("n"))))
    while state.where("_lo < _hi").limit(1).count():
        inside = cells.join(state, same()).where((F.col("_lo") < F.col("_hi")) & (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        lo, hi, v = (F.col(c).cast("double") for c in ("_lo", "_hi", "_v"))
        share = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
        bucket = F.when(F.col("_v") == F.col("_lo"), 0).when(F.col("_v") == F.col("_hi"), buckets - 1).otherwise(F.greatest(F.lit(0), F.least(F.floor(share * buckets), F.lit(buckets - 1))))
        bars = inside.groupBy(*own, "n", "_want", bucket.alias("_b")).agg(F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.coalesce(F.sum("_c").over(Window.partitionBy(*own).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most `buckets` rows
        left = bars.withColumn("_at", F.col("_want") - before).where((F.col("_at") >= 0) & (F.col("_at") < F.col("_c")))
        state = cut(state.where("_lo = _hi").unionByName(left.select(*own, "n", "_lo", "_hi", F.col("_at").alias("_want"))))
    return state.select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], F.col("_lo").alias(name), "n")

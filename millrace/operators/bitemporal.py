"""As-of reads on two time axes, versions, chronicle and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(at: Column, start: str, end: str) -> Column:
    """start <= at < end; a null end is open, and so is a null start."""
    return (F.col(start).isNull() | (F.col(start) <= at)) & (F.col(end).isNull() | (at < F.col(end)))


def as_of(df: DataFrame, valid_at: Column | None = None, tx_at: Column | None = None) -> DataFrame:
    """Rows valid at one time and known at another; without tx_at those not closed."""
    out = df.where(within(valid_at, "valid_from", "valid_to")) if valid_at is not None else df
    return out.where(F.col("tx_to").isNull()) if tx_at is None else out.where((F.col("tx_from") <= tx_at) & (F.col("tx_to").isNull() | (tx_at < F.col("tx_to"))))


def versions(events: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Each event as a version that the next one of its key closes."""
    w = Window.partitionBy(key).orderBy(at, tie)
    return events.withColumn("tx_from", F.col(at)).withColumn("tx_to", F.lead(at).over(w)).withColumn("supersedes", F.lag(tie).over(w))


def chronicle(df: DataFrame, key: str) -> DataFrame:
    """(at, id, kind): asserted, closed and superseded events of versions."""
    kinds = F.array(
        F.struct(F.col("tx_from").alias("at"), F.lit("asserted").alias("kind")),
        F.struct(F.col("tx_to").alias("at"), F.lit("closed").alias("kind")),
        F.struct(F.when(F.col("supersedes").isNotNull(), F.col("tx_from")).alias("at"), F.lit("superseded").alias("kind")),
    )
    return df.select(F.col(key).alias("id"), F.explode(F.filter(kinds, lambda x: x["at"].isNotNull())).alias("e")).select("e.at", "id", "e.kind")


def bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("tx_from").alias("first_at"), F.max(F.coalesce("tx_to", "tx_from")).alias("last_at"), F.count("*").alias("n"))


def page_after(df: DataFrame, key: str, cursor: Column | None, limit: int) -> DataFrame:
    """Keyset page: rows after the cursor, one more than the page so that the reader knows if there are more."""
    rows = df if cursor is None else df.where(F.col(key) > cursor)
    return rows.orderBy(key).limit(limit + 1)


def page_at(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def overlaps_before(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Whether a span overlaps the one before it in its partition."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    return df.withColumn("overlaps", F.coalesce(F.lag(end).over(w) > F.col(start), F.lit(False)))

"""Tables on Parquet: content-addressed raw shards, key merges, digests, compaction and retention.

Each function takes any path that Spark reads.  Appends are single DataFrame writes; merges write a new version
of the table beside the old one, so a lost executor never leaves half a table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType
from pyspark.sql.utils import AnalysisException

from millrace.functions import ids
from millrace.operators.filters import valid_source_id
from millrace.operators.order import numbered


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The table, or an empty one of the schema, or None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema) if schema else None


def scan_raw(spark: SparkSession, path: str, sources: list[str] | None = None, doc_ids: list[str] | None = None, content: bool = True) -> DataFrame:
    """Raw rows; sources prune partitions, doc_ids are pushed to the files, content is read only if asked for."""
    df = spark.read.parquet(path)
    if sources is not None:
        df = df.where(F.col("source_id").isin(sources))
    if doc_ids is not None:
        df = df.where(F.col("doc_id").isin(doc_ids))
    return df if content else df.drop("content")


def append_raw(spark: SparkSession, path: str, rows: DataFrame, per_file: int = 10_000) -> int:
    """Store (source_id, url, content, ...) rows whose content their source does not hold yet; returns how many."""
    bad = rows.where(~valid_source_id(F.col("source_id"))).select("source_id").head(1)
    if bad:
        raise ValueError(f"bad source_id: {bad[0][0]!r}")
    new = rows.withColumn("doc_id", ids.content_id(F.col("content")))
    new = new.groupBy("source_id", "doc_id").agg(*[F.min_by(c, "url").alias(c) for c in rows.columns if c not in ("source_id", "doc_id")])
    old = read(spark, path)
    if old is not None:
        new = new.join(old.select("source_id", "doc_id"), ["source_id", "doc_id"], "left_anti")
    before = 0 if old is None else old.count()
    new.write.mode("append").option("compression", "zstd").option("maxRecordsPerFile", per_file).partitionBy("source_id").parquet(path)
    return spark.read.parquet(path).count() - before


def get_content(spark: SparkSession, path: str, doc_id: str):
    row = spark.read.parquet(path).where(F.col("doc_id") == doc_id).select("content").head()
    if row is None:
        raise KeyError(doc_id)
    return row["content"]


def merge(old: DataFrame, new: DataFrame, keys: list[str], replace: bool = True) -> DataFrame:
    """Upsert by key (or insert only what is absent); within new rows the last by all columns stays (maps by their JSON)."""
    held = {f.name: f.dataType for f in new.schema.fields}
    rank = lambda c: F.to_json(F.col(c)) if isinstance(held[c], MapType) else F.col(c)
    w = Window.partitionBy(*keys).orderBy(*[rank(c).desc() for c in sorted(set(new.columns) - set(keys))] or [F.lit(1)])
    fresh = new.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    if replace:
        return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)
    return old.unionByName(fresh.join(old.select(*keys), keys, "left_anti"))


def replace_parts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Delete every row of the keys that new rows bring, then append them."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def assign(df: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """Bulk update of a column from (key, column) rows."""
    return df.join(values.select(key, F.col(column).alias("_new")), key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def swap(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Replace a plain folder: write beside it, move the old one away, move the new one in.

    Between the two moves the folder is not there; tables that are read meanwhile belong in a `zone.Zone`, whose commits
    leave no such moment.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(new)
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(conf)
    if fs.exists(p(path)):
        fs.rename(p(path), p(old))
    fs.rename(p(new), p(path))
    if fs.exists(p(old)):
        fs.delete(p(old), True)


def digest(df: DataFrame) -> DataFrame:
    """(n, checksum) of a table, whatever its row order and files."""
    cols = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in sorted(df.columns)]
    h = F.xxhash64(*cols)
    return df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("checksum"))


def compact(spark: SparkSession, path: str, files: int = 1, most_rows: int | None = None) -> bool:
    """Rewrite small files into fewer, only if the content's digest stays; False where there is nothing to do."""
    df = spark.read.parquet(path)
    have = df.select(F.input_file_name()).distinct().count()
    if have <= files or (most_rows is not None and df.count() > most_rows):
        return False
    before = digest(df).first()
    temp = f"{path}.compact-{uuid.uuid4().hex}"
    df.coalesce(files).write.option("compression", "zstd").parquet(temp)
    if digest(spark.read.parquet(temp)).first() != before:
        raise RuntimeError("compaction changed the content; the table is left as it was")
    swap(spark, spark.read.parquet(temp), path)
    return True


def plan_expiry(snapshots: DataFrame, now: Column, days: int, keep: int) -> DataFrame:
    """Snapshots older than days, not among the newest `keep` and not the current one."""
    rows = numbered(snapshots, [F.desc("at"), F.desc("snapshot_id")], "_rn")
    return rows.where((F.col("_rn") > F.lit(max(1, keep))) & (F.col("at") < now - F.make_dt_interval(days=F.lit(days)))).drop("_rn")


def new_rows(raw: DataFrame, promoted: DataFrame, key: str = "doc_id") -> DataFrame:
    return raw.select(key).distinct().join(promoted.select(key), key, "left_anti")


def gap(raw: DataFrame, promoted: DataFrame, key: str = "doc_id", sample: int = 10) -> tuple[DataFrame, DataFrame]:
    """How many rows are not promoted, and the first of them."""
    missing = new_rows(raw, promoted, key)
    return missing.agg(F.count("*").alias("missing")), missing.orderBy(key).limit(sample)


def backfill_hashes(records: DataFrame, raw: DataFrame) -> DataFrame:
    """Content hashes of records that lack one, where the raw bytes are known."""
    h = raw.select("doc_id", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("_h"))
    return records.join(h, "doc_id", "left").withColumn("content_hash", F.coalesce("content_hash", "_h")).drop("_h")


def same_content(refs: DataFrame) -> DataFrame:
    """One reference for each content: the least by source and url."""
    return refs.groupBy("doc_id").agg(F.min(F.struct("source_id", "url")).alias("r")).select("doc_id", "r.*")


def views(spark: SparkSession, root: str, names: list[str]) -> None:
    """A SQL view for each table under a root."""
    for n in names:
        spark.read.parquet(f"{root}/{n}.parquet").createOrReplaceTempView(n)


def resolve_spans(claims: DataFrame, raw: DataFrame) -> DataFrame:
    """Claims (doc_id, char_start, char_end, ...) with the stretch of their document's text, counted in characters."""
    text = F.decode("content", "UTF-8")
    rows = claims.join(raw.select("doc_id", text.alias("_text")).dropDuplicates(["doc_id"]), "doc_id", "left")
    return rows.withColumn("quote", F.substring(F.col("_text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))).drop("_text")


def batches(new_ids: DataFrame, key: str = "doc_id", size: int = 1000) -> DataFrame:
    """Ids to promote with the number of their batch, in the order of the ids."""
    return numbered(new_ids.select(key), [F.asc(key)], "_k").withColumn("batch", F.floor((F.col("_k") - 1) / size)).drop("_k")

"""A training-data pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; between
two stages the rows are written as Parquet and read again.  All but the last return the columns
that came in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.decontaminate import find_contamination
from millrace.llm.ngram_join import jaccard_classes
from millrace.llm.packing import pack
from millrace.llm.quality import score_quality
from millrace.llm.queries import tokenizer_path
from millrace.llm.shared import Scratch
from millrace.llm.substring_dedup import remove_repeats

#: SQL has no tokenizer and no fitted model.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _others(docs: DataFrame) -> list[str]:
    """The columns that an operator does not bring along by itself."""
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def _back(df: DataFrame, columns: list[str], **new: F.Column) -> DataFrame:
    """The columns that came in, from the struct `carry`, some with new values."""
    return df.select(*[(new[c] if c in new else F.col(f"carry.`{c}`")).alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model takes for label 0 go; null and empty texts are scored like others, repeated rows alike."""
    scored = score_quality(spark, docs, _table(spark, sf_dir, "labels"), carry=_others(docs))
    return _back(scored.where("score >= 0.5"), docs.columns, doc_id=F.col("doc_id"), text=F.col("text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of smallest doc_id stays; without doc_id a row stays as it is.

    Null and empty texts link with nothing and stay.  Rows that repeat doc_id and text are one document; other texts
    under the same doc_id stay with it.
    """
    first = jaccard_classes(spark, docs).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "_h"])
    return kept.select(*docs.columns).union(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats of 20-word windows are cut out; a text without any stays as it is, one with nothing left goes."""
    cut = remove_repeats(spark, docs, k=20, carry=docs.columns)
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("carry.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("carry.n_chars"))
    return _back(cut.where("n_removed = 0 or n_removed < n_words"), docs.columns, **new)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go; null and empty texts hold none and stay, repeated rows fare alike."""
    found = find_contamination(spark, docs, _table(spark, sf_dir, "benchmark"), carry=_others(docs))
    return _back(found.where("size(spans) = 0"), docs.columns, doc_id=F.col("doc_id"), text=F.col("text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(spark, docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    scratch = Scratch(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return docs

"""Filters and validations as Column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import source_type as kind_of_source
from millrace.operators.claims import RELATIONS

# The stages of the pipeline with their names in topics, the routes of a stage, and the envelope's limits.
STAGES = {"S1": "fetch", "S2": "store-raw", "S3": "parse-normalize", "S4": "dedup", "S5": "extract", "S6": "resolve", "S7": "graph-mutation"}
ROUTES = ("primary", "retry", "dlq", "quarantine")
VERSION, MAX_BYTES, MAX_DEPTH, MAX_SCALAR = 1, 1_048_576, 32, 8_192


def valid_source_id(source_id: Column) -> Column:
    return source_id.rlike("^[a-z0-9][a-z0-9._-]{0,127}$")


def archive(
    docs: DataFrame,
    source: str | None = None,
    lang: str | None = None,
    q: str | None = None,
    columns: tuple[str, ...] = ("text",),
    source_type: str | None = None,
    doc_ids: DataFrame | None = None,
) -> DataFrame:
    """Documents of a source, source type and language (null: unknown), of a set of ids, that hold a case-blind substring."""
    out = docs
    if source is not None:
        out = out.where(F.col("source") == source)
    if source_type is not None:
        out = out.where(kind_of_source(F.col("source")) == source_type)
    if lang is not None:
        out = out.where(F.coalesce("lang", F.lit("unknown")) == lang)
    if q is not None:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(q.lower())), F.lit(False))
        out = out.where(hit)
    if doc_ids is not None:
        out = out.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return out


def in_blocks(claims: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Claims of the wanted key tuples; Spark broadcasts the blocks if they are small enough."""
    return claims.join(blocks.select(*keys).distinct(), keys, "left_semi")


def valid_span(start: Column, end: Column) -> Column:
    return F.coalesce((start >= 0) & (start <= end), F.lit(False))


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON value")


def _nesting(payload: str) -> tuple[int, int]:
    """How deep a JSON text nests, the payload itself at depth 2, and its longest text or key; (-1, -1) if it is no JSON object."""
    try:
        root = json.loads(payload, parse_constant=_no_number)
    except (ValueError, RecursionError):
        return -1, -1
    if not isinstance(root, dict):
        return -1, -1
    deepest, longest, level, depth = 0, 0, [root], 2
    while level:
        deepest, below = depth, []
        for x in level:
            if isinstance(x, str):
                longest = max(longest, len(x))
            elif isinstance(x, dict):
                longest = max([longest, *map(len, x)])
                below.extend(x.values())
            elif isinstance(x, list):
                below.extend(x)
        level, depth = below, depth + 1
    return deepest, longest


@F.pandas_udf(T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("longest", T.IntegerType())]))
def nesting(payloads: pd.Series) -> pd.DataFrame:
    """Depth and longest text of JSON payloads."""
    return pd.DataFrame([_nesting(p) if p is not None else (-1, -1) for p in payloads], columns=["depth", "longest"], dtype="int32")


def envelope_reasons(e: DataFrame, max_bytes: int = MAX_BYTES) -> Column:
    """What is wrong with an envelope, in order; columns that it lacks are not judged.

    Names and keys must not be empty, the stage must be one of the seven, the attempt count not negative, the
    payload a JSON object within the limits of size, nesting and text length.
    """
    c = F.col
    has = lambda name: name in e.columns
    shape = nesting(c("payload"))
    text = [k for k in ("event_id", "event_type", "status", "idempotency_key", "correlation_id") if has(k)]
    long_text = F.lit(False)
    for k in text:
        long_text = long_text | F.coalesce(F.length(k) > MAX_SCALAR, F.lit(False))
    return F.array_compact(F.array(
        *([F.when(~c("event_version").eqNullSafe(F.lit(VERSION)), "unsupported_version")] if has("event_version") else []),
        F.when(~c("stage").isin(*STAGES) | c("stage").isNull(), "unknown_stage"),
        *[F.when(c(k).isNull() | (c(k) == ""), f"missing_{k}") for k in text],
        *([F.when(c("attempt_count").isNull() | (c("attempt_count") < 0), "bad_attempt_count")] if has("attempt_count") else []),
        F.when(c("occurred_at").isNull(), "missing_time"),
        F.when(F.octet_length("payload") > max_bytes, "oversized"),
        F.when(shape["depth"] < 0, "bad_json"),
        F.when(shape["depth"] > MAX_DEPTH, "too_deep"),
        F.when((shape["longest"] > MAX_SCALAR) | long_text, "scalar_too_long"),
    ))


def valid_reference(doc_id: Column, ref: Column, key: Column) -> Column:
    """A raw reference of the form raw://source/doc, whose document is the message's key."""
    return doc_id.rlike("^doc-[0-9a-f]{24}$") & (F.element_at(F.split(ref, "/"), -1) == doc_id) & ref.startswith("raw://") & (key == doc_id)


# The fields that a record of each kind must have, and its vocabularies.
REQUIRED = {
    "claim": ("claim_candidate_id", "doc_id", "predicate", "subject_id", "modality", "polarity", "confidence", "seg_order", "char_start", "char_end", "surface_fragment"),
    "canonical_verdict": ("relation", "canonical_text", "confidence"),
    "contradiction_verdict": ("verdict", "rationale", "confidence"),
    "report": ("subject_id", "conclusion", "statements", "open_questions"),
}
VERDICTS = ("real_conflict", "temporal", "scope", "not_conflict")
CONFLICT_TYPES = ("value_conflict", "temporal", "scope")
_NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE|BOOLEAN)"


def record_reason(record: Column, kind: str) -> Column:
    """Why a JSON record of this kind is not valid; null if it is.  The first fault counts, in the order of its kind.

    A field that is null is missing.  Types are those of the JSON value: a number in quotes is text; true and false
    count as 1 and 0.
    """
    value = F.try_parse_json(record)
    part = lambda k: F.try_variant_get(value, f"$.{k}", "variant")
    type_of = lambda k: F.coalesce(F.schema_of_variant(part(k)), F.lit("VOID"))
    text = lambda k: F.try_variant_get(value, f"$.{k}", "string")
    there = lambda k: type_of(k) != "VOID"
    word_of = lambda k, words: (type_of(k) == "STRING") & F.coalesce(text(k).isin(*words), F.lit(False))
    number = F.when(type_of("confidence") == "BOOLEAN", F.try_variant_get(value, "$.confidence", "boolean").cast("double")).otherwise(F.try_variant_get(value, "$.confidence", "double"))
    in_range = type_of("confidence").rlike(_NUMBER) & F.coalesce(number.between(0, 1), F.lit(False))
    lacks = F.array_sort(F.array_compact(F.array(*[F.when(~there(k), F.lit(k)) for k in REQUIRED[kind]])))
    tests = [
        (value.isNull() | ~F.coalesce(F.schema_of_variant(value), F.lit("")).startswith("OBJECT"), F.lit("not an object")),
        (F.size(lacks) > 0, F.concat(F.lit("missing: "), F.array_join(lacks, ", "))),
    ]
    confidence = (~in_range, F.lit("confidence not in [0,1]"))
    if kind == "claim":
        tests += [confidence, (there("provenance_ref") & ~type_of("provenance_ref").isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit("provenance_ref is no list of texts"))]
    if kind == "canonical_verdict":
        tests += [(~word_of("relation", RELATIONS), F.lit("unknown relation")), (type_of("canonical_text") != "STRING", F.lit("canonical_text is no text")), confidence]
    if kind == "contradiction_verdict":
        empty = (type_of("rationale") != "STRING") | (F.trim(F.coalesce(text("rationale"), F.lit(""))) == "")
        tests += [(~word_of("verdict", VERDICTS), F.lit("unknown verdict")), (empty, F.lit("rationale is empty")), confidence]
        tests += [(there("conflict_type") & ~word_of("conflict_type", CONFLICT_TYPES), F.lit("unknown conflict type"))]
    if kind == "report":
        shape = {"conclusion": "OBJECT", "statements": "ARRAY", "open_questions": "ARRAY", "audit": "OBJECT"}
        tests += [(there(k) & ~type_of(k).startswith(sign), F.lit(f"{k} has the wrong type")) for k, sign in shape.items()]
    return F.coalesce(*[F.when(t, r) for t, r in tests])


def verdict(record: Column, kind: str = "contradiction_verdict") -> Column:
    """A verdict as a struct, null where its record is not valid."""
    fields = {"canonical_verdict": "relation string, canonical_text string, confidence double", "contradiction_verdict": "verdict string, conflict_type string, rationale string, confidence double"}
    return F.when(record_reason(record, kind).isNull(), F.from_json(record, fields[kind]))

"""Deterministic, content-derived identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(value: Column, length: int = 24) -> Column:
    """The first hex digits of the SHA-256 of a text or binary column."""
    return F.substring(F.sha2(value, 256), 1, length)


def typed_id(prefix: str, *parts: Column, sep: str = "|") -> Column:
    """`prefix-` and the short hash of the parts joined by sep; a null part counts as empty."""
    joined = F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "-"), short_hash(joined))


def content_id(content: Column) -> Column:
    """Document id from its bytes."""
    return F.concat(F.lit("doc-"), short_hash(content.cast("binary")))


def cluster_id(members: Column) -> Column:
    """Id of a group of document ids, whatever their order."""
    return F.concat(F.lit("clus-"), short_hash(F.array_join(F.array_sort(members), "|")))


def json_text(value: Column) -> Column:
    """A JSON string literal with quotes and backslashes escaped."""
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def entity_id(mention_type: Column, name: Column, identifiers: Column | None = None) -> Column:
    """`org-` id from type, canonical name and identifiers (a sorted array of key, value pairs)."""
    pairs = F.lit("[]") if identifiers is None else F.concat(F.lit("["), F.array_join(F.transform(identifiers, lambda p: F.concat(F.lit("["), json_text(p["key"]), F.lit(", "), json_text(p["value"]), F.lit("]"))), ", "), F.lit("]"))
    text = F.concat(F.lit('{"c": '), json_text(name), F.lit(', "i": '), pairs, F.lit(', "t": '), json_text(mention_type), F.lit("}"))
    return F.concat(F.lit("org-"), short_hash(text))


def version_fingerprint(axes: dict[str, Column]) -> Column:
    """`vt-` id of named version axes, in order of their names."""
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit(""))) for k, v in sorted(axes.items())]
    return F.concat(F.lit("vt-"), short_hash(F.concat_ws("|", *parts)))


def hex_cursor(key: Column) -> Column:
    return F.lower(F.hex(F.encode(key.cast("string"), "UTF-8")))


def from_hex_cursor(cursor: Column) -> Column:
    return F.decode(F.unhex(cursor), "UTF-8")


def json_cursor(value: Column) -> Column:
    """URL-safe base64 of a struct's JSON."""
    return F.translate(F.regexp_replace(F.base64(F.to_json(value).cast("binary")), "\\s", ""), "+/", "-_")


def from_json_cursor(cursor: Column, schema: str) -> Column:
    """The struct of a JSON cursor; null where it is none."""
    return F.from_json(F.try_to_binary(F.translate(cursor, "-_", "+/"), F.lit("base64")).cast("string"), schema)

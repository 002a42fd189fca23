"""Operator 5: language identification by Bayesian fusion of evidence.

The posterior of a row's language is proportional to

    prior(language | host) * P(text | language) * P(declared | language) * P(suffix | language)

- text: byte trigrams in hashed tables, one for each language, from labelled texts that are not held
  out; the likelihood is tempered, as trigrams of one text are far from independent;
- declared markup language and address suffix: tables of how often a declaration or suffix
  stands with a language, from the text's soft decisions over all rows, smoothed;
- host prior: soft counts of the host, shrunk towards its domain's, those towards its suffix's,
  those towards all rows'; each level is one grouped aggregation with partial sums.  A row's own
  share is taken out of its host's counts.

Evidence that a row lacks drops out of the product.  Every language of the labels has a table of 65,536
trigrams, 256 KB each; host counts stay distributed.

Defined cases: null and empty texts rest on the other evidence, and without any on the prior of all
rows; a null host or address falls back one level; unknown declared languages count as their own value; ties go to
the language first in order; an empty table gives an empty result; without labels the language is null.
"""

from __future__ import annotations

import html
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.shared import CHUNKS_DDL, Scratch, add_chunks

TABLE = 1 << 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Table places of all byte trigrams, and where each text's begin (with the total at the end)."""
    raw, at = W.flat(texts)
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    b = _LOWER[raw].astype(np.uint32)
    h = ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    size = np.maximum(np.diff(at) - 2, 0)
    ok = np.ones(len(h), bool)
    for edge in at[1:-1]:
        ok[max(0, edge - 2) : edge] = False
    return h[ok].astype(np.int64), np.r_[0, np.cumsum(size)]


def log_likelihoods(texts: pa.Array, tables: np.ndarray, strength: float = 0.02, most: float = 40.0) -> np.ndarray:
    """For each text and language the tempered log likelihood, against the likeliest language's: at least -2 * most."""
    h, first = trigrams(texts)
    out = np.empty((len(first) - 1, len(tables)))
    for k, table in enumerate(tables):
        sums = np.r_[0.0, np.cumsum(table[h], dtype=np.float64)]
        out[:, k] = sums[first[1:]] - sums[first[:-1]]
    out -= out.max(1, keepdims=True) if len(tables) else 0
    size = np.diff(first)[:, None]
    return np.clip(out * np.minimum(1.0, strength + 20.0 / np.maximum(size, 20)), -2 * most, 0.0)


def _counts(held: int = 64):
    """Trigram counts of each language k, in tables that are handed on when a task holds `held` of them."""

    def run(batches):
        from pyspark import TaskContext

        slot, total = TaskContext.get().partitionId(), {}

        def rows():
            for k, t in total.items():  # a row at a time: a batch of Arrow holds one table
                yield pa.record_batch([pa.array([slot], pa.int32()), pa.array([k], pa.int32()), pa.array([False]), pa.array([t.tobytes()], pa.binary())], names=["slot", "chunk", "real", "data"])
            total.clear()

        for batch in W.pieces(batches, "text"):
            h, first = trigrams(batch.column("text"))
            for d, k in enumerate(batch.column("k").to_pylist()):
                if k not in total:
                    if len(total) >= held:
                        yield from rows()
                    total[k] = np.zeros(TABLE, np.int64)
                total[k] += np.bincount(h[first[d] : first[d + 1]], minlength=TABLE)
        yield from rows()

    return run


def _quota(counts: list[int], most: int) -> int:
    """The greatest number of rows a language may have so that all together have at most `most`, 1 at least."""
    left, n = most, len(counts)
    for j, c in enumerate(sorted(counts)):
        if c * (n - j) > left:
            return max(1, left // (n - j))
        left -= c
    return max(counts, default=1)


def train(spark: SparkSession, labelled: DataFrame, most_rows: int = 20_000, least_rows: int = 200) -> tuple[list[str], np.ndarray]:
    """Languages and log-probability tables from labelled (doc_id, text, lang) rows.

    Every label language has a table.  most_rows: about how many rows are read, a documented bound, shared
    out so that rare languages keep all their rows and the frequent ones get equal parts (those
    of least hash of their id); with very many languages each still gets about least_rows, and one row always.
    """
    fine = 1 << 40
    rows = labelled.select("doc_id", "text", "lang").where("doc_id is not null and lang is not null and length(text) > 0")
    rows = rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(fine)))
    seen = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("first")).orderBy("lang").collect()  # a row for each language
    seen.sort(key=lambda r: r["lang"])
    languages = [r["lang"] for r in seen]
    if not languages:
        return [], np.zeros((0, TABLE), np.float32)
    quota = max(least_rows, _quota([r["n"] for r in seen], most_rows))
    bounds = [(r["lang"], k, max(r["first"] + 1, math.ceil(fine * min(1.0, quota / r["n"])))) for k, r in enumerate(seen)]
    some = rows.join(F.broadcast(spark.createDataFrame(bounds, "lang string, k int, bound long")), "lang").where("h < bound")
    floor = np.float32(math.log(1 / TABLE))
    tables = np.full((len(languages), TABLE), floor, np.float32)
    for r in add_chunks(some.select("text", "k").mapInArrow(_counts(), CHUNKS_DDL)).toLocalIterator():  # a row for each language
        counts = np.frombuffer(r["data"], np.int64)
        tables[r["chunk"]] = np.log((counts + 0.5) / (counts.sum() + 0.5 * TABLE))
    return languages, tables


_SCRIPTS = re.compile(r"<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.I | re.S)
_TAGS = re.compile(r"<[^>]*+>")
_MARKS = re.compile(r"<!--|<(script|style|html|meta)(?=[\s/>])", re.I)
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
_CODE = re.compile(r"\s*([a-zA-Z]+)")


def _attributes(source: str, at: int) -> tuple[dict[str, str], int]:
    """A tag's attributes (the first of each name) from the end of its name on, and where they end."""
    found: dict[str, str] = {}
    while m := _ATTRIBUTE.match(source, at):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        at = m.end()
    return found, at


def declared(source: str | None) -> str | None:
    """The language that a page's markup declares: html lang, else its meta element.

    The whole page is searched, once; comments, scripts and styles declare nothing.
    """
    at, meta = 0, None
    while source and (m := _MARKS.search(source, at)):
        name = (m[1] or "").lower()
        if name in ("", "script", "style"):
            end = re.compile(rf"</{name}|\Z" if name else r"--!?>|\Z", re.I).search(source, m.end() if name else m.start() + 2)
            at = end.end()
            continue
        found, at = _attributes(source, m.end())
        if name == "html":
            code = _CODE.match(found.get("lang", "")) or _CODE.match(found.get("xml:lang", ""))
            if code:
                return code[1].lower()
        elif meta is None and any("content-language" in v.lower() or "og:locale" in v.lower() for k, v in found.items() if k != "content"):
            code = _CODE.match(found.get("content", ""))
            meta = code and code[1].lower()
    return meta


def visible(source: str | None) -> str:
    return html.unescape(_TAGS.sub(" ", _SCRIPTS.sub(" ", source))) if source else ""


def _evidence(tables, markup: bool):
    def run(batches):
        for batch in W.pieces(batches, "text"):
            texts, said = batch.column("text"), [None] * batch.num_rows
            if markup:
                pages = texts.to_pylist()
                said = [declared(p) for p in pages]
                texts = pa.array([visible(p) for p in pages], pa.string())
            x = log_likelihoods(texts, tables.value)
            yield pa.record_batch([batch.column("doc_id"), batch.column("page_id"), batch.column("host"), batch.column("domain"), batch.column("suffix"), pa.array(said, pa.string()), _lists(x), _lists(_softmax(x))], names=["doc_id", "page_id", "host", "domain", "suffix", "declared", "text", "soft"])

    return run


_EVIDENCE = "doc_id long, page_id long, host string, domain string, suffix string, declared string, text array<double>, soft array<double>"


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Probabilities from log weights, one column for each language."""
    raised = np.exp(logits - logits.max(1, keepdims=True, initial=-np.inf))
    return raised / raised.sum(1, keepdims=True)


def _totals(rows: DataFrame, key: str, n: int) -> DataFrame:
    sums = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.sum(F.get("soft", F.lit(k))).alias(f"s{k}") for k in range(n)])
    return sums.select(key, F.array(*[f"s{k}" for k in range(n)]).alias(f"{key}_n"))


def _shrunk(own: np.ndarray, above: np.ndarray, weight: float) -> np.ndarray:
    """Counts plus weight times the level above, as proportions."""
    counts = np.maximum(own, 0.0) + weight * above
    return counts / counts.sum(1, keepdims=True)


def _posterior(languages: list[str], base: np.ndarray, weight: float, most: int = 1 << 19):
    n = len(languages)

    def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A row for each list, zeros for null; and which are not null."""
        given = column.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros((len(column), n))
        out[given] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        return out, given[:, None]

    def run(batches):
        step = max(1, most // n)
        for whole in batches:
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                logits, soft = matrix(batch.column("text"))[0], matrix(batch.column("soft"))[0]
                less = {}  # counts without the row's own share; 0 where the row lacks the key
                for key in ("suffix", "domain", "host", "declared"):
                    counts, given = matrix(batch.column(f"{key}_n"))
                    less[key] = np.where(given, counts - soft, 0.0), given
                level = base[None, :]
                for key in ("suffix", "domain", "host"):
                    level = _shrunk(less[key][0], level, weight)
                logits += np.log(level)
                # P(value | language) up to a factor: the value's counts against the language's share
                for key in ("declared", "suffix"):
                    logits += np.where(less[key][1], np.log(_shrunk(less[key][0], base[None, :], 5.0) / base), 0.0)
                post = _softmax(logits)
                best = post.argmax(1)
                yield pa.record_batch([batch.column("doc_id"), batch.column("page_id"), batch.column("host"), pa.array([languages[k] for k in best], pa.string()), pa.array(post[np.arange(len(best)), best])], names=["doc_id", "page_id", "host", "lang", "probability"])

    return run


def identify(spark: SparkSession, labelled: DataFrame, documents: DataFrame | None = None, pages: DataFrame | None = None, weight: float = 20.0) -> DataFrame:
    """(doc_id, page_id, host, lang, probability) of documents (host: source) and pages (host: of the url)."""
    scratch = Scratch(spark, "language")
    languages, tables = train(spark, labelled)
    n = len(languages)
    shared = spark.sparkContext.broadcast(tables)
    none = F.lit(None).cast("string")
    parts = []
    if documents is not None:
        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col("source").cast("string").alias("host"), none.alias("domain"), none.alias("suffix"), "text")
        parts.append(rows.mapInArrow(_evidence(shared, False), _EVIDENCE))
    if pages is not None:
        host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
        host = F.when(host != "", host)
        domain = F.element_at(F.split(host, r"\."), -1)
        wide = F.when(F.size(F.split(host, r"\.")) > 1, F.concat_ws(".", F.slice(F.split(host, r"\."), -2, 2)))
        rows = pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), host.alias("host"), wide.alias("domain"), domain.alias("suffix"), F.col("html").alias("text"))
        parts.append(rows.mapInArrow(_evidence(shared, True), _EVIDENCE))
    rows = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    if not n:
        return rows.select("doc_id", "page_id", "host", none.alias("lang"), F.lit(None).cast("double").alias("probability"))
    rows = scratch.table(rows)
    whole = rows.agg(*[F.coalesce(F.sum(F.get("soft", F.lit(k))), F.lit(0.0)) for k in range(n)]).first()
    base = (np.array(whole) + 1) / (sum(whole) + n)
    out = rows
    for key in ("suffix", "domain", "host", "declared"):
        # rows that lack the key are spread, so they do not meet in one task; no total has such a key
        spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64("doc_id", "page_id"), F.lit(4096)).cast("string"))
        totals = _totals(rows, key, n).withColumnRenamed(key, "_key")
        out = out.withColumn("_own", F.coalesce(key, spread)).join(totals, F.col("_own") == F.col("_key"), "left").drop("_own", "_key")
    out = out.select("doc_id", "page_id", "host", "text", "soft", "suffix_n", "domain_n", "host_n", "declared_n")
    return out.mapInArrow(_posterior(languages, base, weight), "doc_id long, page_id long, host string, lang string, probability double")

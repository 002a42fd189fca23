"""The driver's queries of this subpackage, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file, found where it is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.quality import held_out, score_quality

    scored = score_quality(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.html_extract import extract

    return extract(spark, _table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.packing import pack

    return pack(spark, _table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end=0)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.ngram_join import jaccard_classes

    return jaccard_classes(spark, _table(spark, sf_dir, "documents"), n=5, percent=75)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.language import identify

    docs = _table(spark, sf_dir, "documents")
    return identify(spark, docs, documents=docs, pages=_table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.decontaminate import find_contamination

    found = find_contamination(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=10)
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), F.lit(0).cast("long"), lambda total, i: total + F.get("spans", i + 1) - F.get("spans", i))
    n_hit = F.when(F.size("spans") > 0, n_hit).otherwise(F.lit(0).cast("long"))
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.ann import nearest

    return nearest(spark, _table(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.reshard import LAW, place

    placed = place(spark, _table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.substring_dedup import remove_repeats

    cut = remove_repeats(spark, _table(spark, sf_dir, "documents"), k=20)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.hmm import score_texts

    return score_texts(spark, _table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.heap_lloyd import compress

    coded = compress(spark, _table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    sums = ",".join(str(x) for book in coded.books for x in book)
    return coded.rows.select("vec_id", "code", "error", "label_error", F.sha2(F.lit(sums), 256).alias("codebooks_sha256"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.secret_scan import BASE, find_secrets

    found = find_secrets(spark, _table(spark, sf_dir, "documents"))
    places = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    counts, base = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE], of(*BASE)
    return found.select("doc_id", *counts, F.sha2(places(base), 256).alias("base_sha256"), places(F.col("spans")).alias("spans"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.whiten import whiten

    return whiten(spark, _table(spark, sf_dir, "embeddings"), k=4, scale=256)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality, op2_html_extract, op3_packing, op4_ngram_join, op5_language, op6_decontamination, op7_nearest)
    found += (op8_sharding, op9_substring_dedup, op10_hmm, op11_vector_codes, op12_secret_scan, op13_whitening)
    return {f.__name__: f for f in found}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[]
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w
), e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM c WHERE 100 * k >= 75 * (na + nb - k)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, m) AS (
  SELECT doc_id, doc_id FROM s
  UNION
  SELECT u.b, r.m FROM r JOIN u ON u.a = r.doc_id WHERE r.m < u.b
)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, t.m AS component_id
FROM s JOIN (SELECT doc_id, min(m) AS m FROM r GROUP BY 1) t USING (doc_id)
"""


OP6_SQL = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL
), p AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS m, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS x
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)
), m AS (SELECT DISTINCT m FROM p),
d AS (
  SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS x
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, m WHERE len(ws) >= m)
), h AS (SELECT d.doc_id, d.i, d.m, p.item_id FROM d JOIN p ON d.m = p.m AND d.x = p.x),
k AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, i, array_to_string(ws[i:i+19], ' ') AS x
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)
), r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r),
a AS (SELECT doc_id, j, ws[j] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w)),
k AS (SELECT a.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t FROM a ANTI JOIN c ON a.doc_id = c.doc_id AND a.j = c.j GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""


def _matches(kind: str, place: int, pattern: str, group: int) -> str:
    """Matches of a pattern with their places: gaps and matches of a text alternate, so running sums of their lengths place them."""
    return f"""
  SELECT doc_id, row_id, '{kind}' AS kind, {place} AS place, m, g, sum(len(gap)) OVER w + sum(len(m)) OVER w - len(m) AS s
  FROM (SELECT doc_id, row_id, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(gaps[1:len(ms)]) AS gap FROM (
    SELECT doc_id, row_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {group}) AS gs, regexp_split_to_array(t, '{pattern}') AS gaps FROM d))
  WINDOW w AS (PARTITION BY row_id ORDER BY i ROWS UNBOUNDED PRECEDING)"""


#: Letters of either case are spelled out, since folding would take other letters for s and k; a quote is written twice, as in SQL text.
_NAMES = "|".join(re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", name) for name in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

OP12_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS t FROM documents),
c AS (  -- the byte table of CRC-32
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, n)) AS tab
), m AS ({_matches("assign", 1, _ASSIGN, 2)}
  UNION ALL {_matches("access", 2, "AKIA[A-Z0-9]+", 0)}
  UNION ALL {_matches("hex", 3, "[0-9a-f]+", 0)}
  UNION ALL {_matches("github", 4, "gh[pousr]_([0-9A-Za-z]+)", 1)}
  UNION ALL {_matches("npm", 5, "npm_([0-9A-Za-z]+)", 1)}
), k AS (
  SELECT row_id, kind, place, s, s + len(m) AS e FROM m, c
  WHERE CASE kind WHEN 'assign' THEN len(g) >= 8 WHEN 'access' THEN len(m) >= 16 WHEN 'hex' THEN len(m) >= 32 ELSE len(g) = 36
    AND xor(list_reduce(list_transform(string_split(g[1:30], ''), lambda x: CAST(ord(x) AS BIGINT)), lambda r, x: xor(tab[(xor(r, x) & 255) + 1], r >> 8), 4294967295), 4294967295)
      = list_reduce(list_transform(string_split(g[31:36], ''), lambda x: CAST(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', x) - 1 AS BIGINT)), lambda r, x: r * 62 + x, 0) END
), a AS (
  SELECT row_id, count(*) FILTER (place = 1) AS n_assign, count(*) FILTER (place = 2) AS n_access, count(*) FILTER (place = 3) AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (place <= 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans
  FROM (SELECT row_id, kind, place, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM k) GROUP BY 1
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (row_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_join": OP4_SQL, "op6_decontamination": OP6_SQL, "op9_substring_dedup": OP9_SQL, "op12_secret_scan": OP12_SQL}

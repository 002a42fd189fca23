"""Named queries over the driver's tables, and the SQL that each is held against.

Every query works on whole tables.  Shapes of the evidence model are mapped to what the tables hold: events are
mutations, metrics and versions; lineitem rows are claims (order: subject, return flag: predicate, part: object, supplier: document);
customer, order, part and supplier keys are a property graph.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import ids, text
from millrace.operators import bitemporal, claims, dedup, evaluate, evidence, extract, filters, graph, metrics, order, retrieval
from millrace.operators.components import shared_folder
from millrace.plans import chain
from millrace.sources import store
from millrace.streaming import promotion

FLAGSHIP = "exact_dup_groups"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: Everyday words of the four languages, as a gazetteer for the driver's invented prose.
NAMES = [("the", "Event"), ("and", "Event"), ("der", "Location"), ("und", "Location"), ("les", "Product"), ("des", "Product"), ("los", "Person"), ("que", "Person"), ("with", "Organization"), ("from", "Organization")]
#: Claim rules for it: (pattern, predicate, event type).
RULES = [(r"\bthat\b", "announces", "statement"), (r"\bfor\b", "supplies", "delivery"), (r"\bis\b", "located_in", "state"), (r"\bwas\b", "located_in", "past")]


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NAMES, "surface string, mention_type string")


_SQL_NAMES = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in NAMES) + ") AS g(surface, mention_type)"
_SHORT = "substr(sha256({0}), 1, 24)"


# documents and identifiers
@query("SELECT doc_id, 'doc-' || substr(sha256(text), 1, 24) AS content_id FROM documents")
def content_doc_id(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", ids.content_id(F.col("text")).alias("content_id"))


@query("SELECT sha256(text) AS text_sha256, count(*) AS n, min(doc_id) AS first_doc_id FROM documents GROUP BY 1")
def exact_dup_groups(spark, sf):
    return dedup.exact_groups(_t(spark, sf, "documents"))


@query("""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')) ELSE [] END)) AS BIGINT) AS n_shingles
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)""")
def shingle_counts(spark, sf):
    t = _t(spark, sf, "documents").select("doc_id", text.word_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(text.shingle_set(F.col("t"))).cast("long").alias("n_shingles"))


# MinHash of version x2: 60 bits of each shingle's MD5, two multiplications modulo 2^64 with shifts between, least of each permutation.
_MINHASH_SQL = f"""t AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
g AS (SELECT doc_id, sha256(text) AS h, unnest(list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')))) AS s FROM t WHERE len(text) >= 200 AND len(t) >= 5),
k AS (SELECT doc_id, h, CAST('0x' || substr(md5(s), 1, 15) AS UHUGEINT) AS x FROM g),
p(perm, seed) AS (VALUES {", ".join(f"({i}, {x})" for i, x in enumerate(dedup.seeds()))}),
y AS (SELECT doc_id, h, perm, CAST((x * CAST(seed AS UHUGEINT)) & CAST(18446744073709551615 AS UHUGEINT) AS UBIGINT) AS x FROM k, p),
z AS (SELECT doc_id, h, perm, CAST((CAST(xor(x, x >> 32) AS UHUGEINT) * {dedup.MIX}) & CAST(18446744073709551615 AS UHUGEINT) AS UBIGINT) AS x FROM y),
m AS (SELECT doc_id, h, perm, min(xor(x, x >> 29)) AS x FROM z GROUP BY ALL),
sig AS MATERIALIZED (SELECT doc_id, h, list(x ORDER BY perm) AS sig FROM m GROUP BY ALL),
rep AS (SELECT h, min(doc_id) AS doc_id FROM sig GROUP BY 1),
band AS (SELECT doc_id, sig, unnest(range(8)) AS b FROM sig JOIN rep USING (h, doc_id)),
pair AS MATERIALIZED (SELECT DISTINCT l.doc_id AS a, r.doc_id AS b, list_sum(list_transform(list_zip(l.sig, r.sig), lambda v: CAST(v[1] = v[2] AS INTEGER))) / 64 AS estimate
  FROM band l JOIN band r ON l.b = r.b AND l.doc_id < r.doc_id AND l.sig[l.b * 8 + 1 : l.b * 8 + 8] = r.sig[r.b * 8 + 1 : r.b * 8 + 8])
"""
_CLUSTERS_SQL = """same AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY sha256(text)) AS b FROM documents),
link AS (SELECT a, b FROM pair WHERE estimate >= 0.9 UNION SELECT a, b FROM same WHERE a <> b),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reached(doc_id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT w.b, r.low FROM reached r JOIN both_ways w ON w.a = r.doc_id WHERE r.low < w.b),
clusters AS (SELECT doc_id, min(low) AS cluster_min FROM reached GROUP BY 1)
"""


@query(f"WITH {_MINHASH_SQL} SELECT doc_id, CAST(CASE WHEN sig[1] >= 9223372036854775808 THEN CAST(sig[1] AS HUGEINT) - 18446744073709551616 ELSE sig[1] END AS BIGINT) AS first, len(sig) AS perms FROM sig")
def minhash_signatures(spark, sf):
    return dedup.signatures(_t(spark, sf, "documents")).select("doc_id", F.col("sig")[0].alias("first"), F.size("sig").cast("long").alias("perms"))


@query(f"WITH {_MINHASH_SQL} SELECT a, b, estimate FROM pair WHERE estimate >= 0.9")
def lsh_band_pairs(spark, sf):
    return dedup.candidate_pairs(dedup.signatures(_t(spark, sf, "documents")))


@query(f"WITH RECURSIVE {_MINHASH_SQL}, {_CLUSTERS_SQL} SELECT doc_id, cluster_min FROM clusters")
def near_dup_clusters(spark, sf):
    return dedup.clusters(_t(spark, sf, "documents"))


@query(f"""WITH RECURSIVE {_MINHASH_SQL}, {_CLUSTERS_SQL},
s AS (SELECT doc_id, cluster_min AS cluster, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents JOIN clusters USING (doc_id)),
r AS (SELECT cluster AS c, min(doc_id) AS root_doc_id, arg_min(s, doc_id) AS root_s FROM s GROUP BY 1)
SELECT doc_id, cluster, root_doc_id, CASE WHEN doc_id = root_doc_id THEN 'root' WHEN len(list_filter(s, lambda x: NOT list_contains(root_s, x))) > 0 THEN 'independent' ELSE 'derived' END AS role FROM s JOIN r ON s.cluster = r.c""")
def cluster_roles(spark, sf):
    return dedup.document_roles(_t(spark, sf, "documents"))


@query("""WITH s AS (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS seg_order, doc_id || '#p0.s' || (i - 1) AS segment_id, s[i] AS seg_text FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s) WHERE s[i] <> ''""")
def sentence_segments(spark, sf):
    return extract.segments(_t(spark, sf, "documents")).withColumn("seg_order", F.col("seg_order").cast("long"))


@query("""WITH s AS (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents)
SELECT doc_id, count(*) AS n_segments, CAST(sum(length(x)) AS BIGINT) AS n_chars, CAST(max(length(x)) AS BIGINT) AS longest FROM (SELECT doc_id, unnest(s) AS x FROM s) WHERE x <> '' GROUP BY 1""")
def segment_stats(spark, sf):
    s = extract.segments(_t(spark, sf, "documents"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_segments"), F.sum(F.length("seg_text")).alias("n_chars"), F.max(F.length("seg_text")).cast("long").alias("longest"))


@query("SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT lang) AS langs FROM documents GROUP BY 1")
def source_facets(spark, sf):
    return _t(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.countDistinct("lang").alias("langs"))


@query("SELECT coalesce(lang, 'unknown') AS lang, count(*) AS n FROM documents WHERE contains(lower(text), 'the') GROUP BY 1")
def language_facets(spark, sf):
    return filters.archive(_t(spark, sf, "documents"), q="the").groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, source, lang, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id OFFSET 20 LIMIT 20")
def archive_page(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return bitemporal.page_at(rows, [F.desc_nulls_last("n_chars"), F.asc("doc_id")], 20, 20)


@query("SELECT doc_id, lang, n_chars FROM documents WHERE contains(lower(text), 'tion') ORDER BY doc_id LIMIT 10")
def archive_search(spark, sf):
    return retrieval.search(_t(spark, sf, "documents"), "tion", ["text"])[1].select("doc_id", "lang", "n_chars")


@query("SELECT count(*) AS total FROM documents WHERE contains(lower(text), 'tion')")
def archive_search_total(spark, sf):
    return retrieval.search(_t(spark, sf, "documents"), "tion", ["text"])[0]


@query("SELECT doc_id, source FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 26")
def keyset_page(spark, sf):
    return bitemporal.page_after(_t(spark, sf, "documents").select("doc_id", "source"), "doc_id", F.lit(100), 25)


@query("SELECT doc_id, regexp_matches(source, '^[a-z0-9][a-z0-9._-]{0,127}$') AS valid, CASE WHEN split_part(source, '-', 1) IN ('gov','official','press','research','news') THEN split_part(source, '-', 1) ELSE 'source' END AS source_type FROM documents")
def source_types(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", filters.valid_source_id(F.col("source")).alias("valid"), text.source_type(F.col("source")).alias("source_type"))


# pages
_PLAIN_SQL = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '&#39;', ''''), '\\s+', ' ', 'g'))"


@query(f"""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g') AS h FROM pages), p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(h, '(?is)<p[^>]*>(.*?)</p>', 1), lambda x: {_PLAIN_SQL.format('x')}), lambda x: x <> '') AS p, list_filter(list_transform(regexp_extract_all(h, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), lambda x: {_PLAIN_SQL.format('x')}), lambda x: x <> '') AS g FROM h)
SELECT page_id, nullif(array_to_string(CASE WHEN len(p) > 0 THEN p ELSE g END, ' '), '') AS body FROM p""")
def html_extract(spark, sf):
    return _t(spark, sf, "pages").select("page_id", text.body_text("html").alias("body"))


@query("""SELECT page_id, trim(regexp_replace(t, '\\s*[|–-]\\s*[^|–-]*$', '')) AS title FROM (
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS t FROM pages)""")
def html_title(spark, sf):
    return _t(spark, sf, "pages").select("page_id", text.title(F.col("html")).alias("title"))


@query("SELECT host, count(*) AS n, min(page_id) AS first_page FROM (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages) GROUP BY 1 HAVING count(*) >= 2")
def url_groups(spark, sf):
    host = F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host")
    return _t(spark, sf, "pages").groupBy(host).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).where("n >= 2")


@query("SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def html_escape(spark, sf):
    return _t(spark, sf, "pages").select("page_id", text.escape_html(F.col("url")).alias("escaped"))


# extraction, claims and conflicts
@query(f"""SELECT doc_id, surface, mention_type, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS surface FROM documents) JOIN {_SQL_NAMES} USING (surface) GROUP BY ALL""")
def mention_extract(spark, sf):
    m = extract.gazetteer_mentions(_t(spark, sf, "documents"), _names(spark))
    return m.groupBy("doc_id", "surface", "mention_type").agg(F.count("*").alias("n"))


@query(f"""WITH m AS (SELECT doc_id, surface, mention_type, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS surface FROM documents) JOIN {_SQL_NAMES} USING (surface) GROUP BY ALL),
b AS (SELECT doc_id, mention_type, lower(surface) AS block, arg_min(surface, {{'k': -k, 's': surface}}) AS name, CAST(sum(k) AS BIGINT) AS n FROM m GROUP BY ALL)
SELECT doc_id, mention_type, block, name, n, 'org-' || {_SHORT.format("'{" + '"c": "' + "' || name || '" + '", "i": [], "t": "' + "' || mention_type || '" + '"}' + "'")} AS entity_id FROM b""")
def entity_resolution(spark, sf):
    return extract.resolve(extract.gazetteer_mentions(_t(spark, sf, "documents"), _names(spark)), fold=True).drop("identifiers")


def _chain(spark, sf):
    return chain.run(_t(spark, sf, "documents"), _names(spark), RULES)


# Names stand anywhere in a text, from left to right and the longer first; documents hold no tickers and no addresses.
_CHAIN_SQL = f"""WITH g AS (SELECT * FROM {_SQL_NAMES}),
p AS (SELECT doc_id, surface, mention_type, i, len(parts) AS k, sum(len(part)) OVER w + (i - 1) * len(surface) AS s
  FROM (SELECT doc_id, surface, mention_type, parts, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS part
    FROM (SELECT doc_id, surface, mention_type, string_split(text, surface) AS parts FROM documents, g WHERE contains(text, surface)))
  WINDOW w AS (PARTITION BY doc_id, surface ORDER BY i)),
o AS (SELECT doc_id, list({{'s': CAST(s AS BIGINT), 'e': CAST(s + len(surface) AS BIGINT), 'x': surface, 't': mention_type}} ORDER BY s, len(surface) DESC) AS l FROM p WHERE i < k GROUP BY 1),
a AS (SELECT doc_id, unnest(list_reduce(l, lambda acc, m: CASE WHEN m[1].s >= acc[len(acc)].e THEN list_concat(acc, m) ELSE acc END)) AS m
  FROM (SELECT doc_id, list_transform(l, lambda v: [v]) AS l FROM o)),
r AS (SELECT doc_id, m.s AS s, m.e AS e, m.x AS surface, m.t AS mention_type, 'org-' || {_SHORT.format("'{" + '"c": "' + "' || m.x || '" + '", "i": [], "t": "' + "' || m.t || '" + '"}' + "'")} AS entity_id FROM a),
d AS (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
s AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS seg_order, parts[i] AS seg_text FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM d) WHERE parts[i] <> ''),
f AS ({" UNION ALL ".join(f"SELECT doc_id, seg_order, seg_text, {i} AS rule_no, '{p}' AS predicate, '{e}' AS event_type, regexp_extract(seg_text, '{r}') AS frag, CAST(len(regexp_split_to_array(seg_text, '{r}')[1]) AS BIGINT) AS char_start FROM s WHERE regexp_matches(seg_text, '{r}')" for i, (r, p, e) in enumerate(RULES))}),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, seg_order, predicate ORDER BY rule_no) = 1),
u AS (SELECT doc_id, seg_order, predicate, arg_min(entity_id, (r.s, r.e)) AS subject_id FROM b JOIN r USING (doc_id) WHERE contains(seg_text, surface) GROUP BY ALL),
c AS (SELECT b.*, subject_id, char_start + len(frag) AS char_end FROM b JOIN u USING (doc_id, seg_order, predicate)),
v AS (SELECT doc_id, seg_order, predicate, arg_min(entity_id, (r.s, r.e)) AS object_id FROM c JOIN r USING (doc_id) WHERE r.s >= char_end AND entity_id <> subject_id GROUP BY ALL),
claims AS (SELECT doc_id, seg_order, predicate, event_type, char_start, char_end, frag AS surface_fragment, subject_id, object_id,
  'clm-' || {_SHORT.format("doc_id || ':' || seg_order || ':' || char_start || ':' || char_end || ':' || predicate")} AS claim_id, 0.8 AS confidence
  FROM c LEFT JOIN v USING (doc_id, seg_order, predicate))
"""


@query(_CHAIN_SQL + f"SELECT *, 'ext-' || {_SHORT.format('claim_id')} AS provenance FROM claims")
def claim_extract(spark, sf):
    """Claims of the chain, with their extraction records."""
    return _chain(spark, sf).claims.drop("polarity", "modality").withColumn("provenance", F.col("provenance_ref")[0]).drop("provenance_ref")


@query(_CHAIN_SQL + "SELECT 'promoted' AS status, '' AS reasons, count(*) AS n FROM claims")
def claim_gate(spark, sf):
    """What the gate says of them: all have a subject, a span, a known predicate and a record."""
    return _chain(spark, sf).gated.groupBy("status", F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


_CLAIMS_SQL = "SELECT ((l_orderkey * 10000 + l_partkey % 10000) * 10 + l_linenumber) * 100000 + CAST(round(l_extendedprice * 100) AS BIGINT) % 100000 AS claim_id, l_orderkey AS subject_id, l_returnflag AS predicate, l_partkey AS object_id, l_suppkey AS doc_id, l_linestatus AS polarity, l_linenumber AS seg_order, l_shipdate, l_discount FROM lineitem"


def _claims(spark, sf):
    line = _t(spark, sf, "lineitem")
    return line.select((((F.col("l_orderkey") * 10000 + F.col("l_partkey") % 10000) * 10 + F.col("l_linenumber")) * 100000 + F.round(F.col("l_extendedprice") * 100).cast("long") % 100000).alias("claim_id"), F.col("l_orderkey").alias("subject_id"), F.col("l_returnflag").alias("predicate"), F.col("l_partkey").alias("object_id"), F.col("l_suppkey").alias("doc_id"), F.col("l_linestatus").alias("polarity"), F.col("l_linenumber").alias("seg_order"), "l_shipdate", "l_discount")


@query(f"""WITH c AS ({_CLAIMS_SQL}), g AS (SELECT claim_id, list_filter([CASE WHEN l_discount > 0.09 THEN 'confidence_out_of_range' END, CASE WHEN predicate NOT IN ('A', 'N') THEN 'unknown_predicate:' || predicate END, CASE WHEN l_discount < 0.02 THEN 'low_confidence' END], lambda x: x IS NOT NULL) AS r FROM c)
SELECT array_to_string(r, ',') AS reasons, CASE WHEN len(r) = 0 THEN 'promoted' ELSE 'quarantined' END AS status, count(*) AS n FROM g GROUP BY ALL""")
def gate_reasons(spark, sf):
    c = F.col
    found = claims.reasons((c("l_discount") > 0.09, "confidence_out_of_range"), (~c("predicate").isin("A", "N"), F.concat(F.lit("unknown_predicate:"), c("predicate"))), (c("l_discount") < 0.02, "low_confidence"))
    return claims.gated(_claims(spark, sf), found).groupBy(F.array_join("reasons", ",").alias("reasons"), "status").agg(F.count("*").alias("n"))


@query(f"""WITH c AS ({_CLAIMS_SQL}), x AS (SELECT subject_id, predicate, polarity, min(claim_id) AS m, count(*) AS n FROM c GROUP BY ALL) SELECT subject_id, predicate, m AS canonical_min, n AS n_members, polarity AS canonical_text FROM x""")
def canonical_claims(spark, sf):
    rows = _claims(spark, sf).withColumn("surface_fragment", F.col("polarity")).withColumn("char_start", F.lit(0)).withColumn("char_end", F.lit(0))
    return claims.canonical_claims(rows).select("subject_id", "predicate", "canonical_min", "n_members", "canonical_text")


@query(f"""WITH c AS ({_CLAIMS_SQL}) SELECT a.claim_id AS a, b.claim_id AS b, CASE WHEN a.polarity <> b.polarity THEN 'polarity' ELSE 'value_conflict' END AS kind FROM c a JOIN c b ON a.subject_id = b.subject_id AND a.predicate = b.predicate AND a.claim_id < b.claim_id WHERE a.polarity <> b.polarity OR a.object_id <> b.object_id""")
def conflict_pairs(spark, sf):
    return claims.conflicts(_claims(spark, sf))


@query(f"""WITH c AS ({_CLAIMS_SQL}) SELECT count(*) AS n, kind FROM (SELECT CASE WHEN a.polarity <> b.polarity THEN 'polarity' ELSE 'value_conflict' END AS kind, a.claim_id AS x, b.claim_id AS y FROM c a JOIN c b ON a.subject_id = b.subject_id AND a.predicate = b.predicate AND a.claim_id < b.claim_id WHERE (a.polarity <> b.polarity OR a.object_id <> b.object_id) AND NOT (a.claim_id % 3 = 0)) GROUP BY kind""")
def judged_conflicts(spark, sf):
    pairs = claims.conflicts(_claims(spark, sf))
    verdicts = pairs.select("a", "b", F.when(F.col("a") % 3 == 0, "no_conflict").otherwise("real_conflict").alias("verdict"))
    return claims.judged(pairs, verdicts).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT 'promote:' || o_orderkey AS idempotency_key FROM orders WHERE o_orderstatus = 'F'")
def promotion_mutations(spark, sf):
    return claims.mutations(_t(spark, sf, "orders").where("o_orderstatus = 'F'"), "o_orderkey").select("idempotency_key")


# evidence, conclusions and ranking
_CONFIDENCE_SQL = f"""SELECT subject_id, predicate, object_id, count(DISTINCT doc_id) AS evidence, count(DISTINCT doc_id % 50) AS independent, 1 - 1.0 / (count(DISTINCT doc_id % 50) + 1) AS support, 0.0 AS contradiction, 1.0 AS coverage, 1 - 1.0 / (count(DISTINCT doc_id % 50) + 1) AS confidence FROM ({_CLAIMS_SQL}) GROUP BY ALL"""


def _confidence(spark, sf):
    return evidence.confidence(_claims(spark, sf).withColumn("root_doc_id", F.col("doc_id") % 50))


@query(f"SELECT subject_id, predicate, object_id, evidence, independent, round(support, 6) AS support, round(confidence, 6) AS confidence FROM ({_CONFIDENCE_SQL})")
def assertion_confidence(spark, sf):
    return _confidence(spark, sf).select("subject_id", "predicate", "object_id", "evidence", "independent", F.round("support", 6).alias("support"), F.round("confidence", 6).alias("confidence"))


_CONCLUSION_SQL = f"SELECT subject_id, avg(support) AS support, avg(contradiction) AS contradiction, avg(confidence) AS value, avg(coverage) AS coverage, CAST(sum(independent) AS BIGINT) AS independent, count(*) AS assertions, count(*) FILTER (WHERE confidence < 0.4 OR evidence = 0) AS open_questions FROM ({_CONFIDENCE_SQL}) GROUP BY 1"


@query(f"SELECT subject_id, round(value, 6) AS value, round(coverage, 6) AS coverage, independent, assertions, open_questions FROM ({_CONCLUSION_SQL})")
def subject_conclusion(spark, sf):
    return evidence.conclusions(_confidence(spark, sf)).select("subject_id", F.round("value", 6).alias("value"), F.round("coverage", 6).alias("coverage"), "independent", "assertions", "open_questions")


@query(f"SELECT subject_id, independent, row_number() OVER (ORDER BY round(value, 6) DESC, independent DESC, subject_id) AS position FROM ({_CONCLUSION_SQL})")
def subject_ranking(spark, sf):
    c = evidence.conclusions(_confidence(spark, sf)).withColumn("value", F.round("value", 6))
    return evidence.ranked(c).select("subject_id", "independent", "position")


@query(f"SELECT CASE WHEN contradiction > 0.5 THEN 'contradicted' WHEN independent <= 1 THEN 'low_evidence' WHEN value >= 0.8 THEN 'high_confidence' ELSE 'normal' END AS signal, count(*) AS n FROM ({_CONCLUSION_SQL}) GROUP BY 1")
def signal_distribution(spark, sf):
    c = evidence.conclusions(_confidence(spark, sf))
    return c.groupBy(evidence.signal(F.col("value"), F.col("contradiction"), F.col("independent")).alias("signal")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, coalesce(n, 0) AS evidence, coalesce(n, 0) > 0 AS covered FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON p_partkey = l_partkey")
def coverage_gaps(spark, sf):
    line = _t(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return evidence.coverage(_t(spark, sf, "part").select("p_partkey"), line, "p_partkey").drop("gain")


@query("SELECT p_partkey, round(CASE WHEN l_partkey IS NULL THEN 1.0 / (SELECT count(*) FROM part) ELSE 0.0 END, 9) AS gain FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount > 0.09 AND l_quantity > 30) ON p_partkey = l_partkey")
def gap_gains(spark, sf):
    line = _t(spark, sf, "lineitem").where("l_discount > 0.09 and l_quantity > 30").select(F.col("l_partkey").alias("p_partkey"))
    return evidence.coverage(_t(spark, sf, "part").select("p_partkey"), line, "p_partkey").select("p_partkey", F.round("gain", 9).alias("gain"))


@query("SELECT o_orderkey AS statement, c_custkey IS NOT NULL AND r IS NOT NULL AS linked, r AS record_id FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, min(l_linenumber) AS r FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def audit_trace(spark, sf):
    orders = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    known = orders.select(F.col("o_orderkey").alias("claim_id"), F.col("c_custkey").alias("doc_id"))
    records = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("record_id"))
    return evidence.trace(known.select(F.col("claim_id")), known, records).select(F.col("claim_id").alias("statement"), "linked", "record_id")


_CONFLICTS_SQL = f"WITH c AS ({_CLAIMS_SQL}), k AS (SELECT a.claim_id AS a, b.claim_id AS b, a.subject_id, CASE WHEN a.polarity <> b.polarity THEN 'polarity' ELSE 'value_conflict' END AS kind FROM c a JOIN c b ON a.subject_id = b.subject_id AND a.predicate = b.predicate AND a.claim_id < b.claim_id WHERE a.polarity <> b.polarity OR a.object_id <> b.object_id)"


@query(f"{_CONFLICTS_SQL} SELECT a, b, kind FROM k WHERE subject_id = (SELECT min(subject_id) FROM k)")
def counter_evidence(spark, sf):
    c = _claims(spark, sf)
    disputed = c.groupBy("subject_id", "predicate").agg(F.countDistinct("object_id").alias("o"), F.countDistinct("polarity").alias("p")).where("o > 1 or p > 1")
    return evidence.counter_evidence(c, F.lit(disputed.agg(F.min("subject_id")).first()[0]))


# time
_VERSIONS_SQL = "SELECT event_id, user_id, event_type, ts AS tx_from, lead(ts) OVER w AS tx_to, lag(event_id) OVER w AS supersedes FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def _versions(spark, sf):
    return bitemporal.versions(_t(spark, sf, "events"), "user_id", "ts", "event_id")


@query(f"SELECT event_id, user_id, event_type FROM ({_VERSIONS_SQL}) WHERE tx_from <= TIMESTAMP '2024-01-15 00:00:00' AND (tx_to IS NULL OR TIMESTAMP '2024-01-15 00:00:00' < tx_to)")
def assertions_as_of(spark, sf):
    at = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return bitemporal.as_of(_versions(spark, sf), tx_at=at).select("event_id", "user_id", "event_type")


@query(f"WITH v AS ({_VERSIONS_SQL}) SELECT epoch_us(x) AS at_us, id, kind FROM (SELECT tx_from AS x, event_id AS id, 'asserted' AS kind FROM v UNION ALL SELECT tx_to, event_id, 'closed' FROM v WHERE tx_to IS NOT NULL UNION ALL SELECT tx_from, event_id, 'superseded' FROM v WHERE supersedes IS NOT NULL)")
def chronicle_events(spark, sf):
    return bitemporal.chronicle(_versions(spark, sf), "event_id").select(F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), "id", "kind")


@query(f"WITH v AS ({_VERSIONS_SQL}) SELECT epoch_us(min(tx_from)) AS first_us, epoch_us(max(coalesce(tx_to, tx_from))) AS last_us, count(*) AS n FROM v")
def bitemporal_bounds(spark, sf):
    b = bitemporal.bounds(_versions(spark, sf))
    return b.select(F.unix_micros(F.col("first_at").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last_at").cast("timestamp")).alias("last_us"), "n")


@query("SELECT user_id, count(*) AS n, arg_max(event_type, {'t': ts, 'e': event_id}) AS state FROM events WHERE ts <= TIMESTAMP '2024-01-10 12:00:00' GROUP BY 1")
def tx_time_travel(spark, sf):
    log = _t(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    seen = graph.at_time(log, F.lit("2024-01-10 12:00:00").cast("timestamp"))
    return seen.groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))


@query(f"SELECT user_id, event_id, coalesce(epoch_us(last_end) > epoch_us(tx_from), false) AS overlaps FROM (SELECT user_id, event_id, tx_from, lag(tx_to) OVER (PARTITION BY user_id ORDER BY tx_from, tx_to) AS last_end FROM ({_VERSIONS_SQL}))")
def adjacent_overlaps(spark, sf):
    return bitemporal.overlaps_before(_versions(spark, sf), ["user_id"], "tx_from", "tx_to").select("user_id", "event_id", "overlaps")


# graph
def _log(spark, sf):
    e = _t(spark, sf, "events")
    op = F.when(F.col("event_type") == "signup", "create_node").when(F.col("event_type") == "error", "delete_node").otherwise("create_edge")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("idempotency_key"), op.alias("op"), F.col("user_id").alias("id"), F.lit("User").alias("type"), F.col("user_id").alias("from"), F.pmod(F.col("user_id") + F.col("event_id"), F.lit(150)).alias("to"), F.create_map(F.lit("value"), F.round("value", 3).cast("string")).alias("props"))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS keys FROM events")
def idempotent_events(spark, sf):
    log = _log(spark, sf)
    return graph.first_per_key(log.union(log)).agg(F.count("*").alias("n"), F.countDistinct("idempotency_key").alias("keys"))


_NODES_SQL = "WITH m AS (SELECT user_id AS id, min(event_id) AS first_seq FROM events WHERE event_type = 'signup' GROUP BY 1), d AS (SELECT user_id AS id, max(event_id) AS gone FROM events WHERE event_type = 'error' GROUP BY 1), n AS (SELECT m.id, first_seq, gone FROM m LEFT JOIN d USING (id))"


@query(_NODES_SQL + " SELECT id, CASE WHEN gone > first_seq THEN 'Deleted' ELSE 'User' END AS label, first_seq FROM n")
def mutation_replay(spark, sf):
    return graph.replay_nodes(_log(spark, sf)).select("id", "label", "first_seq")


_ENDS_SQL = ", e AS (SELECT event_id AS seq, user_id AS src, (user_id + event_id) % 150 AS dst FROM events WHERE event_type NOT IN ('signup', 'error')), j AS (SELECT seq, src, dst, coalesce(a.first_seq < seq AND b.first_seq < seq, false) AS stood, coalesce(a.gone > seq, false) OR coalesce(b.gone > seq, false) AS cut FROM e LEFT JOIN n a ON src = a.id LEFT JOIN n b ON dst = b.id)"


@query(_NODES_SQL + _ENDS_SQL + " SELECT seq, src, dst, 'dangling_ref' AS reason FROM j WHERE NOT stood")
def dangling_edges(spark, sf):
    log = _log(spark, sf)
    return graph.replay_edges(log, graph.replay_nodes(log))[1].drop("type")


@query(_NODES_SQL + _ENDS_SQL + " SELECT seq, src, dst FROM j WHERE stood AND NOT cut")
def replayed_edges(spark, sf):
    log = _log(spark, sf)
    return graph.replay_edges(log, graph.replay_nodes(log))[0].drop("type")


def _edges(spark, sf):
    orders, line = _t(spark, sf, "orders"), _t(spark, sf, "lineitem")
    placed = orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst"), F.lit("PLACED").alias("type"))
    holds = line.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("HOLDS").alias("type"))
    return placed.union(holds)


_EDGES_SQL = "SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'PLACED' AS type FROM orders UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'HOLDS' FROM lineitem"


@query(f"WITH e AS ({_EDGES_SQL}) SELECT dst FROM e WHERE src = 'o1' UNION ALL SELECT src FROM e WHERE dst = 'o1'")
def graph_neighbors(spark, sf):
    return graph.neighbours(_edges(spark, sf), F.lit("o1"))


@query(f"WITH e AS ({_EDGES_SQL}) SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1")
def graph_degree(spark, sf):
    return graph.degrees(_edges(spark, sf))


@query(f"""WITH RECURSIVE e AS ({_EDGES_SQL}), b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)), r(node, depth) AS (SELECT 'c1', 0 UNION SELECT b.dst, r.depth + 1 FROM r JOIN b ON r.node = b.src WHERE r.depth < 3) SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY 1""")
def impact_scope(spark, sf):
    seeds = spark.createDataFrame([("c1",)], "node string")
    return graph.impact(spark, _edges(spark, sf), seeds, 3).withColumn("depth", F.col("depth").cast("long"))


@query(f"""WITH RECURSIVE e AS ({_EDGES_SQL}), b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)), r(node, depth) AS (SELECT 'c1', 0 UNION SELECT b.dst, r.depth + 1 FROM r JOIN b ON r.node = b.src WHERE r.depth < 2), s AS (SELECT DISTINCT node FROM r) SELECT type, count(*) AS n FROM e WHERE src IN (SELECT node FROM s) AND dst IN (SELECT node FROM s) GROUP BY 1""")
def investigation_subgraph(spark, sf):
    edges = _edges(spark, sf)
    scope = graph.impact(spark, edges, spark.createDataFrame([("c1",)], "node string"), 2)
    return graph.subgraph(edges, scope).groupBy("type").agg(F.count("*").alias("n"))


@query("WITH RECURSIVE p AS (SELECT n_nationkey AS node, n_nationkey - 5 AS target FROM nation WHERE n_nationkey >= 5), r(node, x) AS (SELECT node, target FROM p UNION ALL SELECT r.node, p.target FROM r JOIN p ON r.x = p.node) SELECT node, min(x) AS root FROM r GROUP BY 1")
def equivalence_class(spark, sf):
    n = _t(spark, sf, "nation").where("n_nationkey >= 5")
    log = n.select(F.lit("merge").alias("op"), F.col("n_nationkey").alias("member"), (F.col("n_nationkey") - 5).alias("canonical"), F.col("n_nationkey").alias("seq"))
    return graph.canonical_of(log)


@query("SELECT tier, count(*) AS n FROM (SELECT c_custkey, CASE WHEN max(ts) IS NULL THEN 'unknown' WHEN epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(max(ts))) <= 3 * 86400 THEN 'hot' ELSE 'cold' END AS tier FROM customer LEFT JOIN events ON c_custkey = user_id GROUP BY 1) GROUP BY 1")
def temperature_tiers(spark, sf):
    last = _t(spark, sf, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").cast("timestamp").alias("last"))
    rows = _t(spark, sf, "customer").select("c_custkey").join(last, "c_custkey", "left")
    tier = graph.temperature(F.col("last"), F.lit("2024-01-31 00:00:00").cast("timestamp"), 3 * 86400)
    return rows.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


# retrieval
@query("""WITH q AS (SELECT 1 AS query_id, unnest(['the', 'tion', 'and', 'the']) AS term UNION ALL SELECT 2, unnest(['der', 'und', 'sch'])), t AS (SELECT query_id, term, count(*) AS times FROM q GROUP BY ALL),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{AC00}-\\x{D7A3}]+') AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
f AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM t) GROUP BY ALL), g AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
x AS (SELECT query_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * l / a)) AS score FROM f JOIN g USING (term) JOIN t USING (term), s GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM x) WHERE rank <= 5""")
def bm25_topk(spark, sf):
    q = spark.createDataFrame([(1, "the tion and the"), (2, "der und sch")], "query_id int, query string")
    return retrieval.bm25(spark, _t(spark, sf, "documents"), q).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _few_vectors(spark, sf):
    return _t(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query("""SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)) WHERE rank <= 5""")
def cosine_topk(spark, sf):
    return retrieval.cosine_topk(_t(spark, sf, "embeddings"), _few_vectors(spark, sf)).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("""WITH l AS (SELECT o_custkey AS query_id, o_orderkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), r AS (SELECT o_custkey AS query_id, o_orderkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders)
SELECT query_id, doc, round(sum(1.0 / (60 + rank)), 6) AS rrf FROM (SELECT * FROM l UNION ALL SELECT * FROM r) GROUP BY ALL""")
def rrf_fusion(spark, sf):
    rows = _t(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc"), "o_totalprice", "o_orderdate")
    l = retrieval.top_k(rows, ["query_id"], [F.desc("o_totalprice"), F.asc("doc")], 1 << 30)
    r = retrieval.top_k(rows, ["query_id"], [F.asc("o_orderdate"), F.asc("doc")], 1 << 30)
    return retrieval.fuse([l, r], "doc").withColumn("rrf", F.round("rrf", 6))


# rates, dwell and windows
@query("WITH g AS (SELECT date_trunc('hour', (SELECT max(ts) FROM events)) - to_hours(CAST(i AS INTEGER)) AS hour FROM range(24) t(i)) SELECT epoch_us(hour) AS hour_us, count(event_id) AS n FROM g LEFT JOIN events ON date_trunc('hour', ts) = hour GROUP BY 1")
def hourly_arrivals(spark, sf):
    e = _t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    end = F.lit(e.agg(F.max("ts")).first()[0])
    return metrics.hourly(e, "ts", end).select(F.unix_micros("hour").alias("hour_us"), "n")


@query("SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark, sf):
    e = _t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = e.groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.unix_micros("window.start").alias("start_us"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf):
    e = _t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = e.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type <> 'error') AS passed, count(*) AS total FROM events GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, passed, total, round(sum(passed) OVER w / sum(total) OVER w, 6) AS rolling_rate FROM d WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""")
def rolling_7d_rate(spark, sf):
    return metrics.rolling_rate(_t(spark, sf, "events"), "ts", F.col("event_type") != "error").withColumn("day", F.col("day").cast("string"))


@query("SELECT event_type, round(list_sort(list(value))[CAST(floor(0.95 * (count(*) - 1)) AS INTEGER) + 1], 3) AS p95, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def p95_latency(spark, sf):
    rows = order.at_place(_t(spark, sf, "events"), ["event_type"], "value", F.floor(F.lit(0.95) * (F.col("n") - 1)), "p95")
    return rows.select("event_type", F.round("p95", 3).alias("p95"), "n")


@query("""WITH c AS (SELECT user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events WHERE event_type IN ('view', 'purchase')), k AS (SELECT * FROM c WHERE b IS NULL OR b <> event_type), l AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS left_at FROM k)
SELECT user_id, epoch_us(ts) AS entered_us, epoch_us(left_at) - epoch_us(ts) AS dwell_us FROM l WHERE event_type = 'view'""")
def dwell_times(spark, sf):
    e = _t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    d = metrics.dwell(e, "user_id", "ts", "event_type", "view", "purchase")
    return d.select("user_id", F.unix_micros("entered").alias("entered_us"), "dwell_us")


@query("SELECT source, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, list_sort(list(n_chars))[count(*) // 2 + 1] AS upper_median FROM documents GROUP BY 1")
def freshness_summary(spark, sf):
    docs = _t(spark, sf, "documents")
    rows = docs.groupBy("source").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))
    return rows.join(order.at_place(docs, ["source"], "n_chars", F.floor(F.col("n") / 2), "upper_median"), "source").select("source", "n", "least", "most", "upper_median")


@query("SELECT user_id, round(CAST(count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS DOUBLE) / count(*), 6) AS density FROM events GROUP BY 1")
def signal_density(spark, sf):
    rows = _t(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("docs"), F.count_if(F.col("event_type").isin("click", "purchase")).alias("signals"))
    return rows.select("user_id", F.round(metrics.density(F.col("docs"), F.col("signals")), 6).alias("density"))


@query("""WITH s AS (SELECT source, avg(n_chars) / 10000.0 AS density, 5.0 AS floor FROM documents GROUP BY 1) SELECT source, round(floor + (1000.0 - sum(floor) OVER ()) * density / sum(density) OVER (), 3) AS allocated FROM s""")
def budget_allocation(spark, sf):
    s = _t(spark, sf, "documents").groupBy("source").agg((F.avg("n_chars") / 10000.0).alias("density")).withColumn("floor", F.lit(5.0))
    return metrics.allocate(s, 1000.0).select("source", "allocated")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def fire_once_alerts(spark, sf):
    e = _t(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    return metrics.fire_once(e, F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_type")), "at").select("event_id", "user_id", "event_type")


@query("SELECT event_id, round(abs(value - b), 6) AS jump FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE abs(value - b) >= 50")
def confidence_triggers(spark, sf):
    e = _t(spark, sf, "events").withColumn("before", F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.where(F.abs(F.col("value") - F.col("before")) >= 50).select("event_id", F.round(F.abs(F.col("value") - F.col("before")), 6).alias("jump"))


@query("SELECT event_type, round(avg(CAST(value > 50 AS INTEGER)), 4) AS rate, count(*) FILTER (WHERE value IS NULL) AS unknown FROM events GROUP BY 1")
def known_rates(spark, sf):
    return _t(spark, sf, "events").groupBy("event_type").agg(metrics.known_rate(F.col("value") > 50).alias("rate"), F.count_if(F.col("value").isNull()).alias("unknown"))


@query("SELECT event_id, CAST(greatest(1, ceil(event_id / 300.0)) * 300 - event_id AS BIGINT) AS wait_s FROM events")
def commit_latency(spark, sf):
    return _t(spark, sf, "events").select("event_id", metrics.next_commit(F.col("event_id"), 300).cast("long").alias("wait_s"))


# promotion and evaluation
@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def promotion_antijoin(spark, sf):
    return store.new_rows(_t(spark, sf, "documents"), _t(spark, sf, "labels"))


@query("SELECT count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def promotion_gap(spark, sf):
    return store.gap(_t(spark, sf, "documents"), _t(spark, sf, "labels"))[0]


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def incremental_equals_full(spark, sf):
    docs = _t(spark, sf, "documents")
    known = docs.join(_t(spark, sf, "labels"), "doc_id", "left_semi")
    late = docs.join(_t(spark, sf, "labels"), "doc_id", "left_anti")
    return store.merge(known, late, ["doc_id"]).groupBy("source").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT quality = 1 AS truth, n_chars >= 1000 AS said FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (WHERE truth AND said) AS tp, count(*) FILTER (WHERE NOT truth AND said) AS fp, count(*) FILTER (WHERE truth AND NOT said) AS fn FROM p)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def golden_prf(spark, sf):
    p = _t(spark, sf, "labels").join(_t(spark, sf, "documents"), "doc_id")
    c = metrics.confusion(p, F.col("quality") == 1, F.col("n_chars") >= 1000)
    return c.select("tp", "fp", "fn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query("""WITH b AS (SELECT o_orderpriority AS metric, avg(o_totalprice) / 1e6 AS v FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY 1), c AS (SELECT o_orderpriority AS metric, avg(o_totalprice) / 1e6 AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1)
SELECT metric, round((coalesce(c.v, 0) - coalesce(b.v, 0)) * 100, 6) AS delta_pp, round((coalesce(c.v, 0) - coalesce(b.v, 0)) * 100, 6) < -0.1 AS regressed FROM b FULL JOIN c USING (metric)""")
def regression_deltas(spark, sf):
    o = _t(spark, sf, "orders").withColumn("old", F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp"))
    part = lambda old: o.where(F.col("old") == old).groupBy(F.col("o_orderpriority").alias("metric")).agg((F.avg("o_totalprice") / 1e6).alias("value"))
    return metrics.regression(part(True), part(False), 0.1).select("metric", "delta_pp", "regressed")


@query("""WITH h AS (SELECT doc_id, sha256(text) AS h, lang FROM documents), r AS (SELECT h, min(doc_id) AS root FROM h GROUP BY 1), m AS (SELECT doc_id, root, lang FROM h JOIN r USING (h) WHERE doc_id <> root)
SELECT count(*) AS members, count(DISTINCT root) AS roots, count(*) FILTER (WHERE m.lang = d.lang) AS same_lang FROM m JOIN documents d ON m.root = d.doc_id""")
def lineage_members(spark, sf):
    docs = _t(spark, sf, "documents").withColumn("h", F.sha2("text", 256))
    m = docs.join(docs.groupBy("h").agg(F.min("doc_id").alias("root")), "h").where("doc_id != root")
    roots = docs.select(F.col("doc_id").alias("root"), F.col("lang").alias("root_lang"))
    return m.join(roots, "root").agg(F.count("*").alias("members"), F.countDistinct("root").alias("roots"), F.count_if(F.col("lang") == F.col("root_lang")).alias("same_lang"))


# dashboards, envelopes and stores
@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, count(*) AS n FROM lineitem GROUP BY ALL")
def metric_drilldown(spark, sf):
    d = metrics.drill_down(_t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"])
    return d.select("l_returnflag", "l_linestatus", F.round("sum_l_quantity", 2).alias("sum_qty"), F.round("sum_l_extendedprice", 2).alias("sum_price"), "n")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def filter_pivot(spark, sf):
    kinds = ["view", "click", "purchase"]
    rows = _t(spark, sf, "events").groupBy("user_id").pivot("event_type", kinds).count()
    return rows.select("user_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


@query("SELECT event_id, json_valid(props) AND event_type <> '' AS valid, len(props) > 60 AS oversized FROM events")
def envelope_validation(spark, sf):
    e = _t(spark, sf, "events").withColumn("event_id", F.col("event_id").cast("string")).withColumn("stage", F.lit("S3")).withColumn("occurred_at", F.col("ts")).withColumn("payload", F.col("props"))
    r = filters.envelope_reasons(e, 60)
    return e.select(F.col("event_id").cast("long").alias("event_id"), (~F.array_contains(r, "bad_json") & ~F.array_contains(r, "missing_event_type")).alias("valid"), F.array_contains(r, "oversized").alias("oversized"))


@query("SELECT conv_id, count(*) AS turns, arg_min(role, turn) AS opens, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def conversation_sessions(spark, sf):
    c = _t(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min_by("role", "turn").alias("opens"), F.sum(F.length("text")).alias("chars"))


_NEW_SQL = "SELECT DISTINCT subject_id, predicate FROM c WHERE l_shipdate >= TIMESTAMP '1998-11-01 00:00:00'"


@query(f"WITH c AS ({_CLAIMS_SQL}), n AS ({_NEW_SQL}), x AS (SELECT c.* FROM c JOIN n USING (subject_id, predicate)) SELECT CASE WHEN a.polarity <> b.polarity THEN 'polarity' ELSE 'value_conflict' END AS kind, count(*) AS n FROM x a JOIN x b ON a.subject_id = b.subject_id AND a.predicate = b.predicate AND a.claim_id < b.claim_id WHERE a.polarity <> b.polarity OR a.object_id <> b.object_id GROUP BY 1")
def reconciled_conflicts(spark, sf):
    c = _claims(spark, sf).withColumn("status", F.lit("promoted")).withColumn("surface_fragment", F.col("polarity")).withColumn("char_start", F.lit(0)).withColumn("char_end", F.lit(0))
    return claims.reconcile(c, c.where("l_shipdate >= timestamp_ntz'1998-11-01 00:00:00'"))[1].groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH c AS ({_CLAIMS_SQL}), p AS (SELECT *, lag(claim_id) OVER w AS b FROM c WINDOW w AS (PARTITION BY subject_id, predicate ORDER BY claim_id)), g AS (SELECT *, sum(CASE WHEN b IS NOT NULL AND claim_id % 2 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY subject_id, predicate ORDER BY claim_id) AS island FROM p) SELECT claim_id, min(claim_id) OVER (PARTITION BY subject_id, predicate, island) AS canonical_min FROM g")
def judged_canonical(spark, sf):
    c = _claims(spark, sf).withColumn("surface_fragment", F.col("claim_id").cast("string")).withColumn("char_start", F.lit(0)).withColumn("char_end", F.lit(0))
    before = F.lag("claim_id").over(Window.partitionBy("subject_id", "predicate").orderBy("claim_id"))
    pairs = c.select(before.alias("a"), F.col("claim_id").alias("b")).where("a is not null")
    verdicts = pairs.withColumn("relation", F.when(F.col("b") % 2 == 0, "equivalent").otherwise("unrelated")).withColumn("confidence", F.lit(0.9))
    return claims.canonical(c, verdicts)


@query(f"SELECT 'ext-' || {_SHORT.format('CAST(claim_id AS VARCHAR)')} AS extraction_id, CAST(claim_id AS VARCHAR) AS element_id, doc_id FROM ({_CLAIMS_SQL})")
def extraction_records(spark, sf):
    return extract.extraction_records(_claims(spark, sf), "claim_id").select("extraction_id", "element_id", "doc_id")


_MERGES_SQL = "WITH l AS (SELECT event_id AS seq, user_id AS member, user_id % 10 AS canonical, CASE event_type WHEN 'click' THEN 'merge' WHEN 'error' THEN 'unmerge' END AS op, event_type || event_id % 3 AS ref FROM events), u AS (SELECT member, canonical, max(seq) AS undone FROM l WHERE op = 'unmerge' GROUP BY ALL), m AS (SELECT l.member, l.canonical, ref AS resolution_ref, 'pipeline' AS decided_by, seq, undone IS NULL OR undone < seq AS live FROM l LEFT JOIN u USING (member, canonical) WHERE op = 'merge')"


def _merges(spark, sf):
    op = F.when(F.col("event_type") == "click", "merge").when(F.col("event_type") == "error", "unmerge")
    ref = F.concat("event_type", (F.col("event_id") % 3).cast("string"))
    return _t(spark, sf, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("member"), (F.col("user_id") % 10).alias("canonical"), ref.alias("ref"), F.create_map().cast("map<string,string>").alias("props"))


@query(f"{_MERGES_SQL} SELECT * FROM m")
def merge_audit(spark, sf):
    return graph.merge_audit(_merges(spark, sf))


@query(f"{_MERGES_SQL} SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY seq, member) AS seq, member, canonical, resolution_ref AS ref FROM m WHERE live AND resolution_ref = 'click1' AND member % 2 = 0")
def merge_rollbacks(spark, sf):
    log = _merges(spark, sf)
    wrong = log.where("member % 2 = 0").select("member", F.lit("click1").alias("resolution_ref"))
    return graph.rollbacks(log, wrong).drop("op")


@query(f"SELECT subject_id, CAST(sum(evidence) AS BIGINT) AS evidence_count, CAST(sum(independent) AS BIGINT) AS independent_source_count, round(1 - sum(independent) / sum(evidence), 4) AS dedup_ratio FROM ({_CONFIDENCE_SQL}) GROUP BY 1")
def independence_summary(spark, sf):
    return graph.independence(_confidence(spark, sf))


@query(f"SELECT count(*) AS n, round(min(confidence), 6) AS least, round(max(confidence), 6) AS most, round(median(confidence), 6) AS median FROM ({_CONFIDENCE_SQL})")
def confidence_summary(spark, sf):
    r = evidence.confidence_summary(_confidence(spark, sf))
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("least", "most", "median")])


@query(f"WITH a AS (SELECT DISTINCT seq, claim FROM (SELECT o_orderkey AS seq, 'c' || o_custkey AS node, 'o' || o_orderkey AS claim FROM orders) WHERE node IN ('c1', 'c2', 'c4')), k AS (SELECT * FROM a ORDER BY seq, claim LIMIT 12), e AS (SELECT 'p' || l_partkey AS evidence, 'o' || l_orderkey AS claim, CASE WHEN l_returnflag = 'R' THEN 'CONTRADICTS' ELSE 'SUPPORTS' END AS type, l_orderkey * 10 + l_linenumber AS seq FROM lineitem), f AS (SELECT evidence, arg_min({{'c': claim, 't': type}}, {{'s': seq, 'c': claim}}) AS x FROM e WHERE claim IN (SELECT claim FROM k) GROUP BY 1) SELECT 'claim' AS part, 'c1' AS src, claim AS dst, 'ABOUT' AS type, (SELECT count(*) FROM a) > 12 AS truncated FROM k UNION ALL SELECT 'evidence', evidence, x.c, x.t, (SELECT count(*) FROM a) > 12 FROM f")
def investigation_view(spark, sf):
    orders, line = _t(spark, sf, "orders"), _t(spark, sf, "lineitem")
    name = lambda sign, c: F.concat(F.lit(sign), F.col(c).cast("string"))
    about = orders.select(F.col("o_orderkey").alias("seq"), name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"), F.lit("ABOUT").alias("type"))
    bears = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), name("p", "l_partkey").alias("src"), name("o", "l_orderkey").alias("dst"), F.when(F.col("l_returnflag") == "R", "CONTRADICTS").otherwise("SUPPORTS").alias("type"))
    nodes = orders.select(name("o", "o_orderkey").alias("id")).union(line.select(name("p", "l_partkey"))).distinct().withColumn("deleted", F.lit(False))
    classes = spark.createDataFrame([("c2", "c1"), ("c4", "c1"), ("c1", "c1")], "node string, root string")
    return graph.investigation(about.union(bears), classes, nodes, F.lit("c2"), 12)


@query("WITH x AS (SELECT (user_id + event_id) % 150 AS target, CASE event_type WHEN 'error' THEN 'contradicting_evidence' WHEN 'click' THEN 'claim_changed' END AS trigger FROM events UNION SELECT user_id, 'claim_changed' FROM events WHERE event_type = 'click' UNION SELECT user_id, 'plan_to_execution' FROM events WHERE event_type = 'purchase' AND value > 90) SELECT DISTINCT 'i' || target % 7 AS investigation_id, trigger, target, 'i' || target % 7 || ':' || trigger || ':' || target AS dedup_key FROM x JOIN (SELECT DISTINCT user_id AS target FROM events) USING (target) WHERE trigger IS NOT NULL")
def alert_triggers(spark, sf):
    e = _t(spark, sf, "events")
    kind = F.when(F.col("event_type") == "error", "CONTRADICTS").when(F.col("event_type") == "click", "SUPERSEDES").otherwise("RELATED")
    made = F.when(F.col("event_type") == "purchase", "create_node").otherwise("create_edge")
    status = F.create_map(F.lit("status"), F.when(F.col("value") > 90, "confirmed").otherwise("planned"))
    log = e.select(made.alias("op"), kind.alias("type"), F.col("user_id").alias("from"), F.pmod(F.col("user_id") + F.col("event_id"), F.lit(150)).alias("to"), F.col("user_id").alias("id"), status.alias("props"))
    watched = e.select(F.col("user_id").alias("target")).distinct().withColumn("investigation_id", F.concat(F.lit("i"), (F.col("target") % 7).cast("string")))
    return promotion.alerts(log, watched)


@query("WITH s AS (SELECT user_id AS source, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) / count(*) AS density, max(ts) AS last FROM events GROUP BY 1), p AS (SELECT *, CASE WHEN density >= 0.25 THEN 'high' WHEN density < 0.15 THEN 'low' ELSE 'normal' END AS priority FROM s), l AS (SELECT *, CASE priority WHEN 'high' THEN 1800 WHEN 'low' THEN 14400 ELSE 3600 END AS interval_s, CAST(epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(last)) AS BIGINT) AS lag_s FROM p) SELECT source, priority, interval_s, lag_s, lag_s > interval_s AS overdue FROM l")
def adaptive_schedule(spark, sf):
    s = _t(spark, sf, "events").groupBy(F.col("user_id").alias("source")).agg((F.count_if(F.col("event_type") == "purchase") / F.count("*")).alias("density"), F.max("ts").cast("timestamp").alias("last"))
    s = s.withColumn("density", (F.col("density") - 0.15) / 0.10 * 0.4 + 0.1)
    return promotion.adaptive_schedule(s, F.lit("2024-01-31 00:00:00").cast("timestamp"))


@query("WITH b AS (SELECT source, doc_id, doc_id % 3 = 0 AS a, doc_id % 2 = 0 AND doc_id % 3 = 0 AS b FROM documents) SELECT 'S1' AS stage, count(*) AS n FROM b WHERE NOT a UNION ALL SELECT 'S2', count(*) FROM b WHERE NOT b")
def outbox_pending(spark, sf):
    refs = _t(spark, sf, "documents").select(F.col("source").alias("source_id"), "doc_id", F.lit("u").alias("url"))
    box = promotion.outbox_add(refs.limit(0).withColumn("s1_acked", F.lit(False)).withColumn("s2_acked", F.lit(False)), refs)
    sent = refs.where("doc_id % 3 = 0").select("source_id", "doc_id", F.lit("S1").alias("stage")).union(refs.where("doc_id % 6 = 0").select("source_id", "doc_id", F.lit("S2")))
    box = promotion.outbox_ack(promotion.outbox_add(box, refs), sent).withColumn("doc_id", F.col("doc_id").cast("string"))
    return promotion.outbox_pending(box, 1 << 30).groupBy("stage").agg(F.count("*").alias("n"))


_AXES_SQL = "SELECT doc_id % 10 AS question_id, 'coverage' AS axis, quality AS good FROM labels UNION ALL SELECT doc_id % 10, 'modality', 1 - toxic FROM labels"


@query(f"SELECT question_id, axis, true AS measured, round(value, 6) AS value, value >= CASE axis WHEN 'coverage' THEN 0.9 ELSE 0.95 END AS passed FROM (SELECT question_id, axis, avg(good) AS value FROM ({_AXES_SQL}) GROUP BY ALL)")
def quality_axes(spark, sf):
    l = _t(spark, sf, "labels").withColumn("question_id", F.col("doc_id") % 10)
    counts = l.select("question_id", F.lit("coverage").alias("axis"), F.col("quality").alias("good"), F.lit(1).alias("total")).union(l.select("question_id", F.lit("modality"), 1 - F.col("toxic"), F.lit(1)))
    return evaluate.quality_axes(counts).withColumn("value", F.round("value", 6))


@query("WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS fn FROM labels) SELECT 'entity_resolution' AS slice, true AS measured, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(fp / (tp + fp), 6) AS wrong_merge_rate, tp / (tp + fp) >= 0.97 AND tp / (tp + fn) >= 0.0 AS passed FROM c UNION ALL SELECT 'lineage', false, NULL, NULL, NULL, NULL, NULL, NULL, NULL")
def metrics_report(spark, sf):
    pairs = _t(spark, sf, "labels").select(F.lit("entity_resolution").alias("slice"), (F.col("quality") == 1).alias("truth"), (F.col("toxic") == 0).alias("said"))
    r = evaluate.metrics_report(pairs, {"entity_resolution": (0.97, 0.0), "lineage": (0.98, 0.9)}).drop("f1")
    return r.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "wrong_merge_rate")})


@query("SELECT 'customer' AS zone, count(*) AS total FROM customer WHERE contains(lower(c_name), '12') UNION ALL SELECT 'part', count(*) FROM part WHERE contains(lower(p_name), '12') OR contains(lower(p_brand), '12') UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE contains(lower(s_name), '12')")
def zone_search(spark, sf):
    zones = {"customer": (_t(spark, sf, "customer"), "c_custkey", ["c_name"]), "part": (_t(spark, sf, "part"), "p_partkey", ["p_name", "p_brand"]), "supplier": (_t(spark, sf, "supplier"), "s_suppkey", ["s_name"])}
    return retrieval.search_all(zones, "12")[0]


@query("SELECT event_type, epoch_us(max(ts)) AS latest_us, count(*) AS n, arg_min(user_id, {'t': ts, 'e': event_id}) AS first_user_id FROM events GROUP BY 1")
def source_governance(spark, sf):
    e = _t(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    g = metrics.governance(e, "event_type", "at", "user_id")
    return g.select("event_type", F.unix_micros(F.col("latest.ts").cast("timestamp")).alias("latest_us"), "n", "first_user_id")


@query(f"WITH c AS ({_CLAIMS_SQL}) SELECT 'predicate' AS kind, predicate AS name, count(*) AS n FROM c GROUP BY 2 UNION ALL SELECT 'status', 'quarantined', count(*) FILTER (WHERE l_discount > 0.09) FROM c")
def claim_overview(spark, sf):
    c = _claims(spark, sf).withColumn("status", F.when(F.col("l_discount") > 0.09, "quarantined").otherwise("promoted"))
    return metrics.overview(c)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' AND l_quantity < 10 THEN 'missing: canonical_text' WHEN l_returnflag = 'R' THEN 'unknown relation' WHEN l_discount > 0.08 THEN 'confidence not in [0,1]' END AS reason FROM lineitem")
def record_validation(spark, sf):
    relation = F.when(F.col("l_returnflag") == "R", "same").otherwise("equivalent")
    said = F.when(~((F.col("l_linestatus") == "F") & (F.col("l_quantity") < 10)), "t")
    record = F.to_json(F.struct(relation.alias("relation"), said.alias("canonical_text"), F.when(F.col("l_discount") > 0.08, 1.5).otherwise(F.col("l_discount")).alias("confidence")))
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", filters.record_reason(record, "canonical_verdict").alias("reason"))


def _scratch(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_promote(spark, sf):
    """Every event is promoted once, though the stream brings each twice."""
    base = _scratch(spark, "stream-promote")
    e = _t(spark, sf, "events")
    e.write.parquet(f"{base}/in")
    e.write.mode("append").parquet(f"{base}/in")
    stream = promotion.file_stream(spark, f"{base}/in", e.schema.simpleString()[7:-1].replace(":", " "), 1000)
    promotion.run_available(stream, promotion.promote("event_id", f"{base}/out"), f"{base}/check")
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@query("WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages), g AS (SELECT host, count(*) AS n FROM h GROUP BY 1 HAVING count(*) >= 2 ORDER BY 1 LIMIT 20) SELECT host, n, array_to_string(list_sort(list(page_id))[1:5], ',') AS keys FROM h JOIN g USING (host) GROUP BY host, n")
def url_group_ids(spark, sf):
    rows = _t(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host"))
    g = metrics.first_of_groups(rows, "host", "page_id")
    return g.select("host", "n", F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("keys"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 1000 AS batch FROM documents WHERE doc_id % 4 <> 0")
def promotion_batches(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id")
    return store.batches(store.new_rows(docs, docs.where("doc_id % 4 = 0")))


@query("SELECT count(*) AS n FROM orders")
def parquet_digest(spark, sf):
    o = _t(spark, sf, "orders")
    a, b = store.digest(o), store.digest(o.repartition(5, "o_custkey"))
    return a.join(b, ["n", "checksum"]).select("n")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS k, o_orderdate FROM orders) WHERE k > 5 AND o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY")
def snapshot_expiry(spark, sf):
    s = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return store.plan_expiry(s, F.lit("1998-01-01").cast("timestamp"), 30, 5).select(F.col("snapshot_id").alias("o_orderkey"))


# evaluation and gates
@query("""WITH g AS (SELECT o_custkey AS custkey, min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders GROUP BY 1), j AS (SELECT x.o_orderpriority = y.o_orderpriority AS truth, x.o_orderstatus = y.o_orderstatus AS said FROM g JOIN orders x ON a = x.o_orderkey JOIN orders y ON b = y.o_orderkey WHERE a < b),
c AS (SELECT count(*) FILTER (WHERE truth AND said) AS tp, count(*) FILTER (WHERE NOT truth AND said) AS fp, count(*) FILTER (WHERE truth AND NOT said) AS fn FROM j) SELECT tp, fp, fn, tp + fp + fn > 0 AS measured, tp / (tp + fp) >= 0.1 AND tp / (tp + fn) >= 0.4 AS passed FROM c""")
def golden_groups(spark, sf):
    o = _t(spark, sf, "orders")
    pairs = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b")).where("a < b")
    side = lambda c, n: o.select(F.col("o_orderkey").alias(c), F.col("o_orderpriority").alias(n))
    pairs = pairs.join(side("a", "pa"), "a").join(side("b", "pb"), "b")
    rows = evaluate.same_group(pairs, o.select(F.col("o_orderkey").alias("element"), F.col("o_orderstatus").alias("group")))
    r = evaluate.report(rows, F.col("pa") == F.col("pb"), F.col("said"), 0.1, 0.4)
    return r.select("tp", "fp", "fn", "measured", "passed")


@query("SELECT o_orderpriority AS metric, CASE WHEN avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P') IS NULL THEN 'init' WHEN avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') >= avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') THEN 'promote' ELSE 'keep' END AS action FROM orders GROUP BY 1")
def promotion_gate(spark, sf):
    o = _t(spark, sf, "orders")
    part = lambda st: o.where(F.col("o_orderstatus") == st).groupBy(F.col("o_orderpriority").alias("metric")).agg(F.avg("o_totalprice").alias("value"))
    return evaluate.promotion(part("F"), part("O")).select("metric", "action")


@query("SELECT c_mktsegment AS metric, max(c_custkey) AS version FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def active_baseline(spark, sf):
    c = _t(spark, sf, "customer").select(F.col("c_mktsegment").alias("metric"), F.col("c_acctbal").alias("value"), F.col("c_custkey").alias("version"), (F.col("c_acctbal") > 0).alias("active"))
    return evaluate.active_baseline(c).select("metric", "version")


@query("""WITH o AS (SELECT event_type AS slo, avg(value) AS value FROM events GROUP BY 1), t AS (SELECT * FROM (VALUES ('view', 50.0, true), ('click', 50.0, false), ('purchase', 0.0, true), ('absent', 1.0, true)) AS t(slo, bound, at_least))
SELECT slo, CASE WHEN value IS NULL THEN 'not_measured' WHEN CASE WHEN at_least THEN value >= bound ELSE value <= bound END THEN 'pass' ELSE 'fail' END AS outcome FROM t LEFT JOIN o USING (slo)""")
def service_levels(spark, sf):
    observed = _t(spark, sf, "events").groupBy(F.col("event_type").alias("slo")).agg(F.avg("value").alias("value"))
    targets = spark.createDataFrame([("view", 50.0, True), ("click", 50.0, False), ("purchase", 0.0, True), ("absent", 1.0, True)], "slo string, bound double, at_least boolean")
    return evaluate.service_levels(observed, targets).select("slo", "outcome")


@query("SELECT count(*) FILTER (WHERE value IS NOT NULL) AS measured, count(*) FILTER (WHERE value < 5) AS failed, round(count(*) FILTER (WHERE value < 5) / count(*) FILTER (WHERE value IS NOT NULL), 6) AS failed_share FROM events")
def error_budget(spark, sf):
    e = _t(spark, sf, "events").select(metrics.slo(F.col("value"), 5.0).alias("outcome"))
    return evaluate.error_budget(e, 0.1).select("measured", "failed", F.round("failed_share", 6).alias("failed_share"))


@query("SELECT l_returnflag AS predicate, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'quarantine' ELSE 'regate' END AS action, count(*) AS n FROM lineitem GROUP BY ALL")
def migration_actions(spark, sf):
    rows = evaluate.migration(_t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("predicate")), text.migration_level(F.lit("1.2.0"), F.lit("1.3.0")), ["A", "N"])
    return rows.groupBy("predicate", "action").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars, CAST(len(list(doc_id)) AS BIGINT) AS ids FROM documents GROUP BY 1")
def merged_results(spark, sf):
    parts = _t(spark, sf, "documents").select("source", F.lit(1).cast("long").alias("n"), "n_chars", F.array("doc_id").alias("doc_ids"))
    m = evaluate.merge_results(parts, "source", ["n", "n_chars"], ["doc_ids"])
    return m.select("source", "n", "n_chars", F.size("doc_ids").cast("long").alias("ids"))


@query("SELECT user_id AS run_id, epoch_us(min(ts)) AS began_us, round(max(value) FILTER (WHERE event_type = 'view'), 6) AS view, round(max(value) FILTER (WHERE event_type = 'click'), 6) AS click FROM events GROUP BY 1")
def recent_runs(spark, sf):
    e = _t(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("recorded_at"), F.col("event_type").alias("metric"), "value")
    r = evaluate.runs(e, ["view", "click"])
    return r.select("run_id", F.unix_micros("began").alias("began_us"), F.round("view", 6).alias("view"), F.round("click", 6).alias("click"))


@query("WITH s AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) % 8 AS shard, n_chars FROM documents) SELECT CAST(shard AS BIGINT) AS shard, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS work FROM s GROUP BY 1")
def parallel_shards(spark, sf):
    rows = order.round_robin(_t(spark, sf, "documents").select("doc_id", "n_chars"), [F.asc("doc_id")], 8)
    return rows.groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("work"))


@query("SELECT event_type AS topic, CAST(sum(greatest(0, event_id - greatest(0, user_id * 40 - 500))) AS BIGINT) AS lag FROM events GROUP BY 1")
def topic_lag(spark, sf):
    return _t(spark, sf, "events").groupBy(F.col("event_type").alias("topic")).agg(metrics.lag(F.col("event_id"), F.col("user_id") * 40 - 500).alias("lag"))


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1996-01-01', 0) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def keyset_join_page(spark, sf):
    o = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    rows = o.where(F.struct("at", "o_orderkey") < F.struct(F.lit("1996-01-01").cast("timestamp").alias("at"), F.lit(0).cast("long").alias("o_orderkey")))
    return rows.orderBy(F.desc("at"), F.desc("o_orderkey")).limit(25).select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


@query("SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS status FROM events GROUP BY 1")
def review_states(spark, sf):
    e = _t(spark, sf, "events").withColumn("status", F.col("event_type")).withColumn("at", F.struct("ts", "event_id"))
    return claims.latest_status(e, "user_id", "at").select("user_id", "status")


@query("SELECT user_id, CAST(greatest(0, epoch(TIMESTAMP '2024-02-01') - floor(epoch(max(ts)))) AS BIGINT) AS lag_s, epoch(TIMESTAMP '2024-02-01') - floor(epoch(max(ts))) > 172800 AS overdue FROM events GROUP BY 1")
def freshness_lag(spark, sf):
    last = _t(spark, sf, "events").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("last"))
    return last.select("user_id", promotion.freshness(F.lit("2024-02-01").cast("timestamp"), F.col("last"), 172_800).alias("f")).select("user_id", "f.*")


@query("SELECT lang, n_chars >= 200 AS eligible, count(*) AS n FROM documents WHERE lang IN ('en', 'de') GROUP BY ALL")
def block_filter(spark, sf):
    docs = _t(spark, sf, "documents")
    rows = filters.in_blocks(docs, spark.createDataFrame([("en",), ("de",)], "lang string"), ["lang"])
    return rows.groupBy("lang", (F.col("n_chars") >= dedup.MIN_CHARS).alias("eligible")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, text_sha256, content_hash FROM (SELECT doc_id, sha256(text) AS text_sha256, 'sha256:' || sha256(text) AS content_hash FROM documents)")
def hash_backfill(spark, sf):
    docs = _t(spark, sf, "documents")
    records = docs.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.lit(None).cast("string").alias("content_hash"))
    return store.backfill_hashes(records, docs.select("doc_id", F.col("text").cast("binary").alias("content")))


@query("SELECT lo AS doc_id, h AS text_hash FROM (SELECT sha256(text) AS h, min(doc_id) AS lo FROM documents GROUP BY 1 HAVING count(*) > 1)")
def same_content_refs(spark, sf):
    docs = _t(spark, sf, "documents").select(F.sha2("text", 256).alias("doc_id"), F.lit("s").alias("source_id"), F.col("doc_id").alias("url"))
    many = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    return store.same_content(docs).join(many, "doc_id").select(F.col("url").alias("doc_id"), F.col("doc_id").alias("text_hash"))


@query("SELECT round(avg(CAST(linked AS INTEGER)), 6) AS linked_share, count(*) AS statements FROM (SELECT r IS NOT NULL AS linked FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS r FROM lineitem) ON o_orderkey = r)")
def audit_linkage(spark, sf):
    known = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("doc_id"))
    records = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("record_id"))
    return evidence.linkage(evidence.trace(known.select("claim_id"), known, records)).select(F.round("linked_share", 6).alias("linked_share"), "statements")


def _rest() -> None:
    """The modules that register further queries."""
    from millrace import queries_graph, queries_text  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _rest()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _rest()
    return dict(_SQL)

"""Stores, feeds, streams, graph replay, time and evaluation on small hand-made inputs."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.functions import ids, text
from millrace.operators import bitemporal, claims, components, evidence, extract, filters, graph, graph_view, metrics, retrieval
from millrace.sources import feeds, store
from millrace.streaming import promotion


def values(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def one(spark, expr, **cols):
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in cols.items())
    return spark.createDataFrame([tuple(cols.values())], kinds).select(expr.alias("x")).first()["x"]


def test_raw_store(spark, tmp_path):
    path = str(tmp_path / "raw")
    rows = spark.createDataFrame([("a-1", "u1", bytearray(b"x")), ("a-1", "u2", bytearray(b"x")), ("b", "u1", bytearray(b"x"))], "source_id string, url string, content binary")
    assert store.append_raw(spark, path, rows) == 2
    assert store.append_raw(spark, path, rows) == 0
    got = store.scan_raw(spark, path, ["a-1"], content=False)
    assert got.count() == 1 and "content" not in got.columns
    key = got.first()["doc_id"]
    assert bytes(store.get_content(spark, path, key)) == b"x"
    with pytest.raises(KeyError):
        store.get_content(spark, path, "doc-none")
    with pytest.raises(ValueError):
        store.append_raw(spark, path, rows.withColumn("source_id", F.lit("Bad Slug")))


def test_merge_compact_and_digest(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert values(store.merge(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert values(store.merge(old, new, ["k"], replace=False)) == [(1, "a"), (2, "b"), (3, "d")]
    assert values(store.replace_parts(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    path = str(tmp_path / "t")
    spark.range(100).repartition(5).write.parquet(path)
    before = store.digest(spark.read.parquet(path)).first()
    assert store.compact(spark, path) and not store.compact(spark, path)
    assert store.digest(spark.read.parquet(path)).first() == before


def test_feeds(spark, tmp_path):
    rss = "<rss><item><link>http://a/1</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item><item><link>http://a/2</link></item></rss>"
    got = feeds.rss(spark.createDataFrame([(rss,)], "payload string")).collect()
    assert [(r["url"], r["published"]) for r in got] == [("http://a/1", dt.datetime(2024, 1, 2, 3, 4, 5)), ("http://a/2", None)]
    lines = spark.createDataFrame([("# x\na|/1.txt\nb|http://c/2\n\n",)], "payload string")
    assert values(feeds.delimited_index(lines, 1, "http://b")) == [("http://b/1.txt",), ("http://c/2",)]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("one.txt", "1")
        z.writestr("two.txt", "2")
    (tmp_path / "x.zip").write_bytes(buffer.getvalue())
    assert [r[0] for r in values(feeds.archive_entries(spark, str(tmp_path / "x.zip")), "entry")] == ["one.txt", "two.txt"]
    assert feeds.batches(25, 10) == [(0, 10), (10, 10), (20, 5)]
    assert feeds.retry_delay(0) == 30 and feeds.retry_delay(9) == 300 and feeds.retry_delay(1, 7) == 7


def test_text(spark):
    assert one(spark, text.title(F.col("h")), h="<title>A &amp; B | Site</title>") == "A & B"
    assert one(spark, text.title(F.col("h")), h="<h1>Head <b>x</b></h1>") == "Head x"
    page = "<nav><p>menu</p></nav><div class='article-body'><div><p>In &eacute;</p></div><script>p</script></div><p>out</p>"
    assert one(spark, text.body_text(F.col("h")), h=page) == "In é"
    assert one(spark, text.sentences(F.col("t")), t="One.  Two?\nThree") == ["One.", "Two?", "Three"]
    assert one(spark, text.migration_level(F.col("a"), F.col("b")), a="1.2.3", b="1.3.0") == "minor"
    assert one(spark, text.canonical_json(F.col("j")), j='{"b": 1, "a": [2]}') == '{"a":[2],"b":1}'
    assert one(spark, text.normal_name(F.col("n")), n="Éclair, Inc.") == "eclair inc"
    assert one(spark, text.script(F.col("n")), n="삼성") == "cjk"
    assert one(spark, text.context(F.col("t"), F.lit(100), F.lit(101)), t="a" * 100 + "b" + "c" * 200) == "a" * 96 + "b" + "c" * 96
    assert one(spark, ids.from_hex_cursor(ids.hex_cursor(F.col("k"))), k="é1") == "é1"
    assert one(spark, text.json_in_text(F.col("t")), t='so: ```json\n{"a": 1}\n``` end') == '{"a": 1}'


def test_mentions_and_overlaps(spark):
    docs = spark.createDataFrame([(1, "the cat, the dog"), (2, "")], "doc_id long, text string")
    names = spark.createDataFrame([("the", "Event"), ("dog", "Product")], "surface string, mention_type string")
    assert values(extract.gazetteer_mentions(docs, names), "doc_id", "surface", "start", "end") == [(1, "dog", 13, 16), (1, "the", 0, 3), (1, "the", 9, 12)]
    spans = spark.sql("SELECT array(named_struct('start', 0, 'end', 5), named_struct('start', 0, 'end', 8), named_struct('start', 8, 'end', 9), named_struct('start', 7, 'end', 9)) AS s")
    assert [tuple(x) for x in spans.select(extract.without_overlaps(F.col("s")).alias("s")).first()["s"]] == [(0, 8), (8, 9)]
    d2 = spark.createDataFrame([(1, "Acme (NASDAQ: ACME) said.")], "doc_id long, text string")
    assert values(extract.pattern_mentions(d2, extract.TICKER, "Organization"), "surface") == [("ACME",)]


def test_claim_rules_take_the_first_match_of_a_predicate(spark):
    docs = spark.createDataFrame([(1, "Acme announced webcast news. Nothing here.")], "doc_id long, text string")
    resolved = spark.createDataFrame([(1, "Acme", 0, 4, "org-1"), (1, "here", 37, 41, "org-2")], "doc_id long, surface string, start int, end int, entity_id string")
    got = extract.claims(extract.segments(docs), extract.CLAIM_RULES, resolved).collect()
    assert [(r["predicate"], r["event_type"], r["surface_fragment"], r["char_start"], r["subject_id"], r["object_id"]) for r in got] == [("announces", "earnings", "webcast", 15, "org-1", "org-2")]


def test_claims_match_a_plain_search_of_mentions(spark):
    import random
    import re

    r = random.Random(4)
    words = ["Acme", "Bolt", "Acme Corp", "supplies", "announced", "partnership", "chips", "and", "with", "conference call", "x"]
    docs = [(k, " ".join(r.choice(words) + r.choice(["", "", "."]) for _ in range(r.randint(0, 30)))) for k in range(40)]
    names = spark.createDataFrame([("Acme", "Organization"), ("Acme Corp", "Organization"), ("Bolt", "Product")], "surface string, mention_type string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = extract.mentions(d, names).withColumn("entity_id", F.concat(F.lit("e-"), F.when(F.col("surface").startswith("Acme"), "a").otherwise("b")))
    got = values(extract.claims(extract.segments(d), extract.CLAIM_RULES, found), "doc_id", "seg_order", "predicate", "char_start", "subject_id", "object_id")
    held = {}
    for m in sorted(found.collect(), key=lambda m: m["start"]):
        held.setdefault(m["doc_id"], []).append(m)
    want = []
    for doc, text in docs:
        for no, seg in enumerate(s for s in re.split(r"(?<=[.!?])\s+", " ".join(text.split())) if s):
            seen = set()
            for pattern, predicate, _ in extract.CLAIM_RULES:
                m = re.search(pattern, seg)
                if not m or predicate in seen:
                    continue
                seen.add(predicate)
                subject = next((x["entity_id"] for x in held.get(doc, []) if x["surface"] in seg), None)
                if subject:
                    other = next((x["entity_id"] for x in held[doc] if x["entity_id"] != subject and x["start"] >= m.end()), None)
                    want.append((doc, no, predicate, m.start(), subject, other))
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(got, key=key) == sorted(want, key=key) and any(t[-1] for t in want)


def test_gates(spark):
    rows = [("c1", "d", "supplies", "s", 0.8, 0, 4), ("c2", "d", "nope", "s", 0.5, 0, 4), ("c3", None, "supplies", None, 1.2, 5, 4)]
    df = spark.createDataFrame(rows, "claim_id string, doc_id string, predicate string, subject_id string, confidence double, char_start int, char_end int")
    got = {r["claim_id"]: (r["status"], r["reasons"]) for r in claims.claim_gate(df).collect()}
    assert got["c1"] == ("promoted", [])
    assert got["c2"] == ("quarantined", ["unknown_predicate:nope", "low_confidence"])
    assert got["c3"] == ("quarantined", ["confidence_out_of_range", "missing_doc_id", "invalid_span", "missing_subject"])
    assert values(claims.mutations(df.union(df), "claim_id"), "mutation_id") == [("mut-0001",), ("mut-0002",), ("mut-0003",)]


def test_canonical_overlap_and_conflicts(spark):
    rows = [(1, "s", "p", "x", "positive", 0, "Aa", 0, 5), (2, "s", "p", "y", "positive", 0, "bb", 3, 8), (3, "s", "p", "x", "negative", 1, "aa ", 0, 2), (4, "t", "p", "x", "positive", 0, "aa", 0, 2)]
    df = spark.createDataFrame(rows, "claim_id long, subject_id string, predicate string, object_id string, polarity string, seg_order int, surface_fragment string, char_start int, char_end int")
    assert values(claims.canonical(df)) == [(1, 1), (2, 1), (3, 1), (4, 4)]
    assert values(claims.conflicts(df)) == [(1, 2, "value_conflict"), (1, 3, "polarity"), (2, 3, "polarity")]


def test_components_and_pointers(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 51)], "a long, b long")
    got = dict(values(components.components(edges, spark.createDataFrame([(99,)], "node long").union(edges.select("a")))))
    assert got[30 - 1] == 1 and got[50] == 50 and got[99] == 99
    chain = spark.createDataFrame([(i, i - 1) for i in range(2, 20)], "node long, target long")
    assert {r["root"] for r in components.resolve_pointers(chain).collect()} == {1}
    seeds = spark.createDataFrame([(1,)], "node long")
    assert dict(values(components.reach(spark, edges, seeds, 3))) == {1: 0, 2: 1, 3: 2, 4: 3}


def test_ordered_replay(spark):
    rows = [(1, "k1", "create_node", "a", None, None, "N"), (2, "k2", "create_node", "b", None, None, "N"), (3, "k3", "merge", None, "a", "b", ""), (4, "k3", "create_node", "z", None, None, "N")]
    rows += [(5, "k5", "unmerge", None, "a", "b", ""), (6, "k6", "create_edge", None, "a", "q", "E"), (7, "k7", "delete_node", "b", None, None, "")]
    log = spark.createDataFrame([(*r, None, None, None) for r in rows], "seq long, idempotency_key string, op string, id string, src string, dst string, type string, ref string, props map<string,string>, at string")
    view = graph_view.advance(graph_view.empty(spark), log)
    assert values(view.nodes, "id", "label") == [("a", "N"), ("b", "Deleted")] and view.live_edges().count() == 0


def test_as_of_is_half_open(spark):
    df = spark.sql("SELECT 1 AS id, timestamp '2024-01-01' AS tx_from, timestamp '2024-02-01' AS tx_to, cast(null AS timestamp) AS valid_from, cast(null AS timestamp) AS valid_to")
    at = lambda t: F.lit(t).cast("timestamp")
    count = lambda t: bitemporal.as_of(df, at("2024-01-05"), at(t)).count()
    assert [count(t) for t in ("2023-12-31", "2024-01-01", "2024-01-31", "2024-02-01")] == [0, 1, 1, 0]
    assert bitemporal.as_of(df).count() == 0


def test_confidence(spark):
    df = spark.createDataFrame([("s", "p", "o", d, r) for d, r in ((1, 1), (2, 1), (3, 3))], "subject_id string, predicate string, object_id string, doc_id long, root_doc_id long")
    r = evidence.confidence(df).first()
    assert (r["evidence"], r["independent"]) == (3, 2) and abs(r["confidence"] - 2 / 3) < 1e-12
    contra = spark.createDataFrame([("s", "p", "o", 1)], "subject_id string, predicate string, object_id string, contradicting long")
    assert abs(evidence.confidence(df, contra).first()["confidence"] - 1 / 3) < 1e-12


def test_metrics(spark):
    e = spark.createDataFrame([("a", 1, "in"), ("a", 2, "in"), ("a", 5, "out"), ("a", 6, "out"), ("b", 3, "out")], "k string, s int, kind string").withColumn("at", F.timestamp_seconds("s"))
    assert values(metrics.dwell(e, "k", "at", "kind", "in", "out"), "k", "dwell_us") == [("a", 4_000_000)]
    s = spark.createDataFrame([("a", 1.0, 10.0), ("b", None, 10.0), ("c", 3.0, 10.0)], "source string, density double, floor double")
    assert dict(values(metrics.allocate(s, 110.0), "source", "allocated")) == {"a": 30.0, "b": 10.0, "c": 70.0}
    assert dict(values(metrics.allocate(s, 15.0), "source", "allocated")) == {"a": 5.0, "b": 5.0, "c": 5.0}
    assert one(spark, metrics.next_commit(F.col("t"), 60), t=61) == 59
    assert one(spark, filters.valid_reference(F.col("d"), F.col("r"), F.col("d")), d="doc-" + "a" * 24, r="raw://s/doc-" + "a" * 24)


def test_bm25_counts_repeated_query_terms(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma gamma"), (3, "delta")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "alpha"), (2, "alpha alpha")], "query_id int, query string")
    got = {r["query_id"]: r["score"] for r in retrieval.bm25(spark, docs, q).collect()}
    assert abs(got[2] - 2 * got[1]) < 1e-9


def test_stream_promotion_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([("e1", "a"), ("e2", "b"), ("e1", "a")], "doc_id string, v string")
    df.write.parquet(src)
    for k in range(2):
        stream = promotion.file_stream(spark, src, "doc_id string, v string")
        promotion.run_available(stream, promotion.promote("doc_id", out), str(tmp_path / f"ck{k}"))
    assert values(spark.read.parquet(out), "doc_id", "v") == [("e1", "a"), ("e2", "b")]


def test_envelopes_are_routed(spark):
    rows = [("1", "S3", "x", "ok", "k", 0, "{}"), ("2", "S3", "x", "failed", "k", 3, "{}"), ("3", "S3", "x", "failed", "k", 1, "{}"), ("4", "nope", "x", "ok", "k", 0, "{"), ]
    df = spark.createDataFrame(rows, "event_id string, stage string, event_type string, status string, idempotency_key string, attempt_count int, payload string").withColumn("occurred_at", F.current_timestamp())
    assert dict(values(promotion.routed(df), "event_id", "route")) == {"1": "primary", "2": "dlq", "3": "retry", "4": "quarantine"}
    assert promotion.decode(promotion.encode(df)).count() == 4
    assert len(promotion.topics()) == 28


def test_stream_dwell(spark, tmp_path):
    src = str(tmp_path / "in")
    e = spark.createDataFrame([("a", 1, "in"), ("a", 2, "in"), ("a", 5, "out"), ("b", 3, "out")], "k string, s int, kind string").withColumn("at", F.timestamp_seconds("s"))
    e.write.parquet(src)
    stream = promotion.dwell(promotion.file_stream(spark, src, "k string, s int, kind string, at timestamp"), "k", "at", "kind", "in", "out")
    q = stream.writeStream.format("memory").queryName("dwell").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["key"], (r["left_at"] - r["entered"]).seconds) for r in spark.table("dwell").collect()] == [("a", 4)]


def test_expiry_numbers_rows_without_one_window(spark):
    from pyspark.sql import functions as F

    from millrace.sources.store import plan_expiry

    df = spark.range(2000).select(F.col("id").alias("snapshot_id"), F.timestamp_seconds(F.col("id") * 86400).alias("at"))
    got = plan_expiry(df, F.timestamp_seconds(F.lit(2000 * 86400)), 30, 50)
    assert sorted(r["snapshot_id"] for r in got.collect()) == list(range(1950))
    import contextlib
    import io

    with contextlib.redirect_stdout(out := io.StringIO()):
        got.explain()
    assert "row_number() windowspecdefinition(at" not in out.getvalue() and "row_number() windowspecdefinition(_p" in out.getvalue()


def test_long_chains_settle(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(67)], "a long, b long")
    assert components.reach(spark, chain, spark.createDataFrame([(0,)], "node long")).count() == 68
    assert {r["component"] for r in components.components(chain).collect()} == {0}
    assert components.components(chain.limit(0)).count() == 0


def test_pointer_cycles_end_at_their_least_node(spark):
    pointers = [(2, 1), (3, 2), (10, 11), (11, 10), (20, 21), (21, 22), (22, 20), (25, 21), (30, 30)]
    got = values(components.resolve_pointers(spark.createDataFrame(pointers, "node long, target long")))
    assert got == [(2, 1), (3, 1), (10, 10), (11, 10), (20, 20), (21, 20), (22, 20), (25, 20), (30, 30)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_places_of_many_wide_rows(spark, adaptive):
    from millrace.operators.order import numbered

    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 1_000_000
        rows = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(10**12)).alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("wide"), "id")
        got = numbered(rows, [F.asc("key"), F.asc("id")])
        assert tuple(got.agg(F.count("*"), F.countDistinct("position"), F.min("position"), F.max("position")).first()) == (n, n, 1, n)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_nearest_vectors_are_those_of_all_pairs(spark):
    import random

    r = random.Random(5)
    rows = [(i, [float(r.randrange(-3, 4)) for _ in range(6)]) for i in range(300)] + [(300 + i, [1.0, 2.0, 0.0, -1.0, 3.0, 0.5]) for i in range(40)]
    rows += [(400, None), (401, [0.0] * 6), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [1.0, 2.0]), (404, [2.0, 1.0]), (405, [1.0, 1.0, 1.0, 1.0, 1.0, float("inf")]), (300, [3.0, 2.0, 1.0, 0.0, 0.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id % 10 = 0 or vec_id > 398").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    pairs = v.crossJoin(q).where("vec_id != query_id").select("query_id", "vec_id", retrieval.cosine(F.col("embedding"), F.col("q")).alias("score"))
    want = retrieval.top_k(pairs, ["query_id"], [F.desc(F.round("score", 9)), F.asc("vec_id")], 5)
    got = retrieval.cosine_topk(v.repartition(3), q)
    show = lambda df: sorted((x["query_id"], x["rank"], x["vec_id"], str(x["score"])) for x in df.collect())
    assert show(got) == show(want)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan  # no pair is a row


def test_references_end_in_a_semicolon(spark):
    page = "<title>A&amp;B &copy &ampx; &amp</title><p>x &lt;y&gt; &#39;z&#39; &amp &#39</p>"
    assert one(spark, text.title(F.col("h")), h=page) == "A&B &copy &ampx; &amp"
    assert one(spark, text.body_text("h"), h=page) == "x <y> 'z' &amp &#39"


def test_a_cut_is_computed_once_and_read_as_a_table(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = components.cut(spark.range(1000).mapInArrow(count, "id long"))
    assert got.count() == 1000 and seen.value == 1000
    assert got.inputFiles()


def test_tasks_grow_in_number_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(components, "TASK_ROWS", 10)
    rows = [(k, k % 90, "p", k % 7, k % 5, "N" if k % 2 else "R") for k in range(400)]
    c = spark.createDataFrame(rows, "claim_id long, subject_id long, predicate string, object_id long, doc_id long, polarity string").withColumn("root_doc_id", F.col("doc_id") % 3)
    got = evidence.confidence(c)
    assert got.rdd.getNumPartitions() == 80 and got.agg(F.sum("evidence")).first()[0] == 400
    assert claims.conflict_summary(c).rdd.getNumPartitions() == 40


def test_links_of_a_class_are_settled_where_they_stand(spark, monkeypatch):
    links = spark.createDataFrame([(k * 100 + i, k * 100 + i + 1) for k in range(20) for i in range(30)], "a long, b long").repartition(3, F.floor(F.col("a") / 100))
    want = sorted((k * 100 + i, k * 100) for k in range(20) for i in range(31))
    cuts = []
    real = components.cut
    monkeypatch.setattr(components, "cut", lambda df: cuts.append(1) or real(df))
    assert values(components.components(links)) == want and len(cuts) == 1
    # what tasks do not hold together takes rounds, and gives the same
    monkeypatch.setattr(components, "contracted", lambda df: df)
    assert values(components.components(links.repartition(7))) == want and len(cuts) > 2
    assert values(components.components(links.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")))) == sorted((str(x), min(str(k * 100 + i) for i in range(31))) for x, y in want for k in [y // 100])

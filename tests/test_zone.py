"""Versioned tables, mentions, graph audit, alerts and gates on small hand-made inputs."""

import hashlib
import json
import threading

import pytest
from pyspark.sql import functions as F

from millrace.operators import claims, evaluate, evidence, extract, filters, graph, retrieval
from millrace.sources import zone as Z
from millrace.streaming import promotion


def values(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


@pytest.fixture
def zone(spark, tmp_path):
    return Z.Zone(spark, "file://" + str(tmp_path / "zone"), keep=2)


def test_commits_batches_and_tokens(spark, zone):
    rows = lambda *x: spark.createDataFrame(list(x), "k long, v string, _hidden int")
    assert zone.read("t") is None and zone.names() == []
    zone.upsert("t", rows((1, "a", 0), (2, "b", 0)), ["k"])
    before = zone.token()
    zone.upsert("t", rows((2, "c", 0), (3, "d", 0)), ["k"])
    assert values(zone.read("t"), "k", "v") == [(1, "a"), (2, "c"), (3, "d")] and zone.token() != before
    assert values(zone.read("t", 1), "k", "v") == [(1, "a"), (2, "b")]
    with zone.batch():
        zone.upsert("t", rows((4, "e", 0)), ["k"])
        with zone.batch():
            zone.update("t", "k", 1, v="z")
        assert values(zone.read("t"), "k", "v")[0] == (1, "z")
        assert zone.versions("t") == [1, 2]
    assert zone.versions("t") == [2, 3] and zone.counts() == {"t": 4}
    with pytest.raises(ZeroDivisionError), zone.batch():
        zone.upsert("t", rows((9, "x", 0)), ["k"])
        raise ZeroDivisionError
    assert zone.versions("t") == [2, 3]
    health = zone.health().first()
    assert (health["table"], health["versions"]) == ("t", 2) and health["files"] == health["small_files"] > 0


def test_an_unfinished_version_is_not_read(spark, zone):
    df = spark.createDataFrame([(1,)], "k long")
    zone.commit("t", df)
    fs, p = zone._fs(zone.path("t", 2) + "/part-0.parquet")
    fs.create(p).close()
    assert zone.versions("t") == [1] and zone.read("t").count() == 1
    assert zone.commit("t", df.union(df)) == 2 and zone.read("t").count() == 2


def test_documents_segments_export(spark, zone, tmp_path):
    docs = spark.createDataFrame([("b", "1", "t"), ("a", "2", "t"), ("a", "1", "t")], "doc_id string, parser_version string, title string")
    segs = spark.createDataFrame([("a", "1", 1, "y", 0), ("a", "1", 0, "x", 0), ("c", "1", 0, "q", 0)], "doc_id string, parser_version string, ord int, text string, _h int")
    Z.persist_documents(zone, docs, segs)
    Z.persist_documents(zone, docs.limit(0), segs.where("ord = 0 and doc_id = 'a'"))
    assert [(r[0], r[1]) for r in Z.documents(zone.read("documents")).collect()] == [("a", "1"), ("a", "2"), ("b", "1")]
    assert [r[0] for r in Z.documents(zone.read("documents"), ["b"]).collect()] == ["b"]
    assert [tuple(r) for r in Z.segments(zone.read("segments"), "a").collect()] == [("a", "1", 0, "x")]
    assert [r["text"] for r in Z.segments_with_documents(zone.read("segments"), zone.read("documents")).collect()] == ["x"]
    assert zone.export(str(tmp_path / "out")) == ["documents", "segments"]
    assert spark.read.parquet(str(tmp_path / "out" / "segments.parquet")).columns == ["doc_id", "parser_version", "ord", "text"]
    assert Z.partition_metadata(zone.read("documents")).agg(F.sum("rows")).first()[0] == 3


def test_signatures_by_band(spark, zone):
    sigs = spark.createDataFrame([(1, [1, 2]), (2, [3, 4])], "doc_id long, sig array<long>")
    bands = spark.createDataFrame([(1, 0, 7), (1, 1, 8), (2, 0, 9)], "doc_id long, band int, key long")
    Z.persist_signatures(zone, sigs, bands, "x1")
    keys = spark.createDataFrame([(0, 9), (1, 9)], "band int, key long")
    assert values(Z.band_candidates(zone, keys, "x1"), "doc_id") == [(2,)]
    assert Z.band_candidates(zone, keys, "x2").count() == 0


def test_mentions_have_ids_contexts_and_no_overlaps(spark):
    docs = spark.createDataFrame([("d1", "Big Corp Ltd (NASDAQ: NVDA) met Big Corp at https://www.big.com/x."), ("d2", None)], "doc_id string, text string")
    names = spark.createDataFrame([("Big Corp", "Organization", {"id": "7"}), ("Big Corp Ltd", "Organization", {"id": "7"}), ("Corp", "Organization", None)], "surface string, mention_type string, identifiers map<string,string>")
    got = extract.mentions(docs, names, radius=4).orderBy("start").collect()
    assert [(r["surface"], r["start"], r["end"]) for r in got] == [("Big Corp Ltd", 0, 12), ("NVDA", 22, 26), ("Big Corp", 32, 40), ("bigcom", 56, 63)]
    assert got[0]["mention_id"] == "men-" + hashlib.sha256(b"d1:0:12:Big Corp Ltd").hexdigest()[:24] and got[1]["context"] == "AQ: NVDA) me"
    entities = {r["name"]: r["n"] for r in extract.resolve(extract.mentions(docs, names)).collect()}
    assert entities == {"Big Corp": 2, "NVDA": 1, "bigcom": 1}


def test_whole_word_mentions_of_several_words(spark):
    docs = spark.createDataFrame([(1, "new york, New York; New Yorker and New York")], "doc_id long, text string")
    names = spark.createDataFrame([("New York", "Location")], "surface string, mention_type string")
    assert values(extract.gazetteer_mentions(docs, names), "start") == [(10,), (35,)]


def test_investigation_folds_and_truncates(spark):
    edges = spark.createDataFrame([(1, "m", "k1", "ABOUT"), (2, "e", "k2", "ABOUT"), (3, "k3", "e", "ABOUT"), (4, "v1", "k1", "SUPPORTS"), (5, "k2", "v2", "CONTRADICTS"), (6, "gone", "k1", "SUPPORTS")], "seq long, src string, dst string, type string")
    nodes = spark.createDataFrame([(x, x == "gone") for x in ("k1", "k2", "k3", "v1", "v2", "gone")], "id string, deleted boolean")
    classes = spark.createDataFrame([("m", "e")], "node string, root string")
    got = graph.investigation(edges, classes, nodes, F.lit("m"), 2)
    assert values(got) == [("claim", "e", "k1", "ABOUT", True), ("claim", "e", "k2", "ABOUT", True), ("evidence", "v1", "k1", "SUPPORTS", True), ("evidence", "v2", "k2", "CONTRADICTS", True)]
    assert not any(r["truncated"] for r in graph.investigation(edges, classes, nodes, F.lit("e"), 3).collect())
    assert ("e/ABOUT/k1",) in values(graph.relation_paths(got))
    assert values(graph.investigation(edges, classes, nodes, F.lit("m"), 9, ["ABOUT"]), "dst") == [("k1",), ("k2",), ("k3",)]


def test_wrong_merges_are_taken_back(spark):
    log = spark.createDataFrame([(1, "merge", "a", "c", "r1", None), (2, "merge", "b", "c", "r2", {"decided_by": "me"}), (3, "unmerge", "b", "c", None, None)], "seq long, op string, member string, canonical string, ref string, props map<string,string>")
    assert values(graph.merge_audit(log), "member", "decided_by", "live") == [("a", "pipeline", True), ("b", "me", False)]
    wrong = spark.createDataFrame([("a", "r1"), ("b", "r2"), ("a", "r9")], "member string, resolution_ref string")
    assert values(graph.rollbacks(log, wrong)) == [(4, "unmerge", "a", "c", "r1")]
    undone = log.drop("props").unionByName(graph.rollbacks(log, wrong))
    assert graph.canonical_of(undone).count() == 0


def test_alerts_of_all_five_kinds(spark):
    log = spark.createDataFrame([("create_edge", "CONTRADICTS", "e", "t", None, None), ("create_edge", "SUPERSEDES", "t", "old", None, None), ("create_node", "Event", None, None, "t", {"status": "confirmed"}), ("create_edge", "CONTRADICTS", "t", "x", None, None)], "op string, type string, from string, to string, id string, props map<string,string>")
    changes = spark.createDataFrame([("t", 0.5, 0.7, 1, 2)], "target string, before double, after double, independent_before int, independent_after int")
    got = promotion.alerts(log.union(log), spark.createDataFrame([("i", "t")], "investigation_id string, target string"), changes)
    kinds = ["claim_changed", "confidence_threshold", "contradicting_evidence", "new_independent_source", "plan_to_execution"]
    assert values(got, "trigger") == [(k,) for k in kinds] and got.where("dedup_key = 'i:claim_changed:t'").count() == 1


def test_envelope_limits(spark):
    deep = "[" * 31 + "]" * 31
    payloads = ['{"a": 1}', '{"a": %s}' % deep, '{"a": "%s"}' % ("x" * 8193), "[1]", '{"a": NaN}', '{"a": "%s"}' % ("x" * 8192)]
    e = spark.createDataFrame([(str(k), "S1", "t", p) for k, p in enumerate(payloads)], "event_id string, stage string, event_type string, payload string").withColumn("occurred_at", F.current_timestamp())
    got = {r["event_id"]: r["r"] for r in e.select("event_id", filters.envelope_reasons(e).alias("r")).collect()}
    assert got == {"0": [], "1": ["too_deep"], "2": ["scalar_too_long"], "3": ["bad_json"], "4": ["bad_json"], "5": []}
    assert len(set(promotion.topics())) == 28 and "events.s3.parse-normalize.v1.dlq" in promotion.topics()


def test_record_reasons(spark):
    def why(kind, record):
        return spark.createDataFrame([(record,)], "r string").select(filters.record_reason(F.col("r"), kind).alias("x")).first()["x"]

    assert why("contradiction_verdict", '{"verdict": "real_conflict", "rationale": "r", "confidence": 1}') is None
    assert why("contradiction_verdict", '{"verdict": "real_conflict", "rationale": " ", "confidence": 1}') == "rationale is empty"
    assert why("canonical_verdict", '{"relation": "equivalent", "confidence": 2}') == "missing: canonical_text"
    assert why("report", '{"subject_id": "s", "conclusion": [], "statements": [], "open_questions": []}') == "conclusion has the wrong type"
    assert why("claim", "nope") == "not an object"
    ok = {"verdict": "scope", "rationale": "r", "confidence": 0.5}
    for verdict in ("real_conflict", "temporal", "scope", "not_conflict"):
        assert why("contradiction_verdict", json.dumps(ok | {"verdict": verdict})) is None
    assert why("contradiction_verdict", json.dumps(ok | {"verdict": "apparent_only"})) == "unknown verdict"
    assert why("contradiction_verdict", json.dumps(ok | {"conflict_type": "nope"})) == "unknown conflict type"
    assert why("contradiction_verdict", json.dumps(ok | {"conflict_type": None, "confidence": True})) is None
    assert why("contradiction_verdict", json.dumps(ok | {"confidence": "0.5"})) == "confidence not in [0,1]"
    assert why("contradiction_verdict", json.dumps(ok | {"rationale": None})) == "missing: rationale"
    said = {"relation": "more_general", "canonical_text": "t", "confidence": 1}
    assert why("canonical_verdict", json.dumps(said)) is None
    assert why("canonical_verdict", json.dumps(said | {"canonical_text": 3})) == "canonical_text is no text"
    assert why("canonical_verdict", json.dumps(said | {"relation": "same", "confidence": 2})) == "unknown relation"
    claim = {k: 1 for k in filters.REQUIRED["claim"]}
    assert why("claim", json.dumps(claim)) is None and why("claim", json.dumps(claim | {"provenance_ref": ["a", "b"]})) is None and why("claim", json.dumps(claim | {"provenance_ref": []})) is None
    assert why("claim", json.dumps(claim | {"provenance_ref": ["a", 1]})) == why("claim", json.dumps(claim | {"provenance_ref": "a"})) == "provenance_ref is no list of texts"
    report = {"subject_id": "s", "conclusion": {}, "statements": [], "open_questions": ["q"]}
    assert why("report", json.dumps(report)) is None and why("report", json.dumps(report | {"audit": []})) == "audit has the wrong type"
    rows = spark.createDataFrame([(json.dumps(ok),), (json.dumps(ok | {"verdict": "x"}),), (None,)], "r string")
    assert [x["v"] and x["v"]["verdict"] for x in rows.select(filters.verdict(F.col("r")).alias("v")).collect()] == ["scope", None, None]


def test_conflict_summary_counts_as_the_pairs_do(spark):
    import random

    from millrace.operators import claims

    r = random.Random(6)
    rows = [(k, r.choice(["s", "t", None]), r.choice("pq"), r.choice(["+", "-", "?", None]), r.choice([None, 1, 2, 3, 4])) for k in range(160)] + [(900, "u", "p", "+", 1), (901, "v", "p", None, 1), (902, "v", "p", "+", 2)]
    df = spark.createDataFrame(rows, "claim_id long, subject_id string, predicate string, polarity string, object_id long")
    pairs = {(x["a"], x["b"]): x["kind"] for x in claims.conflicts(df).collect()}
    of = {k: (s, p) for k, s, p, _, _ in rows}
    want = {}
    for (a, _), kind in pairs.items():
        want.setdefault(of[a], {}).setdefault(kind, 0)
        want[of[a]][kind] += 1
    for x in claims.conflict_summary(df).collect():
        got = want.get((x["subject_id"], x["predicate"]), {})
        assert (x["n_polarity"], x["n_value"]) == (got.get("polarity", 0), got.get("value_conflict", 0))
        assert x["n_claims"] == sum((s, p) == (x["subject_id"], x["predicate"]) for _, s, p, _, _ in rows)
        for n, pair, kind in ((x["n_polarity"], x["polarity_pair"], "polarity"), (x["n_value"], x["value_pair"], "value_conflict")):
            assert (pair is None) == (n == 0)
            assert pair is None or pairs[pair["a"], pair["b"]] == kind


def test_subject_bonus_and_gates(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "s"), (2, "alpha beta", "t")], "doc_id long, text string, subject_id string")
    q = spark.createDataFrame([(1, "alpha", "t")], "query_id int, query string, subject_id string")
    got = {r["doc_id"]: r["score"] for r in retrieval.bm25(spark, docs, q).collect()}
    assert got[2] - got[1] == pytest.approx(0.5)
    covered = spark.createDataFrame([(True,), (False,)], "covered boolean")
    assert evidence.run_outcome(covered, 5).first()["terminated_by"] == "no_new_evidence" and evidence.run_outcome(covered, 1).first()["terminated_by"] == "budget"
    axes = evaluate.quality_axes(spark.createDataFrame([("q", "coverage", 9, 10), ("q", "modality", 1, 2), ("q", "citation_support", 0, 0)], "question_id string, axis string, good int, total int"))
    assert tuple(evaluate.quality_report(axes).first()) == ("q", 2, False)
    moved = spark.createDataFrame([("e", "backfill"), ("f", "keep")], "element_id string, action string")
    assert values(evaluate.backfill_events(moved, "2.0.0"), "idempotency_key") == [("backfill:2.0.0:e",)]


def test_claims_need_their_provenance(spark):
    row = ("c", "d", 0, 1, "supplies", 0.9, "s")
    df = spark.createDataFrame([(*row, ["p"]), (*row, [])], "claim_id string, doc_id string, char_start int, char_end int, predicate string, confidence double, subject_id string, provenance_ref array<string>")
    assert [r["reasons"] for r in claims.claim_gate(df).collect()] == [[], ["missing_provenance_ref"]]


def test_spans_count_characters_and_cursors_return(spark):
    from millrace.functions import ids
    from millrace.sources import store

    raw = spark.createDataFrame([("d", bytearray("é中x yz".encode()))], "doc_id string, content binary")
    claims_ = spark.createDataFrame([("d", 1, 4), ("e", 0, 1)], "doc_id string, char_start int, char_end int")
    got = {r["doc_id"]: r["quote"] for r in store.resolve_spans(claims_, raw).collect()}
    assert got == {"d": "中x ", "e": None}
    df = spark.createDataFrame([("a?~", 7)], "a string, b int").select(ids.json_cursor(F.struct("a", "b")).alias("c"))
    assert tuple(df.select(ids.from_json_cursor(F.col("c"), "a string, b int").alias("x")).first()["x"]) == ("a?~", 7)


def test_a_stream_that_falls_quiet_ends(spark, tmp_path):
    spark.createDataFrame([("k1", 1), ("k1", 1), ("k2", 2)], "key string, v int").write.parquet(str(tmp_path / "in"))
    stream = promotion.file_stream(spark, str(tmp_path / "in"), "key string, v int")
    for _ in range(2):
        promotion.run_until_quiet(stream, promotion.promote("key", str(tmp_path / "out")), str(tmp_path / "check"), 0.2, 2)
    assert values(spark.read.parquet(str(tmp_path / "out")), "key") == [("k1",), ("k2",)]


def test_streamed_windows_and_alerts_match_batches(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 02:00:00"), ("b", "2024-01-01 00:05:00"), ("a", "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "key string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = promotion.file_stream(spark, str(tmp_path / "in"), "key string, at timestamp")

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    assert values(run(promotion.tumbling(stream, "at", "1 hour"), "tumbled", "complete"), "n") == [(1,), (4,)]
    assert sorted(r["n"] for r in run(promotion.sessions(stream, "at", "30 minutes", "key"), "sessioned", "complete").collect()) == [1, 1, 3]
    assert run(promotion.distinct_events(stream, ["key", "at"], "at"), "distinct_ones", "append").count() == 4
    assert values(run(promotion.fire_once(stream, F.col("key"), "at"), "fired", "append"), "dedup_key") == [("a",), ("b",)]


def test_two_writers_keep_both_rows(spark, tmp_path):
    zone = Z.Zone(spark, f"file://{tmp_path}/zone")
    row = lambda k: spark.createDataFrame([(k, f"v{k}")], "id long, v string")
    zone.upsert("t", row(0), ["id"])
    failed = []

    def write(k):
        try:
            Z.Zone(spark, f"file://{tmp_path}/zone").upsert("t", row(k), ["id"])
        except Exception as e:
            failed.append(e)

    writers = [threading.Thread(target=write, args=(k,)) for k in (1, 2, 3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed and sorted(r["id"] for r in zone.read("t").collect()) == [0, 1, 2, 3]
    assert zone.versions("t") == [2, 3, 4]


def test_a_batch_counts_as_a_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    zone = Z.Zone(spark, f"file://{tmp_path}/zone", lease=0.0)
    one = spark.createDataFrame([(1,)], "id long")
    with zone.batch():
        zone.commit("a", one)
        zone.commit("b", one)
    assert zone.versions("a") == zone.versions("b") == [1]
    # the driver dies when both folders stand but the batch's marker does not
    real = zone._fs

    def dying(path):
        if "/_batches/" in path and dying.on:
            raise KeyboardInterrupt
        return real(path)

    dying.on = False
    monkeypatch.setattr(zone, "versions", lambda name: Z.Zone(spark, zone.root).versions(name))
    monkeypatch.setattr(zone, "_fs", dying)
    dying.on = True
    with pytest.raises(KeyboardInterrupt), zone.batch():
        zone.commit("a", one.union(one))
        zone.commit("b", one.union(one))
    dying.on = False
    fresh = Z.Zone(spark, zone.root)
    assert fresh.versions("a") == fresh.versions("b") == [1] and fresh.read("a").count() == 1
    assert fresh.commit("a", one.union(one)) == 2 and fresh.read("a").count() == 2 and fresh.read("b").count() == 1
    # a claim whose writer died is void after the lease
    fs, p = real(f"{zone.root}/a/_claim.00000003.dead")
    fs.createNewFile(p)
    assert Z.Zone(spark, zone.root, lease=0.2).upsert("a", one, ["id"]) == 3

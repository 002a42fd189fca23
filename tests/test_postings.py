"""The stored index against scoring everything, blocks that are skipped, and the fused context."""

import random

from millrace.operators import postings, retrieval


def test_index_answers_as_scoring_everything_does(spark, tmp_path):
    r = random.Random(1)
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(r.choice(words[: r.choice([3, 20, 60])]) for _ in range(r.randint(0, 40)))) for k in range(900)] + [(900, None), (901, ""), (902, "rare w1"), (903, "rare w1")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(1, "w1 w2 w1"), (2, "rare"), (3, "w50 w51 w52 w53"), (4, "nowhere"), (5, "")], "query_id int, query string")
    index = postings.build(d.repartition(3), f"{tmp_path}/i")
    key = lambda rows: sorted((x["query_id"], x["rank"], x["doc_id"], round(x["score"], 9)) for x in rows.collect())
    for top in (1, 5, 40):
        assert key(postings.search(index, q, top)) == key(retrieval.bm25(spark, d, q, top=top))


def test_context_keeps_exact_matches_and_one_of_each_root(spark):
    ranked = lambda rows: spark.createDataFrame([(1, d, k) for k, d in enumerate(rows, 1)], "query_id int, doc_id string, rank int")
    exact = spark.createDataFrame([(1, "z"), (1, "y")], "query_id int, doc_id string")
    roots = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "doc_id string, root string")
    rows = postings.context([ranked("abcd"), ranked("bac")], exact, roots, 3).collect()
    assert sorted((x["place"], x["doc_id"], x["exact"]) for x in rows) == [(1, "y", True), (2, "z", True), (3, "a", False)]
    assert {x["doc_id"] for x in postings.context([ranked("abcd")], exact, roots, 1).collect()} == {"y", "z"}


def test_an_investigation_in_one_call(spark, tmp_path):
    from millrace.plans import investigation

    docs = spark.createDataFrame([(1, "Acme Corp makes chips"), (2, "Bolt sells bolts"), (3, "nothing")], "doc_id long, text string")
    names = spark.createDataFrame([("Acme Corp", "e1"), ("Bolt", "e2")], "surface string, entity_id string")
    claims = spark.createDataFrame([("e1", "supplies", None)], "subject_id string, predicate string, object_id string")
    asked = spark.createDataFrame([(1, "Does acme corp supply Bolt?"), (2, "Acme Corp?"), (3, "why")], "question_id int, question string")
    index = postings.build(docs, f"{tmp_path}/i")
    found = investigation.run(asked, names, claims, index)
    assert sorted((r["question_id"], r["planned"], r["gaps"], r["coverage"], r["terminated_by"]) for r in found.outcome.collect()) == [(1, 2, 1, 0.5, "no_new_evidence"), (2, 1, 0, 1.0, "coverage"), (3, 1, 1, 0.0, "no_new_evidence")]
    assert [(r["question_id"], r["doc_id"], r["rank"]) for r in found.retrieved.collect()] == [(1, 2, 1)]
    assert {r["subject_id"] for r in found.counter.collect()} == {"e2"}
    assert sorted((r["question_id"], r["subject"], r["gain"]) for r in found.subclaims.collect()) == [(1, "e1", 0.0), (1, "e2", 0.5), (2, "e1", 0.0), (3, "?subject", 1.0)]
    assert {r["terminated_by"] for r in investigation.run(asked, names, claims, index, budget=1).outcome.collect()} == {"budget"}


def test_a_document_travels_once_to_its_block(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    d = spark.createDataFrame([(k, f"w{k % 7} all") for k in range(1000)], "doc_id long, text string")
    monkeypatch.setattr(DataFrame, "repartitionByRange", None)  # no sort of all texts
    rows = postings.build(d, f"{tmp_path}/i").rows.where("term = 'all'").collect()
    assert sum(r["df"] for r in rows) == 1000 and len(rows) == 8
    assert max(len(r["postings"]) for r in rows) < 2 * postings.BLOCK


def test_postings_travel_as_arrays_and_a_folder_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "TASK_ROWS", 50)
    d = spark.createDataFrame([(k, f"w{k} all") for k in range(20_000)], "doc_id long, text string")
    index = postings.build(d, f"{tmp_path}/i")
    held = spark.read.parquet(f"{tmp_path}/i/postings")
    assert dict(held.dtypes)["doc_id"] == "array<bigint>" and dict(held.dtypes)["tf"] == dict(held.dtypes)["len"] == "array<int>"
    assert index.rows.where("size(postings) != df or bound is null").count() == 0
    assert min(len(list((tmp_path / "i" / "postings" / f"part={k}").glob("*.parquet"))) for k in range(postings.PARTS)) > 1
    q = spark.createDataFrame([(1, "w7 all")], "query_id int, query string")
    assert postings.search(index, q, 1).first()["doc_id"] == 7
    plan = postings.search(index, q, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan  # rows of other terms stay where they are

"""The chain works out only what is asked for, and a large block of claims is no task of its own."""

import random
import re
from functools import partial
from pathlib import Path

from pyspark.sql import functions as F

from millrace.operators import claims, components, dictionary, extract
from millrace.plans import chain

CLAIM = "claim_id long, subject_id string, predicate string, object_id string, polarity string, seg_order int, surface_fragment string, char_start int, char_end int"


def _claims(spark):
    """A large block of three fragments with overlapping spans, and small ones."""
    rows = [(k, "s", "p", "x", "positive", k % 7, f"f{k % 3}", 10 * (k // 7), 10 * (k // 7) + 12 * (k % 2)) for k in range(900)]
    rows += [(1000 + k, f"t{k // 3}", "p", "x", "positive", 0, "f", 0, 2) for k in range(300)]
    return spark.createDataFrame(rows, CLAIM)


def test_gate_does_not_wait_for_canonical_claims(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(claims, "canonical_claims", lambda df, plain=claims.canonical_claims: asked.append(1) or plain(df))
    docs = spark.createDataFrame([(1, "Acme said that Beta is here. Acme was there with Beta.")], "doc_id long, text string")
    names = spark.createDataFrame([("Acme", "Organization"), ("Beta", "Organization")], "surface string, mention_type string")
    made = chain.run(docs, names, [(r"\bthat\b", "announces", "statement"), (r"\bwas\b", "located_in", "past")])
    assert made.gated.where("status = 'promoted'").count() == 2
    assert not asked
    assert made.canonical.agg(F.sum("n_members")).first()[0] == 2
    assert made.canonical is made.canonical and asked == [1]
    assert made.conflicts.count() == 0


def test_a_large_block_is_dealt_to_many_tasks(spark):
    df = _claims(spark)
    block = ["subject_id", "predicate"]
    links = df.select(F.col("claim_id").alias("a"), F.lit(0).cast("long").alias("b"), *block, F.xxhash64("claim_id").alias("salt"))
    met = claims._by_block(links, df, block, rows=100).select(F.spark_partition_id().alias("task"), *block)
    tasks = met.groupBy(*block).agg(F.countDistinct("task").alias("tasks"), F.count("*").alias("n")).collect()
    assert {r["subject_id"]: r["tasks"] > 1 for r in tasks} == {"s": True} | {f"t{k}": False for k in range(100)}
    assert sum(r["n"] for r in tasks) == 1200


def test_canonical_is_the_same_however_blocks_are_dealt(spark, monkeypatch):
    df = _claims(spark)
    said = spark.createDataFrame([(1000, 1001, "equivalent", 0.9), (1, 1000, "equivalent", 0.9)], "a long, b long, relation string, confidence double")
    want = sorted(map(tuple, claims.canonical(df, said).collect()))
    monkeypatch.setattr(claims, "_by_block", partial(claims._by_block, rows=3))
    assert sorted(map(tuple, claims.canonical(df, said).collect())) == want


def _documents(spark, n=200):
    r = random.Random(5)
    words = ["the", "and", "that", "was", "Acme", "other", "https://www.x-y.example/a", "NYSE: ABC", "é中", ". "]
    return [(k, "".join(r.choice([*words, "".join(r.choices("bcdfgjkmpqvxz", k=6))]) + " " for _ in range(r.randint(0, 300)))) for k in range(n)]


NAMES = [("the", "Event", None), ("and", "Location", None), ("and", "Event", None), ("Acme", "Organization", {"lei": "1"}), ("er", "Person", None), ("other", "Product", None)]
RULES = [(r"\bthat\b", "announces", "statement"), (r"\bwas\b", "located_in", "past"), (r"\band\b", "announces", "sum")]


def _run(spark, docs, rules=RULES):
    names = spark.createDataFrame(NAMES, "surface string, mention_type string, identifiers map<string,string>")
    return chain.run(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), names, rules)


def test_mentions_take_less_than_their_documents(spark):
    docs = _documents(spark)
    folder = Path(components.shared_folder(spark).removeprefix("file:"))
    before = set(folder.rglob("*.parquet"))
    made = _run(spark, docs, [("no such text", "announces", "none")])
    written = sum(p.stat().st_size for p in set(folder.rglob("*.parquet")) - before if p.is_file())
    assert made.mentions.where("length(context) > 100").count() > 1000
    assert written < 1.5 * sum(len(x.encode()) for _, x in docs)


def test_mentions_of_few_names_are_not_dealt_out(spark, monkeypatch):
    docs = spark.createDataFrame([*_documents(spark, 60), (1000, None), (1001, "")], "doc_id long, text string").repartition(3)
    names = spark.createDataFrame(NAMES, "surface string, mention_type string, identifiers map<string,string>")
    got = extract.mentions(docs, names, radius=5)
    assert "hashpartitioning(doc_id" not in got._jdf.queryExecution().toString()
    found = sorted((r["doc_id"], r["start"], r["end"], r["mention_type"], r["context"], sorted(r["identifiers"].items())) for r in got.collect())
    monkeypatch.setattr(dictionary, "FEW_NAMES", 0)
    dealt = extract.mentions(docs, names, radius=5)
    assert "hashpartitioning(doc_id" in dealt._jdf.queryExecution().toString()
    assert found == sorted((r["doc_id"], r["start"], r["end"], r["mention_type"], r["context"], sorted(r["identifiers"].items())) for r in dealt.collect())


def test_claims_match_brute_force(spark):
    docs = _documents(spark, 80)
    made = _run(spark, docs)
    mentions: dict[int, list] = {}
    for r in made.mentions.collect():
        mentions.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["entity_id"], r["surface"]))
    want = []
    for s in made.segments.collect():
        own = sorted(mentions.get(s["doc_id"], []))
        held = [m for m in own if m[3] in s["seg_text"]]
        tried = [(p, m) for r, p, _ in RULES if (m := re.search(r, s["seg_text"]))]
        for p in {p for p, _ in tried} if held else ():
            m = next(m for q, m in tried if q == p)
            other = next((x[2] for x in own if x[0] >= m.end() and x[2] != held[0][2]), None)
            want.append((s["doc_id"], s["seg_order"], p, m.start(), m.end(), m[0], held[0][2], other or ""))
    fields = ("doc_id", "seg_order", "predicate", "char_start", "char_end", "surface_fragment", "subject_id", "object_id")
    assert sorted(tuple(r[f] if r[f] is not None else "" for f in fields) for r in made.claims.collect()) == sorted(want)
    assert len(want) > 100


def test_far_mentions_that_no_claim_can_reach_stay(spark):
    rows = [(d, k * 10, k * 10 + 3, f"e{k % 4}") for d in range(5) for k in range(200)]
    resolved = spark.createDataFrame(rows, "doc_id long, start int, end int, entity_id string")
    ends = spark.createDataFrame([(d, 100 + d) for d in range(4)], "doc_id long, char_end int")
    kept = extract.objects_for(ends, resolved.coalesce(1)).collect()
    assert len(kept) < 100 and {r["doc_id"] for r in kept} == {0, 1, 2, 3}
    assert {(r["doc_id"], r["start"]) for r in kept if r["start"] < 100 + r["doc_id"]} == {(d, s) for d, s, _, _ in rows if d < 4 and s < 100 + d}

"""The stages one by one against brute force, each on what the one before kept."""

import itertools
import re

import pytest

import corpus_pipeline as P
from test_ops import LOWER, SPACE, hits


def cut_by_id(rows, k=20):
    seen, out = set(), {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        w = re.findall(SPACE, r["text"] or "")
        gone = set()
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            if key in seen:
                gone.update(range(i, i + k))
            seen.add(key)
        out[r["doc_id"]] = (" ".join(x for i, x in enumerate(w) if i not in gone) if gone else r["text"], len(gone) < len(w) or not gone)
    return out


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    docs, found = spark.read.parquet(f"{data}/documents.parquet").withColumn("score", P.F.lit("mine")), []
    found.append(docs)
    for name, f in P.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        f(spark, found[-1], data).write.parquet(path)
        found.append(spark.read.parquet(path))
    return found


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
        assert df.select("score").distinct().collect() == [("mine",)]


def test_quality_keeps_what_labels_call_good(spark, data, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages[1].collect()}
    assert sum((d in kept) == (q == 1) for d, q in labels.items()) >= 0.95 * len(labels)


def test_one_of_each_group_stays(stages):
    rows = {r["doc_id"]: re.findall(SPACE, (r["text"] or "").translate(LOWER)) for r in stages[1].collect()}
    sets = {d: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for d, w in rows.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in stages[2].collect()} == {find(d) for d in sets}


def test_repeats_are_cut(stages):
    want = {d: t for d, (t, stays) in cut_by_id(stages[2].collect()).items() if stays}
    got = stages[3].collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_no_benchmark_window_is_left(spark, data, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    before = stages[3].collect()
    clean = {r["doc_id"] for r, h in zip(before, hits([r["text"] for r in before], items), strict=True) if not h[1]}
    assert {r["doc_id"] for r in stages[4].collect()} == clean


def test_all_kept_documents_are_packed(stages):
    assert {r["doc_id"] for r in stages[5].select("doc_id").collect()} == {r["doc_id"] for r in stages[4].collect()}


def test_odd_documents_pass_every_stage(spark, data, docs_of):
    docs = docs_of([None, "", "a b", "a b", "x " * 30_000, None], [1, 2, 3, 3, 4, None])
    for _, f in P.STAGES[1:]:
        docs = f(spark, docs, data)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert {r["doc_id"] for r in docs.collect()} == {1, 2, 3, 4, None}

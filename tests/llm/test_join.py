"""Operator 4's parts that small inputs do not reach by themselves: many cells, many contractions, classes that clash."""

import itertools
import random

import numpy as np

from millrace.llm import ngram_join as J
from millrace.llm.shared import Scratch, components, forest


def roots(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def graph(seed):
    r = random.Random(seed)
    chain = [(k, k + 1) for k in range(400)]
    star = [(1000, 1001 + k) for k in range(300)]
    return chain + star + [(r.randrange(2000, 2600), r.randrange(2000, 2600)) for _ in range(500)]


def test_forest_matches_union_find():
    links = graph(1)
    node, root = forest(*(np.array(x, np.int64) for x in zip(*links)))
    want = roots(links)
    assert dict(zip(node.tolist(), root.tolist())) == {x: y for x, y in want.items() if x != y}


def test_components_by_many_contractions(spark):
    links = graph(2)
    df = spark.createDataFrame(links, "a long, b long")
    for most in (1 << 20, 100):
        got = {r["node"]: r["component"] for r in components(df, Scratch(spark, "t"), most).collect()}
        assert got == {x: y for x, y in roots(links).items() if any(x in e and e[0] != e[1] for e in links)}
    assert components(df.limit(0), Scratch(spark, "t")).count() == 0


def near_copies(seed, many, cut):
    """Texts of one group, some of them short of the threshold to each other."""
    r = random.Random(seed)
    base = [f"w{k}" for k in range(120)]
    out = []
    for _ in range(many):
        words = list(base)
        for _ in range(r.randint(0, cut)):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def brute(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    found = roots([(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    return {k: found.get(k, k) for k in range(len(texts))}


def test_group_of_near_copies_in_many_cells_and_salts(spark, docs_of):
    texts = near_copies(3, 120, 6)
    want = brute(texts)
    assert len(set(want.values())) > 1
    got = {r["doc_id"]: r["component_id"] for r in J.jaccard_classes(spark, docs_of(texts), hot=8, sketch=1 << 13, cell=2000, pairs_at_once=50).collect()}
    assert got == want


def test_classes_whose_first_fingerprints_clash(spark, docs_of, monkeypatch):
    texts = near_copies(4, 12, 8) + ["a b c d e f", "g h i j k l", "a b c d e f"]
    true = J._class_id
    monkeypatch.setattr(J, "_class_id", lambda u: (true(u)[0] % 3, true(u)[1]))
    got = {r["doc_id"]: r["component_id"] for r in J.jaccard_classes(spark, docs_of(texts)).collect()}
    assert got == brute(texts)


def test_one_doc_id_with_two_texts_and_a_very_long_one(spark, docs_of):
    long = " ".join(f"v{k % 70_001}" for k in range(300_000))
    rows = J.jaccard_classes(spark, docs_of(["a b c d e f g", "p q r s t u v", "a b c d e f g h", "p q r s t u v", long, long + " end"], [1, 1, 2, 3, 8, 9])).collect()
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)
    assert got == [(1, 3, 1), (1, 3, 1), (2, 4, 1), (3, 3, 1), (8, got[4][1], 8), (9, got[4][1] + 1, 8)]


def test_no_filter_drops_a_link():
    import pyarrow as pa

    r, links = random.Random(7), 0
    for _ in range(200):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice([6, 30, 120, 700, 3000]))]
        words = list(base)
        for _ in range(r.randint(0, max(1, len(base) // 25))):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        a, b = J.shingle_sets(pa.array([" ".join(base), " ".join(words[: int(len(words) * r.choice([1, 0.9]))])]), 5)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            links += 1
            assert J._alike(J.parities(a), J.parities(b), len(a), len(b), 75)
            assert J.overlap_bound(J.partition_counts(a).tobytes(), J.partition_counts(b).tobytes()) >= J.need(len(a), len(b), 75)
    assert links > 50

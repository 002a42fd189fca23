"""The dictionary join against plain searches of every name in every text."""

import random
import re

import pytest

from millrace.operators import dictionary, extract


def brute(docs, names, words, fold):
    out = []
    for doc, value in docs:
        for name in {n for n in names if n}:
            a, b = (value or "", name)
            if fold:
                a, b = ("".join(c.lower() if len(c.lower()) == 1 else c for c in x) for x in (a, b))
            for at in (m.start() for m in re.finditer(f"(?={re.escape(b)})", a)):
                end = at + len(b)
                inside = (lambda c: c.isalnum()) if words == "unicode" else (lambda c: c.isascii() and c.isalnum())
                if words and (at and inside(a[at - 1]) or end < len(a) and inside(a[end])):
                    continue
                out.append((doc, at, end, name))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    words = ["Acme", "acme", "Corp", "New", "York", "new york", "é", "中国", "𝔘", "ß", "İ", "a", "ab", "abab", "x-1", ".NET", "O'Neil", "the", "The End"]
    docs = [(k, "".join(r.choice(words) + r.choice([" ", "", "-", ", ", "\n"]) for _ in range(r.randint(0, 60)))) for k in range(60)]
    names = list({"".join(r.choice(words) + r.choice(["", " ", "-"]) for _ in range(r.randint(1, 5))).strip() or "z" for _ in range(400)})
    return [*docs, (60, None), (61, ""), (62, "the " * 4000 + "Acme")], [*names, *words, "", None, "absent name of many words that no text has"]


@pytest.mark.parametrize("words,fold,block", [("unicode", False, 1 << 19), ("ascii", True, 97), (None, False, 64), (None, True, 1 << 19), ("unicode", True, 31)])
def test_occurrences_match_brute_force(spark, monkeypatch, words, fold, block):
    monkeypatch.setattr(dictionary, "BLOCK", block)  # tasks of local mode are other processes: the test below goes through blocks
    docs, names = corpus(block)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    n = spark.createDataFrame([(x, k) for k, x in enumerate(names)], "surface string, no int")
    got = sorted((r["doc_id"], r["start"], r["end"], r["surface"]) for r in dictionary.occurrences(d, n.dropDuplicates(["surface"]), words, fold).collect())
    assert got == brute(docs, names, words, fold)


@pytest.mark.parametrize("block", [1, 2, 7, 50])
def test_blocks_of_a_text_join(monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(dictionary, "BLOCK", block)
    docs, names = corpus(3)
    texts = [t or "" for _, t in docs[:20]]
    names = sorted({x for x in names if x})
    seen = dictionary._Characters(False, "unicode")
    full = dictionary.Filter(sorted({len(x) for x in names}), np.full(8, 255, np.uint8))  # lets all through
    raw, start = dictionary.points_of(texts)
    got = set()
    for places, n in dictionary._matches(raw, np.repeat(start[1:], np.diff(start)), full, seen, "unicode"):
        for at in places.tolist():
            doc = int(np.searchsorted(start, at, "right")) - 1
            value = texts[doc][at - start[doc] : at - start[doc] + n]
            if value in names:
                got.add((doc, int(at - start[doc]), int(at - start[doc]) + n, value))
    assert sorted(got) == brute(list(enumerate(texts)), names, "unicode", False)


def test_filter_lets_little_else_through(spark):
    names = spark.range(20_000).selectExpr("concat('Name ', id, ' Corp') AS surface")
    found = dictionary.filter_of(names)
    raw, start = dictionary.points_of([f"Other {k} Corp" for k in range(20_000)] + [f"Name {k} Corp" for k in range(20_000)])
    import numpy as np

    marks = dictionary._Rolling(raw).at(start[:-1], np.diff(start))
    ok = found.passes(marks)
    assert ok[20_000:].all() and ok[:20_000].mean() < 0.1


def test_more_names_than_an_automaton_would_be_given(spark):
    names = spark.range(250_000).selectExpr("concat('Holding ', id) AS surface", "'Organization' AS mention_type")
    docs = spark.createDataFrame([(1, "Holding 249999 and Holding 7, not Holding 250000."), (2, "Holding 12345678")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["surface"], r["start"]) for r in extract.gazetteer_mentions(docs, names).collect())
    assert got == [(1, "Holding 249999", 0), (1, "Holding 7", 19)]


def test_mentions_keep_the_longest_and_strong_identifiers(spark):
    names = spark.createDataFrame([("New York", "Location", None), ("New York Times", "Organization", {"lei": "1"}), ("York", "Location", None), ("NVDA", "Product", None)], "surface string, mention_type string, identifiers map<string,string>")
    value = "The New York Times (NASDAQ: NVDA) of New York, https://www.nyt.example/a?b. Yorkshire."
    docs = spark.createDataFrame([("d", value), ("e", None)], "doc_id string, text string")
    got = sorted((r["start"], r["surface"], r["mention_type"], dict(r["identifiers"]), r["context"]) for r in extract.mentions(docs, names, radius=3).collect())
    assert [x[:4] for x in got] == [(4, "New York Times", "Organization", {"lei": "1"}), (28, "NVDA", "Organization", {"ticker": "NVDA"}), (37, "New York", "Location", {}), (59, "nytexample", "Organization", {"url": "https://www.nyt.example"}), (76, "York", "Location", {})]
    assert got[0][4] == value[1:21]


def test_places_of_few_names_do_not_meet_by_name(spark):
    docs = spark.createDataFrame([(k, "the one and the other") for k in range(50)], "doc_id long, text string")
    names = spark.createDataFrame([("the", "x"), ("and", "y")], "surface string, kind string")
    found = dictionary.occurrences(docs, names)
    assert found.count() == 150
    assert "hashpartitioning(key" not in found._jdf.queryExecution().toString()

"""Signatures of near duplicates: what they hash, and what travels of them."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.operators import dedup


def _runs(value):
    words = re.findall("[a-z0-9]+", value)
    return [" ".join(words[i : i + 5]) for i in range(len(words) - 4)]


def _hash(shingle):
    return int(hashlib.md5(shingle.encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("seed", range(3))
def test_shingle_hashes_are_md5(seed):
    from millrace.functions.shingles import shingle_hashes

    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcxyz0189", k=r.choice([1, 2, 7, 10, 11, 12, 70])))
    texts = ["".join(word() + r.choice([" ", ", ", "é", "\n", "ß-"]) for _ in range(r.choice([0, 1, 4, 5, 6, 40]))) for _ in range(60)]
    texts += ["", "a b c d", "e", "f g h i j", *("x" * n + " y y y y" for n in range(44, 60))]
    column = pa.array(texts, pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(texts) + 1]
    got, many = shingle_hashes(np.frombuffer(column.buffers()[2], np.uint8), offsets)
    assert many.tolist() == [len(_runs(x)) for x in texts]
    assert got.tolist() == [_hash(s) for x in texts for s in _runs(x)]


def test_signatures_are_least_hashes(spark):
    r = random.Random(5)
    texts = {k: " ".join("".join(r.choices("abcdefgh", k=r.randint(1, 13))) for _ in range(r.choice([4, 30, 200, 9000]))).ljust(200, ".") for k in range(12)}
    texts |= {20: "A B C D É" * 60, 21: "A b C d e", 22: None, 23: "." * 300, 24: "Ab cD ef gh ij" + "." * 300}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    got = {x["doc_id"]: x["sig"] for x in dedup.signatures(df).collect()}
    by = dedup.seeds()

    def least(hashes, seed):
        x = np.array(hashes, np.uint64) * np.uint64(seed)
        x = (x ^ x >> np.uint64(32)) * np.uint64(dedup.MIX)
        return int((x ^ x >> np.uint64(29)).min().astype(np.int64))

    want = {k: [_hash(s) for s in _runs(v.lower())] for k, v in texts.items() if v and len(v) >= 200}
    assert got == {k: [least(h, s) for s in by] for k, h in want.items() if h}


def test_signatures_travel_only_where_a_bucket_is_shared(spark, monkeypatch):
    r = random.Random(3)
    rows = [(k, f"t{k}", [r.getrandbits(60) for _ in range(64)]) for k in range(50)]
    rows.append((50, "t50", rows[7][2]))
    held = []

    def cut(df, plain=dedup.cut):
        out = plain(df)
        if {"sig", "band"} <= set(out.columns):
            held.append(out.count())
        return out

    monkeypatch.setattr(dedup, "cut", cut)
    links = dedup.band_links(spark.createDataFrame(rows, "doc_id long, text_sha256 string, sig array<long>"))
    assert [tuple(x) for x in links.select("a", "b").collect()] == [(7, 50)]
    assert max(held) == 2 * dedup.BANDS


def test_roles_meet_only_texts_that_share_a_cluster(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(120)) + "."
    other = lambda n: " ".join(f"{n}x{i}" for i in range(120))
    docs = [(1, base), (2, base), (3, base + " One more sentence."), (4, other(4)), (5, other(5)), (6, "short"), (7, None), (8, other(8)), (8, "of the same id")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    members = dedup.clusters(df).join(df, "doc_id").withColumnRenamed("cluster_min", "cluster")
    want = sorted(map(tuple, dedup.roles(dedup.finalise(members)).collect()))
    held = []

    def cut(df, plain=dedup.cut):
        out = plain(df)
        if "text" in out.columns:
            held.extend(x["doc_id"] for x in out.collect())
        return out

    monkeypatch.setattr(dedup, "cut", cut)
    got = sorted(map(tuple, dedup.document_roles(df).collect()))
    assert got == want
    assert [x[3] for x in got[:3]] == ["root", "derived", "independent"]
    assert sorted(held) == [1, 2, 3, 8, 8]

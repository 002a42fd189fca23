"""Every named query with SQL gives DuckDB's rows; the others run and give rows."""

import pytest

from millrace import queries as Q
from oracle import connect, rows

SLOW_ROWS_ONLY = {"cluster_roles", "near_dup_clusters"}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, data, name):
    got = Q.queries()[name](spark, data).toPandas()
    want = connect(data).sql(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql()) - SLOW_ROWS_ONLY))
def test_runs(spark, data, name):
    assert Q.queries()[name](spark, data).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_exact_minhash_agrees_with_python(spark):
    import hashlib

    from millrace.operators.dedup import signatures

    text = " ".join(f"word{i % 37} other{i % 11}" for i in range(60))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    t = text.split()
    shingles = {" ".join(t[i : i + 5]) for i in range(len(t) - 4)}
    want = [min(int(hashlib.sha256(f"{p}:{s}".encode()).hexdigest()[:12], 16) for s in shingles) for p in range(8)]
    assert signatures(df, exact=True, perms=8).first()["sig"] == want


def test_one_bucket_of_near_copies_links_as_all_pairs_do(spark):
    import random

    from millrace.operators.components import components
    from millrace.operators.dedup import band_links, candidate_pairs

    r = random.Random(2)
    base = [r.getrandbits(60) for _ in range(64)]
    rows = []
    for k in range(700):  # all share the first band; every fifth is unlike the others but for it, some of these in pairs
        sig = list(base)
        for at in r.sample(range(8, 64), 3):
            sig[at] = r.getrandbits(60)
        if k % 5 == 0:
            sig = base[:8] + [(k // 10) * 1000 + i for i in range(56)]
        rows.append((k, f"t{k}", sig))
    sigs = spark.createDataFrame(rows, "doc_id long, text_sha256 string, sig array<long>")
    of = lambda links: {(x["node"], x["component"]) for x in components(links).collect()}
    links = band_links(sigs, most=20).cache()
    pairs = candidate_pairs(sigs)
    assert of(links.select("a", "b")) == of(pairs.select("a", "b"))
    assert links.count() < 700 * 10 < pairs.count()


def test_near_copies_cluster(spark):
    from millrace.operators.dedup import clusters, finalise, roles

    base = " ".join(f"w{i}" for i in range(120)) + "."
    docs = [(1, base), (2, base), (3, base + " One more sentence."), (4, " ".join(f"x{i}" for i in range(120)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["cluster_min"] for r in clusters(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
    members = clusters(df).join(df, "doc_id").withColumnRenamed("cluster_min", "cluster")
    assert {r["doc_id"]: r["role"] for r in roles(finalise(members)).collect()} == {1: "root", 2: "derived", 3: "independent", 4: "root"}

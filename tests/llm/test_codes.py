"""Heap Lloyd against plain Lloyd on Python integers, and its heaps against sorted lists."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, n long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 1) for r in rows], SCHEMA)


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // parts
    cut = [[v[p * d : p * d + d] for p in range(parts)] for _, v, _ in kept]
    books = [[list(x[p]) for x in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(b)), key=lambda j: (far(x[p], b[j]), j)) for p, b in enumerate(books)] for x in cut]  # noqa: E731,B023
    for _ in range(rounds):
        own = assign()
        for p, book in enumerate(books):
            for j in range(len(book)):
                if mine := [x[p] for x, a in zip(cut, own, strict=True) if a[p] == j]:
                    book[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    own = assign()
    errors = [sum(far(x[p], books[p][a[p]]) for p in range(parts)) for x, a in zip(cut, own, strict=True)]
    by_label = defaultdict(int)
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    rows = [(i, "".join(f"{k:02x}" for k in a), e, by_label[label]) for (i, _, label), a, e in zip(kept, own, errors, strict=True)]
    return rows, [[c for entry in book for c in entry] for book in books]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("seed", range(3))
def test_codes_match_plain_lloyd(spark, seed):
    from millrace.llm.heap_lloyd import compress

    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((9, 16))
    vectors = (centres[rng.integers(0, 9, 260)] + rng.standard_normal((260, 16)) * (0.02, 0.3, 0)[seed]).astype(np.float32).tolist()
    vectors = vectors + [vectors[3]] * 90 + [None, [None] * 16, [float("nan")] * 16, [float("-inf")] + [0.0] * 15]
    ids = [None, 5, 5, *range(3, len(vectors))]
    rows = [(i, v, None if k % 3 == 0 else k % 4) for k, (i, v) in enumerate(zip(ids, vectors, strict=True))]
    got = compress(spark, table(spark, rows).repartition(5))
    want, books = brute(rows)
    assert got.books == books
    assert ordered(tuple(r[c] for c in ("vec_id", "code", "error", "label_error")) for r in got.rows.collect()) == ordered(want)
    if seed == 0:
        assert got.compared[-1] < got.compared[0] / 2


def test_query_gives_the_digest_of_the_books(spark, tmp_path):
    from millrace.llm.queries import op11_vector_codes

    rows = [(k, [((k * 7 + j * j) % 13) / 8 for j in range(8)], 1) for k in range(40)]
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    want, books = brute(rows)
    got = op11_vector_codes(spark, str(tmp_path)).collect()
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(",".join(str(c) for b in books for c in b).encode()).hexdigest()}
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == want


def test_few_rows_large_components_and_none(spark):
    from millrace.llm.heap_lloyd import compress

    assert compress(spark, table(spark, [])).rows.collect() == []
    assert compress(spark, table(spark, [(1, None, 1)])).rows.collect() == []
    for rows in ([(4, [0.5] * 8, None)], [(k, [k * 900.0 - 2000.25] * 8, k) for k in range(6)], [(1, [1.0] * 8, 2)] * 7):
        got = compress(spark, table(spark, rows))
        want, books = brute(rows)
        assert got.books == books and ordered(tuple(r[c] for c in ("vec_id", "code", "error", "label_error")) for r in got.rows.collect()) == ordered(want)
    for bad in ([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], [(1, [1.0] * 9, 1)]):
        with pytest.raises(ValueError):
            compress(spark, table(spark, bad))


def test_heaps_pop_what_a_scan_finds():
    from millrace.llm.heap_lloyd import Heap

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 300):
        heap, plain = Heap(keys := rng.integers(0, 50, n) / 2, np.arange(n), made=False), dict(enumerate(keys))
        fresh = n
        for _ in range(25):
            counter = rng.integers(-1, 30)
            at = heap.violated(counter)
            assert sorted(heap.rows[at]) == sorted(r for r, k in plain.items() if k <= counter)
            for r in heap.rows[at]:
                plain.pop(int(r))
            keys = rng.integers(0, 60, rng.integers(0, len(at) + 4)) / 2
            rows = np.arange(fresh, fresh + len(keys))
            fresh += len(keys)
            heap.replace(at, keys, rows)
            plain |= dict(zip(rows.tolist(), keys, strict=True))
            assert dict(zip(heap.rows.tolist(), heap.keys.tolist(), strict=True)) == plain
            assert all(heap.keys[(k - 1) // 2] <= heap.keys[k] for k in range(1, len(heap.keys)))

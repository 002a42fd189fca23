"""Whitening against the dense covariance, by exact integers where the contract asks for them."""

import math
from fractions import Fraction

import numpy as np
import pytest

SCHEMA = "vec_id long, embedding array<float>, label int, n long, whitened string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 0, 1, "w") for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def check(rows, vectors, ids, k=4):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in zip(ids, vectors, strict=True) if usable(v)]
    x = np.array(sorted({tuple(v) for _, v in kept}), dtype=object)
    n, total = len(x), x.sum(0)
    exact = np.array([[float(Fraction(n * int(a) - int(s), n)) for a, s in zip(row, total, strict=True)] for row in x])
    cov = exact.T @ exact / n
    values, parts = np.linalg.eigh(cov)
    values, parts = values[::-1], parts[:, ::-1]
    k = min(k, x.shape[1])
    got = {}
    for r in rows:
        got.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    assert len(rows) == k * len(kept)
    signs = {}
    for i, v in kept:
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(v, total, strict=True))
        own = got[i, deviation]
        for c in range(1, k + 1):
            for r in own[c]:
                assert r["n"] == n and r["identity_error"] <= 1e-9
                want = float((np.array(v) - np.array([float(Fraction(int(s), n)) for s in total])) @ parts[:, c - 1])
                if values[c - 1] <= 1e-9 * max(values[0], 1):
                    assert r["whitened"] is None and r["explained"] < 1e-12
                    continue
                want /= math.sqrt(values[c - 1])
                if abs(want) > 1e-6:
                    assert signs.setdefault(c, np.sign(want * r["whitened"])) == np.sign(want * r["whitened"])
                assert abs(abs(want) - abs(r["whitened"])) < 1e-7
                assert r["explained"] == pytest.approx(values[c - 1] / np.trace(cov), rel=1e-9)


@pytest.mark.parametrize("shape", ["decaying", "flat"])
def test_components_match_dense_eigenvectors(spark, shape):
    from millrace.llm.whiten import whiten

    rng = np.random.default_rng(3)
    width = 24
    spread = 2.0 ** -np.arange(width) if shape == "decaying" else 1 + 0.01 * rng.random(width)
    vectors = (rng.standard_normal((300, width)) * spread * 3).astype(np.float32).tolist()
    vectors += vectors[:40] + [vectors[0]] * 60
    vectors += [None, [None] * width, [float("nan")] + [0.0] * (width - 1), [float("inf")] * width]
    ids = [None, 7, 7, *range(3, len(vectors))]
    check(whiten(spark, table(spark, vectors, ids)).collect(), vectors, ids)


def test_passes_end_by_residuals(spark):
    from millrace.llm.shared import Scratch
    from millrace.llm.whiten import fit_list, principal

    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 60)) * 0.6 ** np.arange(60) * 40
    scratch = Scratch(spark, "test")
    rows = spark.createDataFrame([(v,) for v in x.tolist()], "v array<double>")
    found = principal(fit_list(rows, scratch, 256, 60), 60, 4)
    v = np.cov(np.floor(256 * x).T, bias=True)
    assert found.residual <= 1e-13 and 1 < found.passes < 12
    assert np.abs(v @ found.components - found.components * found.values).max() <= 1e-11 * found.values[0]


def test_degenerate_tables(spark):
    from millrace.llm.whiten import whiten

    assert whiten(spark, table(spark, [])).collect() == []
    assert whiten(spark, table(spark, [None, [float("nan"), 1.0]])).collect() == []
    for vectors in ([[0.5, 1.0]], [[0.5, 1.0]] * 5, [[0.1, 0.2, 0.3, 0.4, 0.5], [0.9, 0.2, 0.3, 0.4, 0.5], [0.5, 0.9, 0.3, 0.4, 0.5]], [[1e6, -1e6, 0.0], [-1e6, 5.0, 1.0]]):
        if vectors[0][0] == 1e6:
            rows = whiten(spark, table(spark, vectors)).collect()
            assert {r["deviation"] for r in rows} == {(2 * int(256e6) - 0) ** 2 + (-int(256e6) - 1280) ** 2 + 256**2}
            continue
        check(whiten(spark, table(spark, vectors)).collect(), vectors, range(len(vectors)))
    with pytest.raises(ValueError):
        whiten(spark, table(spark, [[1.0, 2.0], [1.0]]))

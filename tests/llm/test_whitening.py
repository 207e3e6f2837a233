import math

import numpy as np
import pytest

from talkgrain.llm.common import Scratch
from talkgrain.llm.whitening import gaps, jacobi, whitened
from tests.llm.fixtures import rows

KIND = "vec_id long, embedding array<float>, label int, x string, n int"


def plain(vectors, components=16):
    """The contract, with exact sums and a library's eigenvalues."""
    ok = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in ok})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = np.array([[(n * a - b) / n for a, b in zip(x, s, strict=True)] for x in fit])
    v = c.T @ c / n
    value, axes = np.linalg.eigh(v)
    value, axes = value[::-1][:components], axes[:, ::-1][:, :components]
    out = {}
    for i, x in ok:
        gap = [n * a - b for a, b in zip(x, s, strict=True)]
        y = np.array(gap) / n @ axes / np.sqrt(value)
        for k in range(len(value)):
            out[i, k + 1] = (n, sum(g * g for g in gap), y[k], value[k] / np.trace(v))
    return out


def check(got, want):
    assert sorted((r["vec_id"], r["component"]) for r in got) == sorted(want)
    sign = {}
    for r in got:
        n, deviation, y, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert r["explained"] == pytest.approx(explained, rel=1e-9)
        assert r["identity_error"] < 1e-9
        if abs(y) > 1e-6:
            assert sign.setdefault(r["component"], np.sign(r["whitened"] * y)) == np.sign(r["whitened"] * y)
        assert abs(r["whitened"]) == pytest.approx(abs(y), abs=1e-7)


def vectors(n=200, d=20, seed=1):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) * np.linspace(5, 0.3, d) + r.normal(size=d)).astype(np.float32)


def test_against_a_plain_decomposition(spark):
    v = [(i, x.tolist()) for i, x in enumerate(vectors())]
    v += [(900 + i, v[0][1]) for i in range(100)]  # copies count once
    odd = [(7001, None), (7002, [None] + [1.0] * 19), (7003, [math.nan] + [1.0] * 19), (7004, [math.inf] + [1.0] * 19), (7005, []), (7006, [1.0, 2.0])]
    df = spark.createDataFrame([(i, x, 1, "x", 2) for i, x in v + odd], KIND)
    check(rows(whitened(df, Scratch(spark, "t"))), plain(v))


def test_fewer_dimensions_than_components_and_repeated_ids(spark):
    v = [(i, x.tolist()) for i, x in enumerate(vectors(50, 3))]
    df = spark.createDataFrame([(i, x, 1, "x", 2) for i, x in v], KIND)
    check(rows(whitened(df, Scratch(spark, "t"))), plain(v))
    twice = spark.createDataFrame([(i // 2 if i else None, x, 1, "x", 2) for i, x in v], KIND)
    got = rows(whitened(twice, Scratch(spark, "t")))
    assert len(got) == 150 and sum(r["vec_id"] is None for r in got) == 3
    assert {r["deviation"] for r in got} == {d for _, d, *_ in plain(v).values()}


def test_no_extent(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 1, "x", 2), (2, [1.0, 2.0], 1, "x", 2)], KIND)
    got = rows(whitened(one, Scratch(spark, "t")))
    assert len(got) == 4 and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, None, None) for r in got)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, -1.0 * i], 1, "x", 2) for i in range(9)], KIND)
    got = rows(whitened(line, Scratch(spark, "t")))
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in got)
    assert got[0]["identity_error"] < 1e-9
    assert whitened(one.filter("false"), Scratch(spark, "t")).collect() == []


def test_large_entries_stay_exact(spark):
    v = [(i, [float(i) * 1e12, 3.0 * i]) for i in range(6)]
    df = spark.createDataFrame([(i, x, 1, "x", 2) for i, x in v], KIND.replace("float", "double"))
    got = rows(whitened(df, Scratch(spark, "t")))
    want = plain(v)
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(i, d if d < 2**63 else None) for (i, _), (_, d, *_) in want.items()}
    x = np.array([[2**52, 5]])
    assert gaps(x, 10**6, [7, 8]).tolist() == [[10**6 * 2**52 - 7, 5 * 10**6 - 8]]


def test_rotations():
    r = np.random.default_rng(2)
    for d in (1, 2, 17, 40):
        q, _ = np.linalg.qr(r.normal(size=(d, d)))
        a = q @ np.diag(np.logspace(0, -9, d)) @ q.T
        a = (a + a.T) / 2
        value, v = jacobi(a)
        assert np.allclose(value, np.linalg.eigvalsh(a)[::-1], rtol=1e-6, atol=1e-16)
        assert np.allclose(v.T @ v, np.eye(d), atol=1e-13) and np.allclose(a @ v, v * value, atol=1e-13)
    # A graded matrix keeps small eigenvalues to full relative accuracy: d a d with a well conditioned.
    g = np.diag([1.0, 1e-8, 1e-16])
    value, _ = jacobi(g @ (np.eye(3) + 0.1) @ g)
    # From the exact characteristic polynomial's leading terms.
    assert value[2] == pytest.approx(1e-32 * np.linalg.det(np.eye(3) + 0.1) / np.linalg.det((np.eye(3) + 0.1)[:2, :2]), rel=1e-12)
    jacobi(np.ones((5, 5)))
    jacobi(np.zeros((4, 4)))
    w = r.normal(size=(3, 30))
    assert np.allclose(jacobi(w.T @ w)[0][:3], np.linalg.eigvalsh(w @ w.T)[::-1])

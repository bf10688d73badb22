"""Whitening against plain eigenvalues of the covariance."""
import numpy as np
import pytest

from srcgraph.llm import whitening


def plain(table, components=4):
    """vec_id -> rows by plain means: distinct fixed-point vectors, covariance, eigenvalues."""
    rows = [(i, np.floor(256.0 * np.array(v, dtype=float)).astype(np.int64)) for i, v in table]
    fit = np.array(sorted({tuple(x.tolist()) for _, x in rows}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    out = {}
    for i, x in rows:
        dev = sum((n * int(c) - int(s)) ** 2 for c, s in zip(x, sums))
        out.setdefault(i, []).append((n, dev, (x - sums / n) @ axes / np.sqrt(values), values / np.trace(cov)))
    return out


def compare(spark, table, expected=None):
    frame = spark.createDataFrame(table, "vec_id long, embedding array<float>")
    expected = expected or plain(table)
    got = {}
    for r in whitening.whiten(frame).collect():
        got.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    assert {k[0] for k in got} == set(expected)
    for (i, component), rows in got.items():
        assert len(rows) == len(expected[i])
        for r, (n, dev, white, share) in zip(rows, expected[i]):
            assert (r.n, r.deviation) == (n, dev)
            assert r.explained == pytest.approx(share[component - 1], rel=1e-9)
            assert abs(r.whitened) == pytest.approx(abs(white[component - 1]), abs=1e-7)
            if abs(r.whitened) > 1e-3:
                signs.setdefault(component, set()).add(np.sign(r.whitened) == np.sign(white[component - 1]))
            assert r.identity_error < 1e-9
    assert all(len(s) == 1 for s in signs.values())
    return got


def vectors(n, width, seed=3):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(width, width)) * np.geomspace(1, 0.05, width)
    return (rng.normal(size=(n, width)) @ mix.T).astype(np.float32)


def test_equal_to_plain_eigenvalues(spark):
    data = vectors(400, 12)
    table = [(i, v.tolist()) for i, v in enumerate(data)]
    table += [(1000 + i, data[7].tolist()) for i in range(200)]  # a third of the rows is one vector
    got = compare(spark, table)
    assert len(got) == 4 * 600


def test_ill_conditioned_and_dependent_columns(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 5)) * [1000, 100, 10, 5, 4]
    data = np.hstack([base, base[:, :2] * 2, np.full((300, 1), 0.5)]).astype(np.float32)
    compare(spark, [(i, v.tolist()) for i, v in enumerate(data)])


def test_rows_that_go(spark):
    data = vectors(50, 6)
    good = [(i, v.tolist()) for i, v in enumerate(data)] + [(3, data[3].tolist()), (None, data[4].tolist())]
    bad = [(100, None), (101, []), (102, [1.0] * 5 + [None]), (103, [float("nan")] * 6), (104, [float("inf")] + [0.0] * 5),
           (105, [1.0, 2.0])]
    compare(spark, good + bad, plain(good))


def test_few_components_and_none(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int, n string")
    line = whitening.whiten(frame([(i, [float(i), 2.0 * i, 1.0], 9, "x") for i in range(10)])).collect()
    assert sorted((r.vec_id, r.component) for r in line) == [(i, 1) for i in range(10)]
    assert whitening.whiten(frame([(i, [1.0, 2.0], 9, "x") for i in range(3)])).collect() == []
    assert whitening.whiten(frame([])).collect() == []
    assert whitening.whiten(frame([(1, None, 9, "x")])).collect() == []


def test_deviation_is_exact_or_an_error():
    w = whitening.Whitening(3, np.array([1, 2]), None, None, 1.0)
    x = np.array([[2 ** 29, 5], [0, 0]])
    assert w.deviation(x).tolist() == [(3 * 2 ** 29 - 1) ** 2 + 13 ** 2, 5]
    with pytest.raises(OverflowError):
        w.deviation(np.array([[2 ** 40, 5]]))


def test_shift_is_needed(spark):
    """Without the passes after the first the rows are not orthonormal, and without the shift there is no first."""
    gram = np.ones((3, 3))
    with pytest.raises(np.linalg.LinAlgError):
        np.linalg.cholesky(gram - 1e-12 * np.eye(3))
    factor = whitening.shifted(gram, 10)
    assert np.allclose(factor.T @ factor, gram, atol=1e-10)
    rows = np.random.default_rng(0).normal(size=(5, 3))
    upper = np.triu(np.random.default_rng(1).normal(size=(3, 3))) + 3 * np.eye(3)
    assert np.allclose(whitening.solve(rows, upper) @ upper, rows)

"""Matrix filters and smoothers, and the backward ensemble smoother, against step-by-step numpy."""

import numpy as np
import pytest

from twinlake.operators import smoothers as sm
from twinlake.plans.matrix_kalman import Model, kalman_matrix


def model(d, ny, seed):
    g = np.random.default_rng(seed)
    pd = lambda n: (lambda a: a @ a.T + 0.3 * np.eye(n))(g.normal(size=(n, n)))
    f = g.normal(size=(d, d))
    return Model(f / (1.05 * np.abs(np.linalg.eigvals(f)).max()), pd(d), g.normal(size=(ny, d)), pd(ny), g.normal(size=d), pd(d))


def steps(o, y, relax):
    m, p, fwd = o.m0, o.p0, []
    for v in y:
        mf, pf = o.f @ m, o.f @ p @ o.f.T + o.q
        m, p = mf, pf
        if v is not None:
            k = pf @ o.h.T @ np.linalg.inv(o.h @ pf @ o.h.T + o.r)
            m, p = mf + k @ (v - o.h @ mf), (np.eye(len(m)) - k @ o.h) @ pf
        fwd.append((mf, pf, m, p))
    s, ps = fwd[-1][2:]
    out = [(s, ps)]
    for (_, _, m, p), (mf, pf, _, _) in zip(fwd[-2::-1], fwd[:0:-1], strict=True):
        j = relax * p @ o.f.T @ np.linalg.inv(pf)
        s, ps = m + j @ (s - mf), p + j @ (ps - pf) @ j.T
        out.append((s, ps))
    return fwd, out[::-1]


@pytest.mark.parametrize(("d", "ny", "relax", "size"), [(2, 1, 1.0, 7), (3, 2, 0.9, 16), (1, 1, 1.0, 100)])
def test_matrix_filter_and_smoother(spark, d, ny, relax, size):
    o, g = model(d, ny, d), np.random.default_rng(1)
    y = [None if k % 4 == 1 else g.normal(size=ny) for k in range(53)]
    y[-1] = g.normal(size=ny)
    rows = [("a", k + 1, None if v is None else v.tolist()) for k, v in enumerate(y)] + [("b", 1, y[0].tolist()), ("c", 1, [None] * ny)]
    s = spark.createDataFrame(rows, "sys string, k long, y array<double>").repartition(3)
    fwd, smooth = steps(o, y, relax)
    got = sorted((r for r in kalman_matrix(s, o, True, relax, size).collect() if r.sys == "a"), key=lambda r: r.k)
    assert [r.k for r in got] == list(range(1, 54))
    for r, (mf, _, m, p), (ms, ps) in zip(got, fwd, smooth, strict=True):
        assert np.allclose(r.forecast, mf) and np.allclose(r["mean"], m) and np.allclose(r["cov"], p.ravel())
        assert np.allclose(r.smoothed, ms) and np.allclose(r.smoothed_cov, ps.ravel())
    only = {r.sys: r for r in kalman_matrix(s, o, size=size).collect() if r.sys != "a"}
    assert np.allclose(only["c"]["mean"], o.f @ o.m0) and np.allclose(only["b"]["mean"], fwd[0][2])


def test_ensemble_smoother(spark):
    g, (members, times, dims) = np.random.default_rng(2), (9, 11, 3)
    f, a = g.normal(size=(times, members, dims)), g.normal(size=(times, members, dims))
    want = a.copy()
    for k in range(times - 2, -1, -1):
        j = 0.9 * np.linalg.pinv(f[k + 1] - f[k + 1].mean(0)) @ (a[k] - a[k].mean(0))
        want[k] = a[k] + (want[k + 1] - f[k + 1]) @ j
    table = lambda x: spark.createDataFrame([(e, n, k, i, float(x[k, n, i])) for e in (1, 2) for n in range(members) for k in range(times) for i in range(dims)], "ens long, n long, k long, i long, x double")
    got = sm.ensemble_rts(table(f), table(a), dims, relax=0.9, size=4, chunk=4).collect()
    assert len(got) == 2 * members * times * dims
    assert max(abs(r.x - want[r.k, r.n, r.i]) for r in got) < 1e-9

"""Grids and blocks: the same results as without them, wherever their edges lie."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlake.functions import series as se
from twinlake.operators import localization as lo
from twinlake.operators import particle as pa
from twinlake.plans import filters


@pytest.mark.parametrize(("period", "cell", "reach"), [(7.0, 2.0, 2.0), (10.0, 3.0, 4.9), (5.0, 9.0, 1.0), (360.0, 4.5, 9.0), (6.0, 1.0, 10.0)])
def test_near_pairs(spark, period, cell, reach):
    rng = np.random.default_rng(0)
    p, s = np.concatenate([[0.1], rng.uniform(0, period, 30)]), np.concatenate([[period - 1.5], rng.uniform(0, period, 30)])
    frame = lambda x: spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, pos double")
    got = {(r.p, r.s): r.dist for r in lo.near_pairs(frame(p), frame(s), cell, reach, period).collect()}
    d = np.abs(p[:, None] - s[None])
    d = np.minimum(d, period - d)
    assert set(got) == {(i, j) for i, j in zip(*np.nonzero(d <= reach), strict=True)}
    assert all(abs(d[k] - v) < 1e-9 for k, v in got.items())


@pytest.mark.parametrize("period", [None, [10.0, 7.0, 3.0]])
def test_near_points(spark, period):
    rng = np.random.default_rng(1)
    p, s = (rng.uniform(0, 1, (40, 3)) * (period or [10, 7, 3]) for _ in range(2))
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, pos array<double>")
    got = {(r.p, r.s) for r in lo.near_points(frame(p), frame(s), 3, 1.3, 2.0, period).collect()}
    d = np.abs(p[:, None] - s[None])
    if period:
        d = np.minimum(d, np.array(period) - d)
    assert got == {(i, j) for i, j in zip(*np.nonzero(np.sqrt((d**2).sum(2)) <= 2), strict=True)}


def walk(spark, n=53):
    rng = np.random.default_rng(2)
    y = {s: rng.normal(size=m).cumsum() for s, m in (("a", n), ("b", 20), ("c", 1))}
    return y, spark.createDataFrame([(s, k + 1, float(v)) for s, x in y.items() for k, v in enumerate(x)], "sys string, k long, y double")


@pytest.mark.parametrize("size", [1, 7, 20, 1000])
def test_kalman_by_blocks(spark, size):
    y, d = walk(spark)
    f, q, r = 0.97, 0.3, 0.8
    got = {(x.sys, x.k): x for x in filters.kalman(d, f, q, r, smooth=True, size=size).collect()}
    for s, x in y.items():
        m, p, fc, pf = x[0], r, [x[0]], [r]
        ms, ps = [m], [p]
        for v in x[1:]:
            fc.append(f * m)
            pf.append(f * f * p + q)
            g = pf[-1] / (pf[-1] + r)
            m, p = fc[-1] + g * (v - fc[-1]), (1 - g) * pf[-1]
            ms.append(m)
            ps.append(p)
        z = [ms[-1]]
        for k in range(len(x) - 2, -1, -1):
            z.append(ms[k] + ps[k] * f / pf[k + 1] * (z[-1] - fc[k + 1]))
        z = z[::-1]
        for k in range(len(x)):
            one = got[s, k + 1]
            assert np.allclose([one.forecast, one.mean, one.var, one.smoothed], [fc[k], ms[k], ps[k], z[k]], atol=1e-9), (s, k)


def test_series_by_blocks(spark, monkeypatch):
    y, d = walk(spark)
    whole = [sorted(map(tuple, x.collect())) for x in (se.rolling(d, 3), filters.previous_observation(d, 5), filters.persistence(d))]
    acov = {r.sys: r.acov for r in se.autocovariance(d).collect()}
    monkeypatch.setattr(se.blocked, "__defaults__", (0, 0, "k", 6))
    parts = [sorted(map(tuple, x.collect())) for x in (se.rolling(d, 3), filters.previous_observation(d, 5), filters.persistence(d))]
    for a, b in zip(whole, parts, strict=True):
        assert [x[:2] for x in a] == [x[:2] for x in b]
        assert all((u is None and v is None) or abs(u - v) < 1e-9 for x, w in zip(a, b, strict=True) for u, v in zip(x[2:], w[2:], strict=True))
    assert all(np.allclose(r.acov[:3], acov[r.sys][:3], atol=1e-9, equal_nan=True) for r in se.autocovariance(d).collect() if r.sys != "c")
    rolled = {(r.sys, r.k): r for r in se.rolling(d, 3).collect()}
    for s, x in y.items():
        for k in range(len(x)):
            assert abs(rolled[s, k + 1].running - x[: k + 1].mean()) < 1e-9 and abs(rolled[s, k + 1].rolling - x[max(0, k - 3) : k + 1].mean()) < 1e-9


def test_draws_by_slices(spark, monkeypatch):
    monkeypatch.setattr(pa, "SLICE", 4)
    rng = np.random.default_rng(4)
    w, u = rng.dirichlet(np.full(40, 0.2)), rng.uniform(size=40)
    p = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(w)], "sys string, n long, w double")
    d = spark.createDataFrame([("a", float(v)) for v in u], "sys string, u double")
    got = {r.n: r.copies for r in pa.multinomial(p, d).collect()}
    want = np.bincount(np.searchsorted(np.cumsum(w), u, "right"), minlength=40)
    assert [got[i] for i in range(40)] == want.tolist()
    comb = {r.n: r.copies for r in pa.systematic(p, 0.4).collect()}
    assert sum(comb.values()) == 40 and all(abs(comb[i] - 40 * w[i]) < 1 for i in range(40))


def test_adaptive_root_goes_on(spark):
    p = spark.createDataFrame([("a", i, v) for i, v in enumerate([1 - 3e-12, 1e-12, 1e-12, 1e-12])] + [("b", i, 0.25) for i in range(4)] + [("c", 0, 1.0), ("c", 1, 0.0), ("c", 2, 0.0)], "sys string, n long, w double")
    got = {r.sys: r.root for r in pa.adaptive_root(p, 0.9, 0.5, 4).collect()}
    assert got["b"] == 1.0 and got["c"] is None and got["a"] > 8
    v = np.array([1 - 3e-12, 1e-12, 1e-12, 1e-12])
    n_eff = lambda r: (v ** (1 / r)).sum() ** 2 / (v ** (2 / r)).sum()
    assert n_eff(got["a"]) >= 3.6 > n_eff(got["a"] - 0.5)


def test_an_observation_at_the_start_is_an_error(spark):
    from twinlake.functions import statistics as st

    e = spark.createDataFrame([("a", 0, 0, "a", 1.0, 1.0)], "sys string, k long, ko long, sub string, mu double, var double")
    truth = spark.createDataFrame([("a", 0, 1.5)], "sys string, k long, x double")
    with pytest.raises(Exception, match="no observation at the start"):
        st.assess(e, truth).collect()
    got = {r.stat: r.value for r in st.assess(e.withColumn("ko", F.lit(None).cast("long")), truth).collect()}
    assert got["err"] == -0.5 and got["rms"] == 0.5 and got["spread"] == 1.0

"""Ensemble updates that SQL does not express, against plain numpy."""

import numpy as np
import pytest

from twinlake.operators import assimilation as da
from twinlake.operators.localization import FACTORS

SIZE, MEMBERS = 16, 8


def ensemble(spark, seed=0):
    x = np.random.default_rng(seed).normal(size=(MEMBERS, SIZE))
    rows = [(1, n, i, float(x[n, i])) for n in range(MEMBERS) for i in range(SIZE)]
    return x, spark.createDataFrame(rows, "ens long, n long, i long, x double")


def back(df):
    out = np.full((MEMBERS, SIZE), np.nan)
    for r in df.collect():
        out[r.n, r.i] = r.x
    return out


def test_local_transform(spark):
    x, e = ensemble(spark)
    sites, y, r, radius = [0, 5, 10], [0.3, -0.2, 0.5], 0.4, 1.5
    obs = spark.createDataFrame([(j, i, v) for j, (i, v) in enumerate(zip(sites, y, strict=True))], "j long, i long, y double")
    got = back(da.local_transform(e, obs, r, radius, SIZE, batch=2, kind="Quadro"))
    want, mu, a = x.copy(), x.mean(0), x - x.mean(0)
    for b in range(0, SIZE, 2):
        dist = np.array([np.mean([min(abs(i - s), SIZE - abs(i - s)) for i in (b, b + 1)]) for s in sites]) / (radius * FACTORS["Quadro"])
        h = np.where(dist <= 1, (1 - dist**4) ** 4, 0)
        near = h > 1e-3
        if near.any():
            root = np.sqrt(h[near] / r)
            ya, dy = a[:, sites][:, near] * root, (np.array(y) - mu[sites])[near] * root
            inv = np.linalg.inv(ya @ ya.T + (MEMBERS - 1) * np.eye(MEMBERS))
            d, v = np.linalg.eigh(inv * (MEMBERS - 1))
            want[:, b : b + 2] = mu[b : b + 2] + (inv @ ya @ dy + v * np.sqrt(d) @ v.T) @ a[:, b : b + 2]
    assert np.allclose(got, want, atol=1e-9)


def test_rank_histogram_update(spark):
    x, e = ensemble(spark, 1)
    obs, r, k = 0.4, 0.3, 2
    got = back(da.rank_histogram_update(e, k, obs, r))
    d = (obs - x[:, k]) / np.sqrt(r)
    order = np.argsort(d)
    w = np.exp(-0.5 * d[order] ** 2)
    cw = np.cumsum(np.maximum(w / w.sum(), 1e-10))
    cw = cw / cw[-1] * (MEMBERS - 1) / MEMBERS
    q = np.clip((np.arange(MEMBERS) + 0.5) / MEMBERS, cw[0], cw[-1])
    move = np.empty(MEMBERS)
    move[order] = np.interp(q, cw, d[order]) - d[order]
    a = x - x.mean(0)
    want = x - np.sqrt(r) * np.outer(move, a.T @ a[:, k] / (a[:, k] @ a[:, k]))
    assert np.allclose(got, want, atol=1e-9)


def test_finite_size_inflation(spark):
    x, e = ensemble(spark, 2)
    sites, r = [1, 6, 9], 0.5
    y = [2.0, -3.0, 1.5]
    obs = spark.createDataFrame([(j, i, v) for j, (i, v) in enumerate(zip(sites, y, strict=True))], "j long, i long, y double")
    got = da.finite_size_inflation(e, obs, r).first().infl
    a = (x - x.mean(0))[:, sites] / np.sqrt(r)
    dy = (np.array(y) - x.mean(0)[sites]) / np.sqrt(r)
    n = MEMBERS
    lam, v = np.linalg.eigh(a.T @ a)
    full = np.concatenate([lam, np.zeros(n - len(lam))])
    en, cl = (n + 1) / n, n / (n - 1)
    fix = np.sqrt((en / cl) ** (np.mean(1 / (full + n - 1)) * (n - 1)))
    cost = lambda f: np.sum((v.T @ dy) ** 2 / (f * f * lam + n - 1)) + en / fix / f**2 + cl * fix * np.log(f * f)
    grid = np.exp(np.linspace(-2, 2, 40001))
    assert got == pytest.approx(grid[np.argmin([cost(f) for f in grid])], abs=1e-3)


def test_localised_update_leaves_far_variables(spark):
    from pyspark.sql import functions as F

    x, e = ensemble(spark, 3)
    got = back(da.localised_update(e, 3, 0.5, 0.2, F.when(F.col("i") < 6, 1.0).otherwise(0.0)))
    assert np.array_equal(got[:, 6:], x[:, 6:]) and not np.allclose(got[:, 3], x[:, 3])
    v = x[:, 3].var(ddof=1)
    assert got[:, 3].var(ddof=1) == pytest.approx(v * 0.2 / (v + 0.2)) and got[:, 3].mean() == pytest.approx(x[:, 3].mean() + v / (v + 0.2) * (0.5 - x[:, 3].mean()))


def test_spectra_by_either_side(spark):
    """Few members in a large state and many in a small one: values and misfits of the singular vectors."""
    for members, size in ((5, 9), (12, 4)):
        g = np.random.default_rng(members)
        x, truth = g.normal(size=(members, size)), g.normal(size=size)
        e = spark.createDataFrame([(1, n, i, float(x[n, i])) for n in range(members) for i in range(size)], "ens long, n long, i long, x double")
        t = spark.createDataFrame([(i, float(truth[i])) for i in range(size)], "i long, truth double")
        _, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
        many = min(members - 1, size)
        for side in ("state", "members"):
            got = sorted(da.ensemble_spectra(e, t, size, side).collect(), key=lambda r: r.s)[:many]
            assert np.allclose([r.sval for r in got], s[:many] / np.sqrt(members - 1))
            assert np.allclose([abs(r.umisf) for r in got], np.abs(v[:many] @ (x.mean(0) - truth)))


def test_assessment_refuses_what_is_not_finite_or_not_weighed(spark):
    from twinlake.functions import statistics as st

    rows = lambda x, w: spark.createDataFrame([(1, 0, n, 0, v, u) for n, (v, u) in enumerate(zip(x, w, strict=True))], "ens long, k long, n long, i long, x double, w double")
    truth = spark.createDataFrame([(0, 0, 0.5)], "k long, i long, truth double")
    good = {r.stat: r.m for r in st.assess_ensembles(rows([0.0, 1.0, 3.0], [0.25, 0.25, 0.5]), truth).collect()}
    assert good["err"] == pytest.approx(1.25) and good["rh"] == 1.0 and good["spread"] == pytest.approx(np.sqrt((0.25 * 1.75**2 + 0.25 * 0.75**2 + 0.5 * 1.25**2) / (1 - 0.375)))
    still = {r.stat for r in st.assess_ensembles(rows([2.0, 2.0], [0.5, 0.5]), truth).collect()}
    assert still == {"err", "spread", "mad", "crps", "rh"}
    for x, w, said in (([0.0, float("nan")], [0.5, 0.5], "not finite"), ([0.0, 1.0], [0.5, 0.6], "add up")):
        with pytest.raises(Exception, match=said):
            st.assess_ensembles(rows(x, w), truth).collect()

"""Ensembles of many members are worked on by their variables: no products of members."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlake.functions import draws
from twinlake.operators import assimilation as da
from twinlake.operators import ensemble_space as es
from twinlake.operators import noise as no

MANY, SIZE = 6000, 3


@pytest.fixture(scope="module")
def both(spark):
    """One ensemble of many members, of which products would be 36 million rows a variable, and one of fewer members than variables."""
    rng = np.random.default_rng(3)
    x = {1: rng.normal(size=(MANY, SIZE)) @ rng.normal(size=(SIZE, SIZE)), 2: rng.normal(size=(3, 5))}
    rows = [(ens, n, i, float(a[n, i])) for ens, a in x.items() for n in range(a.shape[0]) for i in range(a.shape[1])]
    e = spark.createDataFrame(rows, "ens long, n long, i long, x double").repartition(8).cache()
    return x, e


def back(df, x, seconds=90):
    began = time.time()
    pdf = df.toPandas()
    assert time.time() - began < seconds
    return {ens: pdf[pdf["ens"] == ens].pivot(index="n", columns="i", values="x").to_numpy() for ens in x}


def test_noise_in_the_span_of_many_members(both):
    x, e = both
    got = back(no.add_noise(e, 0.3 + 0.1 * F.col("i"), "Sqrt-Core", 0.5), x)
    for ens, a in x.items():
        q = np.diag(0.3 + 0.1 * np.arange(a.shape[1]))
        proj = np.linalg.pinv(a - a.mean(0)) @ (a - a.mean(0))
        assert np.allclose(np.cov(got[ens].T), np.cov(a.T) + 0.5 * proj @ q @ proj, atol=1e-9) and np.allclose(got[ens].mean(0), a.mean(0))
    total = back(no.add_noise(e, 0.3 + 0.1 * F.col("i"), "Sqrt-Mult-1", 0.5), x)
    for ens, a in x.items():
        q = 0.3 + 0.1 * np.arange(a.shape[1])
        assert np.trace(np.cov(total[ens].T)) == pytest.approx(np.trace(np.cov(a.T)) + 0.5 * q.sum())


def test_spectra_of_many_members(spark, both):
    x, e = both
    truth = spark.createDataFrame([(i, 0.1 * i) for i in range(5)], "i long, truth double")
    began = time.time()
    pdf = da.ensemble_spectra(e, truth, 5, side="members").toPandas()
    assert time.time() - began < 90
    for ens, a in x.items():
        s, v = np.linalg.svd((a - a.mean(0)) / np.sqrt(len(a) - 1), full_matrices=False)[1:]
        many = min(len(a) - 1, len(s))
        own = pdf[pdf["ens"] == ens].sort_values("s")
        err = a.mean(0) - 0.1 * np.arange(a.shape[1])
        assert len(own) == min(len(a) - 1, 5) and np.allclose(own["sval"][:many], s[:many]) and np.allclose(own["sval"][many:], 0)
        assert np.allclose(np.abs(own["umisf"][:many]), np.abs(v @ err)[:many])


def test_square_root_by_the_smaller_side(spark, both):
    x, e = both
    obs = spark.createDataFrame([(j, j, 0.2 * j, 0.5 + 0.1 * j) for j in range(4)], "j long, i long, y double, r double")
    got = back(es.square_root_by_members(e, obs), x)
    for ens, a in x.items():
        seen = [j for j in range(4) if j < a.shape[1]]
        root = np.sqrt([0.5 + 0.1 * j for j in seen])
        mu = a.mean(0)
        want = mu + da.square_root_weights((a - mu)[:, seen] / root, (0.2 * np.array(seen) - mu[seen]) / root)(a - mu)
        assert np.allclose(got[ens], want, atol=1e-9)


def test_exact_perturbations_of_many_members(both):
    x, e = both
    values, errors = [(0, 0.3), (1, -0.2), (9, 5.0)], [0.4, 0.6, 1.0]
    got = back(es.second_order_exact(e, values, errors, draws.gauss(5, F.col("ens"))), x)
    a = x[1]
    p, h, r = np.cov(a.T), np.eye(SIZE)[:2], np.diag(errors[:2])
    k = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
    assert np.allclose(np.cov(got[1].T), (np.eye(SIZE) - k @ h) @ p, atol=1e-8)
    assert np.allclose(got[1].mean(0), a.mean(0) + k @ (np.array([0.3, -0.2]) - a.mean(0)[:2]), atol=1e-8)
    assert got[2].shape == (3, 5) and np.isfinite(got[2]).all()


def test_a_variable_that_some_members_lack(both):
    """Its anomalies are nought where it is not there, as in products of members; no row is made for it."""
    _, e = both
    some = e.where("ens = 1 and n < 200 and not (i = 1 and n % 5 = 0)")
    n = some.count()
    for out in (no.add_noise(some, F.lit(0.3), "Sqrt-Core", 0.5), es.second_order_exact(some, [(0, 0.3)], [0.4], F.lit(1.0))):
        rows = out.toPandas()
        assert len(rows) == n and np.isfinite(rows["x"]).all()

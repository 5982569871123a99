"""Updates by many observations, noise and rotations against plain numpy."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlake.functions import draws
from twinlake.operators import assimilation as da
from twinlake.operators import ensemble_space as es
from twinlake.operators import noise as no

SIZE, MEMBERS = 10, 6


def ensemble(spark, seed=0, members=MEMBERS, size=SIZE):
    x = np.random.default_rng(seed).normal(size=(members, size))
    rows = [(1, n, i, float(x[n, i])) for n in range(members) for i in range(size)]
    return x, spark.createDataFrame(rows, "ens long, n long, i long, x double")


def back(df, members=MEMBERS, size=SIZE):
    out = np.full((members, size), np.nan)
    for r in df.collect():
        out[r.n, r.i] = r.x
    return out


SITES, VALUES, ERRORS = [0, 3, 4, 8], [0.3, -0.2, 0.5, 1.0], [0.4, 0.2, 1.0, 0.3]
OBSERVATIONS = list(zip(SITES, VALUES, strict=True))


def parts(x):
    mu = x.mean(0)
    a = x - mu
    return mu, a, a[:, SITES], np.array(VALUES) - mu[SITES], len(x) - 1, np.diag(ERRORS)


def test_square_root_at_once(spark):
    x, e = ensemble(spark)
    mu, a, y, dy, n1, r = parts(x)
    inv = np.linalg.inv(y @ np.linalg.inv(r) @ y.T + n1 * np.eye(len(x)))
    d, v = np.linalg.eigh(inv * n1)
    want = mu + dy @ np.linalg.inv(r) @ y.T @ inv @ a + v * np.sqrt(d) @ v.T @ a
    assert np.allclose(back(es.updated(e, OBSERVATIONS, ERRORS, "Sqrt")), want, atol=1e-9)
    obs = spark.createDataFrame([(j, i, v, s) for j, (i, v, s) in enumerate(zip(SITES, VALUES, ERRORS, strict=True))], "j long, i long, y double, r double")
    assert np.allclose(back(es.square_root_by_members(e, obs)), want, atol=1e-9)


def test_half_gain_and_perturbed_at_once(spark):
    x, e = ensemble(spark, 1)
    mu, a, y, dy, n1, r = parts(x)
    gain = a.T @ y @ np.linalg.inv(y.T @ y + n1 * r)
    assert np.allclose(back(es.updated(e, OBSERVATIONS, ERRORS, "DEnKF")), x + dy @ gain.T - 0.5 * y @ gain.T, atol=1e-9)
    z = np.sin(np.arange(MEMBERS)[:, None] * 1.7 + np.arange(4))
    z = (z - z.mean(0)) * np.sqrt(ERRORS)
    got = back(es.updated(e, OBSERVATIONS, ERRORS, "PertObs", lambda j: F.sin(F.col("n") * 1.7 + j)))
    assert np.allclose(got, x + (np.array(VALUES) + z - x[:, SITES]) @ gain.T, atol=1e-9)
    assert not np.allclose(got, back(es.updated(e, OBSERVATIONS, ERRORS, "Stoch", lambda j: F.sin(F.col("n") * 1.7 + j))))


@pytest.mark.parametrize("flavour", ["Serial", "Serial DEnKF", "Stoch", "Var1"])
def test_in_turn(spark, flavour):
    x, e = ensemble(spark, 2)
    want = x.copy()
    for j, (i, value) in enumerate(OBSERVATIONS):
        mu, r = want.mean(0), ERRORS[j]
        a = want - mu
        v = a[:, i].var(ddof=1)
        slope, gain = a.T @ a[:, i] / (len(x) - 1) / v, v / (v + r)
        if flavour in ("Serial", "Serial DEnKF"):
            part = 0.5 if "DEnKF" in flavour else 1 / (1 + np.sqrt(r / (v + r)))
            move = gain * (value - mu[i]) - part * gain * a[:, i]
        else:
            z = np.sin(np.arange(MEMBERS) * 1.7 + j)
            z = z - z.mean()
            z = z * np.sqrt(MEMBERS / (z @ z)) if flavour == "Var1" else z
            move = gain * (value + np.sqrt(r) * z - want[:, i])
        want = want + np.outer(move, slope)
    got = back(es.updated(e, OBSERVATIONS, ERRORS, flavour, lambda j: F.sin(F.col("n") * 1.7 + j)))
    assert np.allclose(got, want, atol=1e-9)


def test_forty_observations_plan_in_seconds(spark):
    _, e = ensemble(spark, 3, size=40)
    began = time.perf_counter()
    out = da.serial_updates(e, [(i, 0.1) for i in range(40)], 0.5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert time.perf_counter() - began < 5 and plan.count("LogicalRDD") <= 16
    x = back(out, size=40)
    assert np.isfinite(x).all() and x.var(0).sum() < _[:, :40].var(0).sum()


def test_edges_of_updates(spark):
    x, e = ensemble(spark, 4)
    assert np.array_equal(back(es.updated(e, [], 0.5, "Sqrt")), x)
    alone = e.where("n = 0")
    assert np.array_equal(back(es.updated(alone, OBSERVATIONS, 0.5, "Serial"), 1), x[:1])
    assert np.allclose(back(es.updated(e, [(99, 1.0)], 0.5, "Sqrt")), x)
    with pytest.raises(ValueError, match="draws"):
        es.updated(e, OBSERVATIONS, 0.5, "PertObs")
    with pytest.raises(ValueError, match="flavour"):
        es.updated(e, OBSERVATIONS, 0.5, "none such")
    assert es.updated(e.where("false"), OBSERVATIONS, 0.5, "Sqrt").collect() == []


def test_nonlinear_transform(spark):
    x, e = ensemble(spark, 5)
    obs = spark.createDataFrame([(j, i, v) for j, (i, v) in enumerate(OBSERVATIONS)], "j long, i long, y double")
    for laplace in (False, True):
        got = back(da.local_transform(e, obs, 0.4, 1.0, SIZE, kind="Step", weights=lambda y, dy, q=laplace: da.second_order_weights(y, dy, 1.5, q)))
        want, mu, a = x.copy(), x.mean(0), x - x.mean(0)
        for b in range(0, SIZE, 2):
            dist = [np.mean([min(abs(i - s), SIZE - abs(i - s)) for i in (b, b + 1)]) for s in SITES]
            near = np.array(dist) <= 1
            if near.any():
                d = (np.array(VALUES) - x[:, SITES])[:, near] / np.sqrt(0.4) / 1.5
                w = np.exp(-np.sqrt(2) * np.abs(d).sum(1) if laplace else -0.5 * (d**2).sum(1))
                w /= w.sum()
                s, v = np.linalg.eigh(np.diag(w) - np.outer(w, w))
                want[:, b : b + 2] = mu[b : b + 2] + w @ a[:, b : b + 2] + np.sqrt(MEMBERS) * (v * np.sqrt(np.maximum(s, 0))) @ v.T @ a[:, b : b + 2]
        assert np.allclose(got, want, atol=1e-9)


def test_square_root_weights_by_either_side():
    rng = np.random.default_rng(6)
    for ny in (2, 5, 9):
        y, dy, a = rng.normal(size=(5, ny)), rng.normal(size=ny), rng.normal(size=(5, 3))
        y, a = y - y.mean(0), a - a.mean(0)
        inv = np.linalg.inv(y @ y.T + 4 * np.eye(5))
        d, v = np.linalg.eigh(inv * 4)
        assert np.allclose(da.square_root_weights(y, dy)(a), dy @ y.T @ inv @ a + v * np.sqrt(d) @ v.T @ a)


@pytest.mark.parametrize(("members", "size"), [(4, 9), (12, 5)])
def test_noise_covariances(spark, members, size):
    x, e = ensemble(spark, 7, members, size)
    q, dt = 0.3 + 0.1 * np.arange(size), 0.5
    col = 0.3 + 0.1 * F.col("i")
    a = x - x.mean(0)
    p, proj = a.T @ a / (members - 1), np.linalg.pinv(a) @ a
    cov = lambda y: np.cov(y.T)
    core = back(no.add_noise(e, col, "Sqrt-Core", dt), members, size)
    assert np.allclose(cov(core), p + dt * proj @ np.diag(q) @ proj, atol=1e-9) and np.allclose(core.mean(0), x.mean(0))
    full = back(no.add_noise(e, col, "Sqrt-Mult-1", dt), members, size)
    assert np.trace(cov(full)) == pytest.approx(np.trace(p) + dt * q.sum()) and np.allclose(full - full.mean(0), (core - core.mean(0)) * np.sqrt(np.trace(cov(full)) / np.trace(cov(core))))
    draw = F.sin(F.col("n") * 1.3 + F.col("i") * 0.7)
    z = np.sqrt(q) * np.sin(np.arange(members)[:, None] * 1.3 + np.arange(size) * 0.7)
    assert np.allclose(back(no.add_noise(e, col, "Sqrt-Add-Z", dt, draw), members, size), core + np.sqrt(dt) * (z - z @ proj), atol=1e-9)
    assert np.allclose(back(no.add_noise(e, col, "Stoch", dt, draw), members, size), x + np.sqrt(dt) * z)
    assert np.allclose(np.diag(cov(back(no.add_noise(e, col, "Mult-M", dt), members, size))), np.diag(p) + dt * q)
    assert np.trace(cov(back(no.add_noise(e, col, "Mult-1", dt), members, size))) == pytest.approx(np.trace(p) + dt * q.sum())
    assert np.array_equal(back(no.add_noise(e, col, "none"), members, size), x)
    with pytest.raises(ValueError, match="treatment"):
        no.add_noise(e, col, "other")


def test_rotation_keeps_mean_and_covariance_and_moves_members(spark):
    x, e = ensemble(spark, 8)
    got = back(no.rotated(e, [draws.gauss(3, F.col("ens"), F.col("n"), F.lit(k)) for k in range(MEMBERS - 1)]))
    assert np.allclose(got.mean(0), x.mean(0)) and np.allclose(np.cov(got.T), np.cov(x.T)) and np.abs(got - x).max() > 0.1
    assert np.allclose(got, back(no.rotated(e.repartition(5), [draws.gauss(3, F.col("ens"), F.col("n"), F.lit(k)) for k in range(MEMBERS - 1)])))


def test_kinds_of_draws_are_independent(spark):
    n = [F.col("id")]
    kinds = {
        "gauss": draws.gauss(1, *n), "uniform": draws.uniform(1, *n), "laplace": draws.laplace(1, n, *n), "parallel": draws.laplace_parallel(1, *n),
        "student": draws.student(1, 9, n, *n), "cube": draws.cube(1, *n), "exponential": draws.exponential(1, *n), "next": draws.gauss(2, *n), "laplace 100": draws.laplace(100, n, *n), "parallel 200": draws.laplace_parallel(200, *n),
    }
    x = np.array(spark.range(20_000).select(*[c.alias(k) for k, c in kinds.items()]).collect())
    for y in (x, np.abs(x - x.mean(0))):
        c = np.corrcoef(y.T) - np.eye(len(kinds))
        assert np.abs(c).max() < 0.04


def test_jitter_of_states(spark):
    """Repeats alone move, and over many of them with the covariance of the colouring."""
    rng = np.random.default_rng(9)
    c = rng.normal(size=(5, 3))
    source = spark.createDataFrame([(1, m, i, float(c[m, i])) for m in range(5) for i in range(3)], "ens long, m long, i long, c double")
    rows = spark.range(4000).select(F.lit(1).cast("long").alias("ens"), F.col("id").alias("n"), F.lit(0).cast("long").alias("copy"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("i")).withColumn("x", F.lit(1.0)).withColumn("again", F.col("n") % 2 == 0)
    out = no.jittered_rows(rows, source, lambda m: draws.gauss(5, F.col("ens"), F.col("n"), F.col("copy"), m)).toPandas()
    moved = out[out["n"] % 2 == 0].pivot(index="n", columns="i", values="x").to_numpy() - 1
    assert (out[out["n"] % 2 == 1]["x"] == 1).all() and out[out["n"] % 2 == 1]["chi2"].isna().all()
    assert np.allclose(np.cov(moved.T), c.T @ c, atol=0.15 * np.abs(c.T @ c).max()) and out["chi2"].mean() == pytest.approx(3, rel=0.1)


def test_tabulated_draws(spark):
    u = spark.range(2001).select("id", (F.col("id") / 2000).alias("u"))
    t = draws.integrated(spark, lambda x: F.when((x >= 0) & (x <= 1), 2 * x).otherwise(0.0), -1.0, 2.0, 3000)
    got = {r.id: r.x for r in draws.by_table(u, t, F.col("u"), cells=7).collect()}
    assert len(got) == 2001 and max(abs(got[k] - np.sqrt(k / 2000)) for k in range(1, 2001)) < 2e-3


def test_perturbations_exact_to_second_order(spark):
    """More members than variables: mean and covariance are the Kalman filter's; fewer: those of the ensemble less its least direction."""
    for members, size in ((14, 10), (6, 10)):
        x, e = ensemble(spark, 10, members, size)
        got = back(es.second_order_exact(e, OBSERVATIONS, ERRORS, draws.gauss(5, F.col("ens"))), members, size)
        a = x - x.mean(0)
        if members < size:
            u, s, v = np.linalg.svd(a, full_matrices=False)
            s[members - 2 :] = 0
            a = u * s @ v
        p, h, r = a.T @ a / (members - 1), np.eye(size)[SITES], np.diag(ERRORS)
        k = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
        assert np.allclose(np.cov(got.T), (np.eye(size) - k @ h) @ p, atol=1e-8)
        assert np.allclose(got.mean(0), x.mean(0) + k @ (np.array(VALUES) - x.mean(0)[SITES]), atol=1e-8)

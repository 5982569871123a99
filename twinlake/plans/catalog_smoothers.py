"""Registered queries of filters and smoothers with matrices, of the backward ensemble smoother and of the nonlinear transform."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from twinlake.operators import assimilation as da
from twinlake.operators import smoothers as sm
from twinlake.plans.catalog import ENS, EVENTS, _ens, _events, rounded
from twinlake.plans.matrix_kalman import Model, kalman_matrix
from twinlake.plans.registry import query

# --- filter and smoother with a covariance matrix ----------------------------------------------------------

#: Level and slope; every fifth step has no observation.
LEVEL = Model(np.array([[1.0, 1.0], [0.0, 0.9]]), np.diag([4.0, 0.25]), np.array([[1.0, 0.0]]), np.array([[50.0]]), np.array([50.0, 0.0]), np.diag([400.0, 4.0]))
_FILTER = f"""{EVENTS}, kf(sys, k, f1, f2, g11, g12, g22, m1, m2, p11, p12, p22) AS (
SELECT DISTINCT sys, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 50.0::DOUBLE, 0.0::DOUBLE, 400.0::DOUBLE, 0.0::DOUBLE, 4.0::DOUBLE FROM s UNION ALL
SELECT sys, k, f1, f2, g11, g12, g22, f1 + w * g11 * (y - f1), f2 + w * g12 * (y - f1), g11 - w * g11 * g11, g12 - w * g11 * g12, g22 - w * g12 * g12 FROM (
  SELECT s.sys, s.k, y, m1 + m2 AS f1, 0.9 * m2 AS f2, p11 + 2 * p12 + p22 + 4 AS g11, 0.9 * (p12 + p22) AS g12, 0.81 * p22 + 0.25 AS g22, CASE WHEN s.k % 5 = 0 THEN 0 ELSE 1 / (p11 + 2 * p12 + p22 + 54) END AS w
  FROM kf JOIN s ON s.sys = kf.sys AND s.k = kf.k + 1)),
fl AS MATERIALIZED (SELECT * FROM kf WHERE k > 0)"""
_BACK = """, en AS MATERIALIZED (SELECT sys, max(k) AS k FROM fl GROUP BY sys), rs(sys, k, s1, s2, v11, v12, v22) AS (
SELECT fl.sys, fl.k, m1, m2, p11, p12, p22 FROM fl JOIN en ON en.sys = fl.sys AND en.k = fl.k UNION ALL
SELECT sys, k, m1 + j11 * d1 + j12 * d2, m2 + j21 * d1 + j22 * d2, p11 + j11 * j11 * e11 + 2 * j11 * j12 * e12 + j12 * j12 * e22,
  p12 + j11 * j21 * e11 + (j11 * j22 + j12 * j21) * e12 + j12 * j22 * e22, p22 + j21 * j21 * e11 + 2 * j21 * j22 * e12 + j22 * j22 * e22 FROM (
  SELECT a.sys, a.k, a.m1, a.m2, a.p11, a.p12, a.p22, s1 - b.f1 AS d1, s2 - b.f2 AS d2, v11 - b.g11 AS e11, v12 - b.g12 AS e12, v22 - b.g22 AS e22,
    ((a.p11 + a.p12) * b.g22 - 0.9 * a.p12 * b.g12) / (b.g11 * b.g22 - b.g12 * b.g12) AS j11, (-(a.p11 + a.p12) * b.g12 + 0.9 * a.p12 * b.g11) / (b.g11 * b.g22 - b.g12 * b.g12) AS j12,
    ((a.p12 + a.p22) * b.g22 - 0.9 * a.p22 * b.g12) / (b.g11 * b.g22 - b.g12 * b.g12) AS j21, (-(a.p12 + a.p22) * b.g12 + 0.9 * a.p22 * b.g11) / (b.g11 * b.g22 - b.g12 * b.g12) AS j22
  FROM rs JOIN fl b ON b.sys = rs.sys AND b.k = rs.k JOIN fl a ON a.sys = rs.sys AND a.k = rs.k - 1))"""


def _level(spark, d):
    s = _events(spark, d)
    return s.select("sys", "k", F.when(F.col("k") % 5 != 0, F.array("y")).alias("y"))


@query("kf_matrix", f"WITH RECURSIVE {_FILTER} SELECT sys, k, round(f1, 6) + 0.0 AS forecast, round(m1, 6) + 0.0 AS level, round(m2, 6) + 0.0 AS slope, round(p11, 6) + 0.0 AS v11, round(p12, 6) + 0.0 AS v12, round(p22, 6) + 0.0 AS v22 FROM fl")
def kf_matrix(spark, d):
    """The Kalman filter of level and slope of each series, with gaps in the observations."""
    out = kalman_matrix(_level(spark, d), LEVEL, size=512)
    out = out.select("sys", "k", F.get("forecast", 0).alias("forecast"), F.get("mean", 0).alias("level"), F.get("mean", 1).alias("slope"), F.get("cov", 0).alias("v11"), F.get("cov", 1).alias("v12"), F.get("cov", 3).alias("v22"))
    return rounded(out, "forecast", "level", "slope", "v11", "v12", "v22")


@query("kf_matrix_smoother", f"WITH RECURSIVE {_FILTER}{_BACK} SELECT sys, k, round(s1, 6) + 0.0 AS level, round(s2, 6) + 0.0 AS slope, round(v11, 6) + 0.0 AS v11, round(v12, 6) + 0.0 AS v12, round(v22, 6) + 0.0 AS v22 FROM rs")
def kf_matrix_smoother(spark, d):
    """The backward pass over the same series."""
    out = kalman_matrix(_level(spark, d), LEVEL, smooth=True, size=512)
    out = out.select("sys", "k", F.get("smoothed", 0).alias("level"), F.get("smoothed", 1).alias("slope"), F.get("smoothed_cov", 0).alias("v11"), F.get("smoothed_cov", 1).alias("v12"), F.get("smoothed_cov", 3).alias("v22"))
    return rounded(out, "level", "slope", "v11", "v12", "v22")


# --- backward ensemble smoother --------------------------------------------------------------------------

_RTS = f"""WITH RECURSIVE {ENS}, w AS (SELECT ens, n, i // 2 AS k, max(x) FILTER (i % 2 = 0) AS x0, max(x) FILTER (i % 2 = 1) AS x1 FROM ens GROUP BY ens, n, i // 2),
m AS MATERIALIZED (SELECT ens, k, avg(x0) AS m0, avg(x1) AS m1, var_samp(x0) AS v, covar_samp(x0, x1) AS c, count(*) AS size FROM w GROUP BY ens, k),
a AS MATERIALIZED (SELECT ens, n, k, x0 AS f0, x1 AS f1, x0 + CASE WHEN k % 4 = 3 THEN v / (v + 0.02) * (0.05 - m0 - 0.5 * (x0 - m0)) ELSE 0 END AS a0, x1 + CASE WHEN k % 4 = 3 THEN c / (v + 0.02) * (0.05 - m0 - 0.5 * (x0 - m0)) ELSE 0 END AS a1 FROM w JOIN m USING (ens, k)),
g AS (SELECT p.ens, p.k, var_samp(q.f0) AS g00, covar_samp(q.f0, q.f1) AS g01, var_samp(q.f1) AS g11, covar_samp(q.f0, p.a0) AS c00, covar_samp(q.f0, p.a1) AS c01, covar_samp(q.f1, p.a0) AS c10, covar_samp(q.f1, p.a1) AS c11
  FROM a p JOIN a q ON q.ens = p.ens AND q.n = p.n AND q.k = p.k + 1 GROUP BY p.ens, p.k),
j AS MATERIALIZED (SELECT ens, k, 0.95 * (g11 * c00 - g01 * c10) / (g00 * g11 - g01 * g01) AS j00, 0.95 * (g11 * c01 - g01 * c11) / (g00 * g11 - g01 * g01) AS j01,
  0.95 * (g00 * c10 - g01 * c00) / (g00 * g11 - g01 * g01) AS j10, 0.95 * (g00 * c11 - g01 * c01) / (g00 * g11 - g01 * g01) AS j11 FROM g),
r(ens, n, k, s0, s1, f0, f1) AS (SELECT ens, n, k, a0, a1, f0, f1 FROM a WHERE k = 31 UNION ALL
  SELECT a.ens, a.n, a.k, a0 + (s0 - r.f0) * j00 + (s1 - r.f1) * j10, a1 + (s0 - r.f0) * j01 + (s1 - r.f1) * j11, a.f0, a.f1 FROM r JOIN a ON a.ens = r.ens AND a.n = r.n AND a.k = r.k - 1 JOIN j ON j.ens = a.ens AND j.k = a.k)
SELECT ens, n, k, 0::BIGINT AS i, round(s0, 6) + 0.0 AS x FROM r UNION ALL SELECT ens, n, k, 1, round(s1, 6) + 0.0 FROM r"""


@query("ensemble_rts", _RTS)
def ensemble_rts(spark, d):
    """Embeddings as 32 times of two variables, analysed at every fourth, and smoothed from the end."""
    f = sm.lag_states(_ens(spark, d), 2)
    return rounded(sm.ensemble_rts(f, sm.analysed(f, 4, 0.05, 0.02), 2, relax=0.95, size=8, chunk=64), "x")


# --- the nonlinear transform -----------------------------------------------------------------------------

_ONE = f"""WITH {ENS}, m AS (SELECT ens, i, avg(x) AS mu, count(*) AS size FROM ens GROUP BY ens, i), a AS MATERIALIZED (SELECT ens, n, i, x - mu AS a, mu, size FROM ens JOIN m USING (ens, i)),
lw AS (SELECT ens, n, -0.5 * (0.1 - mu - a) ** 2 / 0.02 AS lw FROM a WHERE i = 8), ex AS (SELECT ens, n, exp(lw - max(lw) OVER (PARTITION BY ens)) AS e FROM lw), w AS MATERIALIZED (SELECT ens, n, e / sum(e) OVER (PARTITION BY ens) AS w FROM ex),
s AS (SELECT a.ens, a.i, a.mu, any_value(size) AS size, sum(w * a.a) AS m1, sum(w * a.a * a.a) AS m2, var_samp(a.a) AS v FROM a JOIN w USING (ens, n) GROUP BY a.ens, a.i, a.mu)"""


@query("lnetf_one_obs", f"{_ONE} SELECT ens, i, round(CASE WHEN i BETWEEN 8 AND 9 THEN mu + m1 ELSE mu END, 6) + 0.0 AS mean, round(CASE WHEN i BETWEEN 8 AND 9 THEN size * (m2 - m1 * m1) / (size - 1) ELSE v END, 6) + 0.0 AS var FROM s")
def lnetf_one_obs(spark, d):
    """One observation, felt by its own batch alone: the batch's mean is the weighted one, its variance the weighted one's."""
    e = _ens(spark, d)
    obs = e.where("i = 8").select(F.lit(0).cast("long").alias("j"), "i", F.lit(0.1).alias("y")).distinct()
    x = da.local_transform(e, obs, 0.02, 0.6, 64, batch=2, kind="Step", weights=da.second_order_weights)
    return rounded(x.groupBy("ens", "i").agg(F.avg("x").alias("mean"), F.var_samp("x").alias("var")), "mean", "var")

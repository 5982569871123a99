"""Registered queries of model noise, rotations, jitter in several dimensions and tabulated draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlake.functions import draws
from twinlake.functions import ensemble as en
from twinlake.operators import noise as no
from twinlake.plans.catalog import ENS, _ens, read, rounded
from twinlake.plans.registry import query

# --- noise -----------------------------------------------------------------------------------------------

#: Variance by index: a hundredth, half as much again for odd ones.
Q = lambda: F.when(F.col("i") % 2 == 0, 0.01).otherwise(0.015)
_Q = "CASE WHEN i % 2 = 0 THEN 0.01 ELSE 0.015 END"
_WAVE = lambda: F.sin(F.col("n") * 1.3 + F.col("i") * 0.7)


@query("noise_stoch", f"WITH {ENS} SELECT ens, n, i, round(x + sqrt(0.5 * {_Q}) * sin(n * 1.3 + i * 0.7), 6) + 0.0 AS x FROM ens")
def noise_stoch(spark, d):
    """A draw a row; here a wave, so that SQL has the same."""
    return rounded(no.add_noise(_ens(spark, d), Q(), "Stoch", 0.5, _WAVE()), "x")


def _slots(spark, d):
    """Ensembles of two variables: each pair of an embedding's by itself."""
    return _ens(spark, d).select((F.col("ens") * 32 + F.floor(F.col("i") / 2)).cast("long").alias("ens"), "n", (F.col("i") % 2).alias("i"), "x")


_SLOTS = f"{ENS}, sl AS (SELECT ens * 32 + i // 2 AS ens, n, i % 2 AS i, x FROM ens), sw AS (SELECT ens, n, max(x) FILTER (i = 0) AS x0, max(x) FILTER (i = 1) AS x1 FROM sl GROUP BY ens, n)"


@query("noise_sqrt_core", f"WITH {_SLOTS} SELECT ens, u.i, u.j, round(u.c, 6) + 0.0 AS cov FROM (SELECT ens, unnest([{{'i': 0::BIGINT, 'j': 0::BIGINT, 'c': var_samp(x0) + 0.005}}, {{'i': 0, 'j': 1, 'c': covar_samp(x0, x1)}}, {{'i': 1, 'j': 1, 'c': var_samp(x1) + 0.0075}}]) AS u FROM sw GROUP BY ens)")
def noise_sqrt_core(spark, d):
    """The ensemble that spans its state gets the whole noise covariance by a symmetric transform, without a draw."""
    x = no.add_noise(_slots(spark, d), Q(), "Sqrt-Core", 0.5)
    return rounded(en.covariance(x, 2).select("ens", "i", "j", "cov"), "cov")


@query("noise_sqrt_total", f"WITH {ENS}, v AS (SELECT ens, i, avg(x) AS mu, var_samp(x) AS v FROM ens GROUP BY ens, i) SELECT ens, round(avg(mu), 6) + 0.0 AS mu, round(sum(v + 0.5 * {_Q}), 6) AS total FROM v GROUP BY ens")
def noise_sqrt_total(spark, d):
    """The span's part of the noise, then stretched to the total variance."""
    x = no.add_noise(_ens(spark, d), Q(), "Sqrt-Mult-1", 0.5)
    v = x.groupBy("ens", "i").agg(F.avg("x").alias("mu"), F.var_samp("x").alias("v"))
    return rounded(v.groupBy("ens").agg(F.avg("mu").alias("mu"), F.sum("v").alias("total")), "mu", "total")


#: Neighbouring rows are an ensemble of two: its span is one direction, so SQL has closed forms.
_PAIRS = f"""ens AS (SELECT vec_id // 2 AS ens, vec_id AS n, i::BIGINT - 1 AS i, x::DOUBLE AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)),
m AS (SELECT ens, i, avg(x) AS mu, count(*) AS size FROM ens GROUP BY ens, i), a AS MATERIALIZED (SELECT ens, n, i, mu, x - mu AS a, size, {_Q} AS q, sqrt({_Q}) * sin(n * 1.3 + i * 0.7) AS z FROM ens JOIN m USING (ens, i) WHERE size = 2),
f AS MATERIALIZED (SELECT ens, n, sum(a * a) AS aa, sum(q * a * a) AS qa, sum(z * a) AS za FROM a GROUP BY ens, n)"""


@query("noise_sqrt_add_z", f"WITH {_PAIRS} SELECT ens, n, i, round(mu + a * sqrt(1 + 0.5 * qa / aa / (2 * aa)) + sqrt(0.5) * (z - a * za / aa), 6) + 0.0 AS x FROM a JOIN f USING (ens, n)")
def noise_sqrt_add_z(spark, d):
    """The span's part by a transform, and draws for what lies outside the span."""
    e = read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("ens"), F.col("vec_id").alias("n"), F.posexplode("embedding").alias("i", "x"))
    e = e.select("ens", "n", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))
    whole = e.groupBy("ens").agg(F.count_distinct("n").alias("size")).where("size = 2")
    return rounded(no.add_noise(e.join(whole.select("ens"), "ens"), Q(), "Sqrt-Add-Z", 0.5, _WAVE()), "x")


# --- rotations -------------------------------------------------------------------------------------------


def _mirror(k: int, src: str) -> str:
    return f"""v{k} AS MATERIALIZED (SELECT ens, n, s - avg(s) OVER (PARTITION BY ens) AS v FROM (SELECT DISTINCT ens, n, sin(n * 1.9 + {k}) AS s FROM ens)), l{k} AS (SELECT ens, sum(v * v) AS vv FROM v{k} GROUP BY ens),
c{k} AS MATERIALIZED (SELECT ens, i, 2 * sum(v * a) / any_value(vv) AS c FROM {src} JOIN v{k} USING (ens, n) JOIN l{k} USING (ens) GROUP BY ens, i), r{k} AS MATERIALIZED (SELECT ens, n, i, a - c * v AS a FROM {src} JOIN v{k} USING (ens, n) JOIN c{k} USING (ens, i))"""


@query("ens_rotated", f"WITH {ENS}, m AS (SELECT ens, i, avg(x) AS mu FROM ens GROUP BY ens, i), a AS MATERIALIZED (SELECT ens, n, i, x - mu AS a FROM ens JOIN m USING (ens, i)), {_mirror(3, 'a')}, {_mirror(2, 'r3')}, {_mirror(1, 'r2')} SELECT ens, n, i, round(mu + a, 6) + 0.0 AS x FROM r1 JOIN m USING (ens, i)")
def ens_rotated(spark, d):
    """Three mirrors of the ensemble in its own space; their draws are waves, so that SQL has the same."""
    return rounded(no.rotated(_ens(spark, d), [F.sin(F.col("n") * 1.9 + k) for k in (1, 2, 3)]), "x")


@query("ens_rotated_covariance", f"WITH {ENS}, m AS (SELECT ens, i, avg(x) AS mu FROM ens GROUP BY ens, i), a AS MATERIALIZED (SELECT ens, n, i, x - mu AS a FROM ens JOIN m USING (ens, i)), c AS (SELECT p.ens, p.i, q.i AS j, sum(p.a * q.a) / (count(*) - 1) AS cov FROM a p JOIN a q ON q.ens = p.ens AND q.n = p.n AND p.i <= q.i GROUP BY p.ens, p.i, q.i) SELECT ens, i, j, round(cov, 6) + 0.0 AS cov, round(mu, 6) + 0.0 AS mu FROM c JOIN m USING (ens, i)")
def ens_rotated_covariance(spark, d):
    """By keyed draws: mean and covariance stay as they were."""
    x = no.rotated(_ens(spark, d), [draws.gauss(11, F.col("ens"), F.col("n"), F.lit(k)) for k in range(8)])
    m = x.groupBy("ens", "i").agg(F.avg("x").alias("mu"))
    return rounded(en.covariance(x, 64).select("ens", "i", "j", "cov").join(m, ["ens", "i"]), "cov", "mu")


# --- jitter ----------------------------------------------------------------------------------------------

_W = "w AS (SELECT label::BIGINT AS ens, vec_id::BIGINT AS n, (1 + vec_id % 3)::DOUBLE / sum(1 + vec_id % 3) OVER (PARTITION BY label) AS w FROM embeddings)"
_JITTER = f"""WITH {ENS}, {_W}, c0 AS (SELECT ens, i, sum(w * x) AS mu, 1 / (1 - sum(w * w)) AS ub FROM ens JOIN w USING (ens, n) GROUP BY ens, i), c AS MATERIALIZED (SELECT ens, n AS m, i, 0.5 * sqrt(ub * w) * (x - mu) AS c FROM ens JOIN w USING (ens, n) JOIN c0 USING (ens, i)),
dr AS (SELECT ens, n, copy FROM (SELECT DISTINCT ens, n FROM ens), range(0, 3) t(copy) WHERE copy <= n % 3), dd AS MATERIALIZED (SELECT dr.ens, dr.n, copy, w.n AS m, sin(w.n * 1.3 + dr.n * 0.7 + copy) AS d FROM dr JOIN w ON w.ens = dr.ens WHERE copy > 0),
mv AS (SELECT dd.ens, dd.n, copy, c.i, sum(d * c) AS mv FROM dd JOIN c ON c.ens = dd.ens AND c.m = dd.m GROUP BY dd.ens, dd.n, copy, c.i), ch AS (SELECT ens, n, copy, sum(d * d) * least(1.0, 64.0 / count(*)) AS chi2 FROM dd GROUP BY ens, n, copy)
SELECT dr.ens, dr.n, dr.copy, e.i, round(e.x + coalesce(mv, 0), 6) + 0.0 AS x, round(chi2, 6) AS chi2 FROM dr JOIN ens e ON e.ens = dr.ens AND e.n = dr.n LEFT JOIN mv ON mv.ens = dr.ens AND mv.n = dr.n AND mv.copy = dr.copy AND mv.i = e.i LEFT JOIN ch ON ch.ens = dr.ens AND ch.n = dr.n AND ch.copy = dr.copy"""


@query("pf_jitter_states", _JITTER)
def pf_jitter_states(spark, d):
    """Copies of whole states: repeats move by a coloured draw with the weighted covariance; the draws are waves."""
    e = en.normalised(_ens(spark, d), (1 + F.col("n") % 3).cast("double"))
    c = e.join(en.centre(e), ["ens", "i"]).select("ens", F.col("n").alias("m"), "i", (0.5 * F.sqrt(F.col("ub") * F.col("w")) * (F.col("x") - F.col("mu"))).alias("c"))
    drawn = e.select("ens", "n", "i", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") % 3)).alias("copy")).withColumn("again", F.col("copy") > 0)
    rows = drawn.select("ens", "n", "copy", "i", "x", "again")
    return rounded(no.jittered_rows(rows, c, lambda m: F.sin(m * 1.3 + F.col("n") * 0.7 + F.col("copy"))), "x", "chi2")


# --- draws by a tabulated distribution -------------------------------------------------------------------

_U = "part_u AS (SELECT p_partkey AS n, (p_partkey * 0.6180339887498949::DOUBLE) % 1 AS u FROM part)"


@query("rv_tabulated", f"WITH {_U}, t AS (SELECT -5 + k * 0.01 AS x, 1 / (1 + exp(-2 * (-5 + k * 0.01))) AS u FROM range(0, 1001) r(k)), s AS (SELECT u AS lo, x, lead(u) OVER (ORDER BY x) AS hi, lead(x) OVER (ORDER BY x) AS x2 FROM t), p AS (SELECT n, least(greatest(u, (SELECT min(u) FROM t)), (SELECT max(u) FROM t) - 1e-15) AS u FROM part_u) SELECT n, round(x + (u - lo) / (hi - lo) * (x2 - x), 6) + 0.0 AS x FROM p ASOF JOIN s ON u >= lo")
def rv_tabulated(spark, d):
    """Draws by the inverse of a distribution function that is known at 1,001 places."""
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("n"), (F.col("p_partkey") * 0.6180339887498949 % 1).alias("u"))
    t = draws.tabulated(spark, lambda x: 1 / (1 + F.exp(-2 * x)), -5.0, 5.0)
    return rounded(draws.by_table(rows, t, F.col("u")).select("n", "x"), "x")


@query("rv_density", f"WITH {_U}, t AS (SELECT k, -4 + k * 0.008 AS x, exp(-0.5 * (-4 + k * 0.008) ** 2) AS p FROM range(0, 1001) r(k)), a AS (SELECT k, x, (p + lead(p) OVER (ORDER BY k)) * 0.004 AS a FROM t), b AS (SELECT k, x, coalesce(sum(a) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM a), c AS (SELECT x, u / max(u) OVER () AS u FROM b), s AS (SELECT u AS lo, x, lead(u) OVER (ORDER BY x) AS hi, lead(x) OVER (ORDER BY x) AS x2 FROM c) SELECT n, round(x + (u - lo) / (hi - lo) * (x2 - x), 6) + 0.0 AS x FROM part_u ASOF JOIN s ON u >= lo")
def rv_density(spark, d):
    """Draws from a density, whose integral is tabulated first."""
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("n"), (F.col("p_partkey") * 0.6180339887498949 % 1).alias("u"))
    t = draws.integrated(spark, lambda x: F.exp(-0.5 * x * x), -4.0, 4.0)
    return rounded(draws.by_table(rows, t, F.col("u")).select("n", "x"), "x")


# --- perturbations that are exact to second order --------------------------------------------------------


@query("enkf_exact_perturbations", f"WITH {_SLOTS}, c AS (SELECT ens, avg(x0) AS m0, avg(x1) AS m1, var_samp(x0) AS p00, covar_samp(x0, x1) AS p01, var_samp(x1) AS p11 FROM sw GROUP BY ens), o AS (SELECT ens, m0 + p00 / (p00 + 0.02) * (0.05 - m0) AS m0, m1 + p01 / (p00 + 0.02) * (0.05 - m0) AS m1, p00 - p00 * p00 / (p00 + 0.02) AS p00, p01 - p00 * p01 / (p00 + 0.02) AS p01, p11 - p01 * p01 / (p00 + 0.02) AS p11 FROM c), q AS (SELECT ens, m0 + p01 / (p11 + 0.03) * (-0.1 - m1) AS m0, m1 + p11 / (p11 + 0.03) * (-0.1 - m1) AS m1, p00 - p01 * p01 / (p11 + 0.03) AS p00, p01 - p01 * p11 / (p11 + 0.03) AS p01, p11 - p11 * p11 / (p11 + 0.03) AS p11 FROM o) SELECT ens, round(m0, 6) + 0.0 AS m0, round(m1, 6) + 0.0 AS m1, round(p00, 6) + 0.0 AS p00, round(p01, 6) + 0.0 AS p01, round(p11, 6) + 0.0 AS p11 FROM q")
def enkf_exact_perturbations(spark, d):
    """Two observations in turn with perturbations by keyed draws: means and covariances are the Kalman filter's."""
    from twinlake.operators.ensemble_space import second_order_exact

    x = second_order_exact(_slots(spark, d), [(0, 0.05), (1, -0.1)], [0.02, 0.03], draws.gauss(21, F.col("ens")))
    w = x.groupBy("ens", "n").agg(F.max(F.when(F.col("i") == 0, F.col("x"))).alias("x0"), F.max(F.when(F.col("i") == 1, F.col("x"))).alias("x1"))
    c = w.groupBy("ens").agg(F.avg("x0").alias("m0"), F.avg("x1").alias("m1"), F.var_samp("x0").alias("p00"), F.covar_samp("x0", "x1").alias("p01"), F.var_samp("x1").alias("p11"))
    return rounded(c, "m0", "m1", "p00", "p01", "p11")

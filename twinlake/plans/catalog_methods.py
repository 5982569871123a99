"""More registered queries: observation operators, ensemble updates, particles, draws, runs, series and tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from twinlake.functions import draws
from twinlake.functions import ensemble as en
from twinlake.functions import observation as ob
from twinlake.functions import rounding as ro
from twinlake.functions import series as se
from twinlake.operators import assimilation as da
from twinlake.operators import experiments as xp
from twinlake.operators import localization as lo
from twinlake.operators import particle as pa
from twinlake.plans import filters, settings
from twinlake.plans.catalog import _ACOV, _AR1, _COV, _GRID, _MEAN, _PART, _XPS, ENS, EVENTS, MOMENTS, TRUTH, UNIFORM, WEIGHTED, _ens, _events, _grid, _particles, _shared, _truth, _weighted, _xps, r6, rounded
from twinlake.plans.registry import query
from twinlake.sources import runs
from twinlake.sources.tables import read

# --- observation -----------------------------------------------------------------------------------------


@query("obs_sites", "SELECT j::BIGINT AS j, floor(j * 64 / 10.0 + 1e-9)::BIGINT AS i FROM range(0, 10) t(j)")
def obs_sites(spark, d):
    return ob.even_sites(spark, 64, 10)


@query("obs_partial", f"WITH {ENS} SELECT e.ens, e.n, t.j::BIGINT AS j, e.x AS y FROM ens e JOIN range(0, 10) t(j) ON e.i = floor(t.j * 64 / 10.0 + 1e-9)::BIGINT")
def obs_partial(spark, d):
    return ob.selected(_ens(spark, d), ob.even_sites(spark, 64, 10))


@query("obs_interpolated", f"WITH {ENS}, p AS (SELECT j, 3.3 + 7.7 * j AS pos FROM range(0, 9) t(j)), h AS (SELECT j, floor(pos)::BIGINT % 64 AS i, 1 - (pos - floor(pos)) AS h FROM p UNION ALL SELECT j, (floor(pos)::BIGINT + 1) % 64, pos - floor(pos) FROM p) SELECT ens, n, j::BIGINT AS j, round(sum(h * x), 6) + 0.0 AS y FROM ens JOIN h USING (i) GROUP BY ens, n, j")
def obs_interpolated(spark, d):
    sites = spark.range(9).select(F.col("id").alias("j"), (3.3 + 7.7 * F.col("id")).alias("pos"))
    return rounded(ob.interpolated(_ens(spark, d), sites, 64), "y")


@query("obs_cubic", f"WITH {ENS} SELECT ens, n, i, round(x ** 3, 6) + 0.0 AS y FROM ens")
def obs_cubic(spark, d):
    return _ens(spark, d).select("ens", "n", "i", r6(F.col("x") * F.col("x") * F.col("x")).alias("y"))


@query("obs_alternating", f"WITH {ENS} SELECT ens, n, i, x FROM ens WHERE i % 2 = n % 2")
def obs_alternating(spark, d):
    """Even and odd indices in turn; the member number stands for the observation time."""
    return ob.alternating(_ens(spark, d), F.col("n"))


# --- ensembles -------------------------------------------------------------------------------------------

_PHI = lambda z: f"(CASE WHEN {z} >= 0 THEN 1 - 0.5 * {_TAIL(f'abs({z}) / sqrt(2)')} ELSE 0.5 * {_TAIL(f'abs({z}) / sqrt(2)')} END)"
_TAIL = lambda v: f"((((((1.061405429 / (1 + 0.3275911 * {v}) - 1.453152027) / (1 + 0.3275911 * {v}) + 1.421413741) / (1 + 0.3275911 * {v}) - 0.284496736) / (1 + 0.3275911 * {v}) + 0.254829592) / (1 + 0.3275911 * {v})) * exp(-{v} * {v}))"


@query("crps_gauss", f"WITH {ENS}, {TRUTH}, {UNIFORM}, {MOMENTS}, z AS (SELECT ens, i, sqrt(var) AS s, (truth - mu) / sqrt(var) AS z FROM mom JOIN truth USING (i)) SELECT ens, i, round(s * (z * (2 * {_PHI('z')} - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())), 6) + 0.0 AS crps FROM z")
def crps_gauss(spark, d):
    e = _ens(spark, d)
    m = en.moments(en.uniform_weights(e)).join(_truth(e), "i")
    return m.select("ens", "i", r6(en.crps_gauss(F.col("truth"), F.col("mu"), F.col("spread"))).alias("crps"))


@query("error_components", f"WITH {ENS}, {TRUTH}, {UNIFORM}, {MOMENTS} SELECT i, round(avg(abs(mu - truth)), 6) + 0.0 AS err, round(avg(sqrt(var)), 6) + 0.0 AS spread FROM mom JOIN truth USING (i) GROUP BY i")
def error_components(spark, d):
    e = _ens(spark, d)
    s = en.errors(en.uniform_weights(e), _truth(e))
    return s.groupBy("i").agg(r6(F.avg(F.abs("err"))).alias("err"), r6(F.avg("spread")).alias("spread"))


@query("rmse_histogram", f"WITH {ENS}, {TRUTH}, e AS (SELECT ens, n, sqrt(avg((x - truth) ** 2)) AS r FROM ens JOIN truth USING (i) GROUP BY ens, n) SELECT least(floor(r / 0.01), 29)::BIGINT AS bin, count(*)::BIGINT AS n FROM e GROUP BY 1")
def rmse_histogram(spark, d):
    """Thirty bins of the members' root mean square distance from the truth."""
    e = _ens(spark, d)
    r = e.join(_truth(e), "i").groupBy("ens", "n").agg(F.sqrt(F.avg((F.col("x") - F.col("truth")) ** 2)).alias("r"))
    return r.groupBy(F.least(F.floor(F.col("r") / 0.01), F.lit(29)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("rank_hist_weighted", f"WITH {ENS}, {TRUTH}, {WEIGHTED}, rk AS (SELECT ens, i, sum(CASE WHEN x < truth THEN w ELSE 0 END) AS mass FROM wens JOIN truth USING (i) GROUP BY ens, i) SELECT ens, least(floor(mass * 10 + 1e-9), 9)::BIGINT AS bin, count(*)::BIGINT AS n FROM rk GROUP BY ens, 2")
def rank_hist_weighted(spark, d):
    e = _weighted(spark, d)
    m = e.join(_truth(e), "i").groupBy("ens", "i").agg(F.sum(F.when(F.col("x") < F.col("truth"), F.col("w")).otherwise(0.0)).alias("mass"))
    return m.groupBy("ens", F.least(F.floor(F.col("mass") * 10 + 1e-9), F.lit(9)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("ens_spectra", f"{_COV}, err AS (SELECT ens, i, avg(x) AS mu FROM ens GROUP BY ens, i), t AS (SELECT ens, sum((mu - truth) ** 2) AS err2 FROM err JOIN (SELECT i, avg(x) AS truth FROM ens GROUP BY i) USING (i) GROUP BY ens) SELECT ens, round(sum(cov), 5) + 0.0 AS total, round(any_value(err2), 5) + 0.0 AS misfit, count(*)::BIGINT AS n FROM cov JOIN t USING (ens) WHERE i = j GROUP BY ens")
def ens_spectra(spark, d):
    """Singular values and misfits along them; their squares add up to the variance and the squared error."""
    e = _ens(spark, d)
    s = da.ensemble_spectra(e, _truth(e), 64)
    return s.groupBy("ens").agg(r6(F.sum(F.col("sval") ** 2), 5).alias("total"), r6(F.sum(F.col("umisf") ** 2), 5).alias("misfit"), F.count(F.lit(1)).alias("n"))


def _noise(name, factor, by_index):
    sql = f"WITH {ENS}, a AS (SELECT *, avg(x) OVER (PARTITION BY ens, i) AS mu, var_samp(x) OVER (PARTITION BY ens, i) AS v FROM ens), t AS (SELECT ens, sum(v) AS total, count(*) AS dims FROM (SELECT DISTINCT ens, i, v FROM a) GROUP BY ens) SELECT ens, n, i, round(mu + {factor} * (x - mu), 6) + 0.0 AS x FROM a JOIN t USING (ens)"

    @query(name, sql)
    def run(spark, d):
        return rounded(da.noise_inflation(_ens(spark, d), 0.01, by_index), "x")


_noise("noise_mult_one", "sqrt(1 + dims * 0.01 / total)", False)
_noise("noise_mult_each", "sqrt(1 + 0.01 / v)", True)

_RING = "least(abs(i - 3), 64 - abs(i - 3))"


@query("eakf_localised", f"WITH {ENS}, a AS (SELECT *, avg(x) OVER (PARTITION BY ens, i) AS mu, x - avg(x) OVER (PARTITION BY ens, i) AS a FROM ens), y AS (SELECT ens, n, a AS ya, mu AS ym FROM a WHERE i = 3), v AS (SELECT ens, var_samp(ya) AS v, any_value(ym) AS m FROM y GROUP BY ens), c AS (SELECT a.ens, a.i, sum(a.a * y.ya) / (count(*) - 1) AS c FROM a JOIN y USING (ens, n) GROUP BY a.ens, a.i), h AS (SELECT i, CASE WHEN {_RING} / 6.56 <= 1 THEN (1 - ({_RING} / 6.56) ** 4) ** 4 ELSE 0 END AS h FROM range(0, 64) t(i)) SELECT a.ens, a.n, a.i, round(a.x + c.c * h.h / v.v * (v.v / (v.v + 0.02) * (0.1 - v.m) + (sqrt(0.02 / (v.v + 0.02)) - 1) * y.ya), 6) + 0.0 AS x FROM a JOIN y USING (ens, n) JOIN v USING (ens) JOIN c ON c.ens = a.ens AND c.i = a.i JOIN h ON h.i = a.i")
def eakf_localised(spark, d):
    """One serial step of the localised square-root filter."""
    far = F.least(F.abs(F.col("i") - 3), 64 - F.abs(F.col("i") - 3))
    return rounded(da.localised_update(_ens(spark, d), 3, 0.1, 0.02, lo.taper(far, 4.0, "Quadro")), "x")


@query("enks_lag_block", f"WITH {ENS}, e2 AS (SELECT ens, n, i, x FROM ens UNION ALL SELECT ens, n, 64 + i, 0.9 * x FROM ens), m AS MATERIALIZED (SELECT ens, i, avg(x) AS mu FROM e2 GROUP BY ens, i), a AS MATERIALIZED (SELECT ens, n, i, x, x - mu AS a, mu FROM e2 JOIN m USING (ens, i)), y AS MATERIALIZED (SELECT ens, n, a AS ya, mu AS ym FROM a WHERE i = 3), c AS MATERIALIZED (SELECT a.ens, a.i, sum(a.a * y.ya) / (count(*) - 1) AS c FROM a JOIN y USING (ens, n) GROUP BY a.ens, a.i), v AS (SELECT ens, c AS v FROM c WHERE i = 3) SELECT a.ens, a.n, a.i // 64 AS lag, a.i % 64 AS i, round(a.x + c.c / (v.v + 0.02) * (0.1 - y.ym) - 1 / (1 + sqrt(0.02 / (v.v + 0.02))) * c.c / (v.v + 0.02) * y.ya, 6) + 0.0 AS x FROM a JOIN y USING (ens, n) JOIN c ON c.ens = a.ens AND c.i = a.i JOIN v ON v.ens = a.ens")
def enks_lag_block(spark, d):
    """A smoother's step: states of the lag window stand beside the present one and take the same update."""
    e = _ens(spark, d)
    block = e.unionByName(e.select("ens", "n", (F.col("i") + 64).alias("i"), (0.9 * F.col("x")).alias("x")))
    u = filters.scalar_update(block, 3, 0.1, 0.02, "Serial")
    return u.select("ens", "n", F.floor(F.col("i") / 64).cast("long").alias("lag"), (F.col("i") % 64).alias("i"), r6(F.col("x")).alias("x"))


_ANOM = f"{ENS}, m AS MATERIALIZED (SELECT ens, i, avg(x) AS mu FROM ens GROUP BY ens, i), a AS MATERIALIZED (SELECT ens, n, i, x, x - mu AS a, mu FROM ens JOIN m USING (ens, i))"
_RHF = """d AS (SELECT ens, n, a AS ya, (0.1 - mu - a) / sqrt(0.02) AS d FROM a WHERE i = 3),
w AS (SELECT *, greatest(exp(-0.5 * d * d) / sum(exp(-0.5 * d * d)) OVER (PARTITION BY ens), 1e-10) AS w, count(*) OVER (PARTITION BY ens) AS sz, row_number() OVER (PARTITION BY ens ORDER BY d, n) AS rk FROM d),
c AS MATERIALIZED (SELECT *, sum(w) OVER (PARTITION BY ens ORDER BY rk ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY ens) * (sz - 1) / sz AS cw FROM w),
q AS MATERIALIZED (SELECT *, least(greatest((rk - 0.5) / sz, min(cw) OVER (PARTITION BY ens)), max(cw) OVER (PARTITION BY ens)) AS q FROM c),
lo AS (SELECT q.ens, q.n, max(c.cw) AS c0, arg_max(c.d, c.cw) AS d0 FROM q JOIN c ON c.ens = q.ens AND c.cw <= q.q GROUP BY q.ens, q.n),
hi AS (SELECT q.ens, q.n, min(c.cw) AS c1, arg_min(c.d, c.cw) AS d1 FROM q JOIN c ON c.ens = q.ens AND c.cw >= q.q GROUP BY q.ens, q.n),
mv AS MATERIALIZED (SELECT q.ens, q.n, q.ya, CASE WHEN c1 > c0 THEN d0 + (q.q - c0) / (c1 - c0) * (d1 - d0) ELSE d0 END - q.d AS move FROM q JOIN lo USING (ens, n) JOIN hi USING (ens, n)),
sl AS (SELECT a.ens, a.i, sum(a.a * mv.ya) / sum(mv.ya * mv.ya) AS slope FROM a JOIN mv USING (ens, n) GROUP BY a.ens, a.i)"""


@query("rank_histogram_filter", f"WITH {_ANOM}, {_RHF} SELECT a.ens, a.n, a.i, round(a.x - mv.move * sl.slope * sqrt(0.02), 6) + 0.0 AS x FROM a JOIN mv USING (ens, n) JOIN sl ON sl.ens = a.ens AND sl.i = a.i")
def rank_histogram_filter(spark, d):
    return rounded(da.rank_histogram_update(_ens(spark, d), 3, 0.1, 0.02), "x")


def _obs_of_truth(spark, e, every):
    return _truth(e).where(F.col("i") % every == 0).select((F.col("i") / every).cast("long").alias("j"), "i", F.col("truth").alias("y"))


@query("letkf_step")
def letkf_step(spark, d):
    """Local analyses of batches of two on a ring of 64, every fourth variable observed."""
    e = _ens(spark, d)
    return rounded(da.local_transform(e, _obs_of_truth(spark, e, 4), 0.02, 4.0, 64), "x")


_ONE = """o AS (SELECT i, avg(x) AS y FROM ens WHERE i % 16 = 0 GROUP BY i), near AS (SELECT s.i, o.i AS oi, o.y, CASE WHEN t.dist / 6.56 <= 1 THEN (1 - (t.dist / 6.56) ** 4) ** 4 ELSE 0 END AS h FROM (SELECT DISTINCT i FROM ens) s, o, LATERAL (SELECT (least(abs(s.i // 2 * 2 - o.i), 64 - abs(s.i // 2 * 2 - o.i)) + least(abs(s.i // 2 * 2 + 1 - o.i), 64 - abs(s.i // 2 * 2 + 1 - o.i))) / 2.0 AS dist) t),
l AS MATERIALIZED (SELECT a.ens, a.n, near.i, a.a * sqrt(near.h / 0.02) AS ya, (near.y - a.mu) * sqrt(near.h / 0.02) AS dy FROM a JOIN near ON near.oi = a.i WHERE near.h > 1e-3),
g AS (SELECT a.ens, a.i, sum(l.ya * a.a) AS ga, sum(l.ya * l.ya) AS s, any_value(l.dy) AS dy, count(*) - 1 AS n1 FROM a JOIN l USING (ens, n, i) GROUP BY a.ens, a.i)"""


@query("letkf_one_obs", f"WITH {_ANOM}, {_ONE} SELECT a.ens, a.n, a.i, round(a.x + CASE WHEN g.ga IS NULL THEN 0 ELSE g.dy / (g.n1 + g.s) * g.ga + (sqrt(g.n1 / (g.n1 + g.s)) - 1) / g.s * l.ya * g.ga END, 6) + 0.0 AS x FROM a LEFT JOIN g ON g.ens = a.ens AND g.i = a.i LEFT JOIN l ON l.ens = a.ens AND l.n = a.n AND l.i = a.i")
def letkf_one_obs(spark, d):
    """Local analyses so far apart that a batch sees one observation at most, for which the transform has a closed form."""
    e = _ens(spark, d)
    return rounded(da.local_transform(e, _obs_of_truth(spark, e, 16), 0.02, 4.0, 64, kind="Quadro"), "x")


_FINITE = """s AS (SELECT ens, sum(a * a) / 0.02 AS s2, any_value((t.truth - a.mu) ** 2) / 0.02 AS du2, count(*)::DOUBLE AS n FROM a JOIN (SELECT avg(x) AS truth FROM ens WHERE i = 0) t ON true WHERE i = 0 GROUP BY ens),
f AS (SELECT *, (1 / (s2 + n - 1) + (n - 1) / (n - 1)) / n * (n - 1) AS prior FROM s),
k AS (SELECT *, (n + 1) / n / sqrt(((n + 1) / n / (n / (n - 1))) ** prior) AS en, n / (n - 1) * sqrt(((n + 1) / n / (n / (n - 1))) ** prior) AS cl FROM f),
b(ens, s2, du2, n, en, cl, lo, hi, step) AS (SELECT ens, s2, du2, n, en, cl, -12.0::DOUBLE, 12.0::DOUBLE, 0 FROM k UNION ALL
SELECT ens, s2, du2, n, en, cl, CASE WHEN g < 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN g < 0 THEN hi ELSE (lo + hi) / 2 END, step + 1 FROM (SELECT *, - s2 * du2 / (exp((lo + hi) / 2) * s2 + n - 1) ** 2 * exp((lo + hi) / 2) - en * exp(-(lo + hi) / 2) + cl AS g FROM b WHERE step < 60))"""


@query("enkf_n_one_obs", f"WITH RECURSIVE {_ANOM}, {_FINITE} SELECT ens, round(exp((lo + hi) / 4), 4) + 0.0 AS infl FROM b WHERE step = 60")
def enkf_n_one_obs(spark, d):
    """Finite-size inflation from one observed variable, by bisection."""
    e = _ens(spark, d)
    return rounded(da.finite_size_inflation(e, _obs_of_truth(spark, e, 64), 0.02), "infl", places=4)


@query("enkf_n_inflation")
def enkf_n_inflation(spark, d):
    e = _ens(spark, d)
    return rounded(da.finite_size_inflation(e, _obs_of_truth(spark, e, 8), 0.02), "infl", places=4)


# --- particles -------------------------------------------------------------------------------------------


@query("pf_bandwidth", f"WITH {_PART} SELECT sys, round(count(*) ** (-1.0 / 7), 9) + 0.0 AS bandwidth FROM rw GROUP BY sys")
def pf_bandwidth(spark, d):
    return _particles(spark, d).groupBy("sys").agg(r6(pa.bandwidth(F.count(F.lit(1)), 3), 9).alias("bandwidth"))


@query("pf_adaptive_root", f"WITH {_PART}, r AS (SELECT 1 + 0.2 * k AS root FROM range(0, 120) t(k)), fl AS (SELECT sys, root, w ** (1 / root) AS v FROM rw, r), sz AS (SELECT sys, root, sum(v) ** 2 / sum(v * v) AS n_eff, count(*) AS size FROM fl GROUP BY sys, root) SELECT sys, round(min(CASE WHEN n_eff >= 0.8 * size THEN root END), 1) + 0.0 AS root FROM sz GROUP BY sys")
def pf_adaptive_root(spark, d):
    """The least flattening of the weights after which four fifths of the particles count."""
    return rounded(pa.adaptive_root(_particles(spark, d), 0.8, 0.2), "root", places=1)


@query("pf_colour", f"WITH {_PART}, x AS (SELECT rw.sys, rw.n, rw.w, s.y FROM rw JOIN s ON s.sys = rw.sys AND s.k = rw.n), c AS (SELECT sys, sum(w * y) AS mu, CASE WHEN 1 - max(w) < 1e-10 THEN 1 ELSE 1 / (1 - sum(w * w)) END AS ub FROM x GROUP BY sys) SELECT sys, n, round(sqrt(ub * w) * (y - mu), 6) + 0.0 AS c FROM x JOIN c USING (sys)")
def pf_colour(spark, d):
    p = _particles(spark, d).join(_events(spark, d).select("sys", F.col("k").alias("n"), "y"), ["sys", "n"])
    return rounded(pa.coloured(p).select("sys", "n", "c"), "c")


@query("pf_jitter_rows", f"WITH {_PART} SELECT DISTINCT sys, true AS moved, true AS kept FROM rw")
def pf_jitter_rows(spark, d):
    """Of resampled particles only repeats move; the check holds both facts."""
    dup = pa.duplicates(pa.systematic(_particles(spark, d), 0.37))
    j = pa.jittered(dup.withColumn("y", F.lit(1.0)), 0.1, 7)
    return j.groupBy("sys").agg(F.bool_and(~F.col("again") | (F.col("y") != 1.0)).alias("moved"), F.bool_and(F.col("again") | (F.col("y") == 1.0)).alias("kept"))


# --- time ------------------------------------------------------------------------------------------------


@query("cycle_steps", f"WITH {_GRID} SELECT sys, (k - 1) // 5 AS ko, k FROM gr WHERE k > 0")
def cycle_steps(spark, d):
    """The model steps of each observation period of each series."""
    return _grid(spark, d).where("k > 0").select("sys", F.floor((F.col("k") - 1) / 5).cast("long").alias("ko"), "k")


@query("lag_blocks", f"WITH {_GRID}, o AS (SELECT sys, k // 5 - 1 AS ko, k AS z FROM gr WHERE k % 5 = 0 AND k > 0) SELECT o.sys, o.ko, gr.k FROM o JOIN gr ON gr.sys = o.sys AND gr.k <= o.z AND gr.k > o.z - 10 AND gr.k > 0")
def lag_blocks(spark, d):
    """The steps that a smoother of lag one goes over again at each observation: exploded from the grid, no join."""
    g = _grid(spark, d).where("ko is not null")
    return g.select("sys", "ko", F.explode(F.sequence(F.greatest((F.col("ko") - 1) * 5 + 1, F.lit(1)), F.col("k"))).alias("k"))


@query("serial_order", f"WITH {ENS}, v AS (SELECT ens, i, var_samp(x) AS v FROM ens GROUP BY ens, i) SELECT ens, i, row_number() OVER (PARTITION BY ens ORDER BY round(v, 9), i)::BIGINT AS place FROM v")
def serial_order(spark, d):
    """Observations of each ensemble in order of their spread."""
    v = _ens(spark, d).groupBy("ens", "i").agg(F.round(F.var_samp("x"), 9).alias("v"))
    return v.select("ens", "i", F.row_number().over(Window.partitionBy("ens").orderBy("v", "i")).cast("long").alias("place"))


@query("corr_length", f"WITH {EVENTS}, {_ACOV}, {_AR1} SELECT sys, round(CASE WHEN a = 0 THEN 0 ELSE 1 / ln(1 / a) END, 6) + 0.0 AS length FROM ar")
def corr_length(spark, d):
    a = se.autocovariance(_events(spark, d)).select("sys", se.ar1(F.col("acov")).alias("a"))
    return a.select("sys", r6(se.correlation_length(F.col("a"))).alias("length"))


@query("error_growth", f"WITH {EVENTS}, {_ACOV}, {_AR1} SELECT s.sys, s.k, round(1 / (1 + exp(-(ln(0.2 / 0.8) + (s.k - 10) / CASE WHEN a = 0 THEN 1 ELSE 1 / ln(1 / a) END))), 9) + 0.0 AS s FROM s JOIN ar ON ar.sys = s.sys")
def error_growth(spark, d):
    """Logistic growth of an error that is a fifth of its limit at step 10, at the rate of each series' correlation length."""
    s = _events(spark, d)
    a = se.autocovariance(s).select("sys", se.correlation_length(se.ar1(F.col("acov"))).alias("length"))
    length = F.when(F.col("length") == 0, 1.0).otherwise(F.col("length"))
    return s.join(a, "sys").select("sys", "k", r6(se.logistic(F.col("k"), 0.2, length, 10), 9).alias("s"))


# --- draws -----------------------------------------------------------------------------------------------

_KINDS = "('gauss'), ('laplace'), ('laplace_parallel'), ('student'), ('cube'), ('exponential')"


@query("rv_moments", f"SELECT kind, 4 * (SELECT count(*) FROM lineitem)::BIGINT AS draws, CASE WHEN kind = 'exponential' THEN 1.0 ELSE 0.0 END::DOUBLE AS mean, 1.0::DOUBLE AS var FROM (VALUES {_KINDS}) v(kind)")
def rv_moments(spark, d):
    """Mean and variance of each kind of draw over every line item and four coordinates, to one decimal: draws go by a row's keys."""
    row = [F.col("l_orderkey"), F.col("l_linenumber")]
    e = read(spark, d, "lineitem").select(*row, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    key = [*row, F.col("i")]
    kinds = {"gauss": draws.gauss(1, *key), "laplace": draws.laplace(1, row, *key), "laplace_parallel": draws.laplace_parallel(1, *key), "student": draws.student(1, 9, row, *key), "cube": draws.cube(1, *key), "exponential": draws.exponential(1, *key)}
    x = e.select("i", *[v.alias(k) for k, v in kinds.items()])
    s = x.agg(F.count(F.lit(1)).alias("draws"), *[a for k in kinds for a in (F.avg(k).alias(f"{k}_m"), F.var_samp(k).alias(f"{k}_v"))])
    return s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col("draws").alias("draws"), r6(F.col(f"{k}_m"), 1).alias("mean"), r6(F.col(f"{k}_v"), 1).alias("var")) for k in kinds])).alias("s")).select("s.*")


@query("rv_ball", "SELECT true AS inside, 0.0::DOUBLE AS mean, count(*)::BIGINT AS rows_ FROM lineitem")
def rv_ball(spark, d):
    """Uniform draws in a ball, a row a line item."""
    e = read(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    e = draws.ball(e, ["n"], "i", 3, 5)
    r = e.groupBy("n").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("r"), F.avg("x").alias("m"), (F.count(F.lit(1)) / 3).alias("times"))
    return r.agg((F.max("r") <= 2.0 + 1e-9).alias("inside"), r6(F.avg("m"), 1).alias("mean"), F.sum("times").cast("long").alias("rows_"))


# --- localization ----------------------------------------------------------------------------------------


@query("rect_batches", "WITH p AS (SELECT vec_id AS y, i - 1 AS x FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)), z AS (SELECT max(y) + 1 AS n, (max(y) + 1) % 7 AS big, (max(y) + 1) // 7 AS base FROM p) SELECT y, x, CASE WHEN y < big * (base + 1) THEN y // (base + 1) ELSE big + (y - big * (base + 1)) // base END * 9 + CASE WHEN x < 8 THEN x // 8 ELSE 1 + (x - 8) // 7 END AS batch FROM p, z")
def rect_batches(spark, d):
    """Members by variables as a grid, in 7 by 9 rectangles."""
    e = _ens(spark, d).select(F.col("n").alias("y"), F.col("i").alias("x"))
    size = e.agg(F.max("y")).first()[0] + 1
    g = lo.batches(e, "y", size, 7).withColumnRenamed("batch", "by")
    return lo.batches(g, "x", 64, 9).select("y", "x", (F.col("by") * 9 + F.col("batch")).alias("batch"))


@query("obs_shift", f"WITH {EVENTS} SELECT sys, k, (k * 4 + round(k * 0.3)::BIGINT) % 64 AS i FROM s")
def obs_shift(spark, d):
    """Observation sites carried along a ring by the flow, the farther the later."""
    return _events(spark, d).select("sys", "k", F.pmod(F.col("k") * 4 + F.round(F.col("k") * 0.3).cast("long"), F.lit(64)).alias("i"))


# --- experiments and runs --------------------------------------------------------------------------------


@query("xp_squeeze", f"WITH {_XPS} SELECT seq, da_method, val FROM x WHERE infl = 3 AND upd_a = 'O' AND NOT isnan(val)")
def xp_squeeze(spark, d):
    """Only the coordinates that differ stay: found in one pass, then a projection."""
    x = _xps(spark, d).where("infl = 3 and upd_a = 'O'").where(~F.isnan("val")).select("seq", "da_method", "upd_a", "infl", "val")
    return xp.squeezed(x, ["da_method", "upd_a", "infl"])


@query("xp_last_wins", f"WITH {_XPS} SELECT da_method, upd_a, infl, seed, max(seq)::BIGINT AS seq FROM x GROUP BY da_method, upd_a, infl, seed")
def xp_last_wins(spark, d):
    """Of experiments at the same coordinates the last stays."""
    return xp.last_at(_xps(spark, d), ["da_method", "upd_a", "infl", "seed"]).select("da_method", "upd_a", "infl", "seed", "seq")


@query("xp_get_stat", f"WITH {_XPS} SELECT seq, 'rmse.a' AS statkey, val AS value FROM x WHERE NOT isnan(val)")
def xp_get_stat(spark, d):
    """One statistic of the long table of averages, found by its full or its short name."""
    x = _xps(spark, d).where(~F.isnan("val"))
    long = x.select("seq", F.explode(F.array(F.struct(F.lit("err.rms.a").alias("statkey"), F.col("val").alias("value")), F.struct(F.lit("spread.rms.a").alias("statkey"), (F.col("val") * 2).alias("value")))).alias("s")).select("seq", "s.*")
    return xp.stat(long, "rmse.a")


@query("xp_tabulate", f"{_MEAN} SELECT da_method, upd_a, infl, CASE WHEN n_fail = 0 THEN round(m, 3) END AS \"rmse.a\", CASE WHEN n_fail = 0 THEN round(2 * m, 3) END AS \"rmv.a\" FROM g WHERE n_fail = 0")
def xp_tabulate(spark, d):
    m = xp.mean_over(_xps(spark, d), ["da_method", "upd_a", "infl"]).where("n_fail = 0")
    long = m.select("da_method", "upd_a", "infl", F.explode(F.array(F.struct(F.lit("rmse.a").alias("statkey"), F.col("val").alias("v")), F.struct(F.lit("rmv.a").alias("statkey"), (2 * F.col("val")).alias("v")))).alias("s")).select("da_method", "upd_a", "infl", "s.*")
    t = xp.table(long, ["da_method", "upd_a", "infl"], "statkey", ["rmse.a", "rmv.a"], "v")
    return t.select("da_method", "upd_a", "infl", *[F.round(F.col(f"`{c}`"), 3).alias(c) for c in ("rmse.a", "rmv.a")])


_UQ = "u AS (SELECT p_partkey, p_retailprice / 100 AS v, p_size * 0.013::DOUBLE AS p FROM part), q AS (SELECT *, round_even(p * 10 ** (-floor(log10(p))), 0) / 10 ** (-floor(log10(p))) AS q FROM u), w AS (SELECT *, round_even(v * 10 ** (-floor(log10(q))), 0) / 10 ** (-floor(log10(q))) AS w FROM q)"
_PLAIN = lambda x: f"regexp_replace(printf('%.10f', {x}), '\\.?0+$', '')"


@query("uq_format", f"WITH {_UQ} SELECT p_partkey, {_PLAIN('w')} || ' ±' || {_PLAIN('q')} AS said FROM w")
def uq_format(spark, d):
    """A value and its precision as text: the precision to one figure, the value to its order."""
    return read(spark, d, "part").select("p_partkey", ro.with_precision(F.col("p_retailprice") / 100, F.col("p_size") * 0.013).alias("said"))


@query("runs_crashed", f"WITH {_XPS} SELECT seq AS xp_id FROM x WHERE seq % 10 = 7")
def runs_crashed(spark, d):
    """Two runs are saved, the second lacking some experiments; the latest is compacted, read and held against the plan."""
    root = _shared(spark, "runs")
    x = _xps(spark, d).withColumnRenamed("seq", "xp_id")
    runs.save_run(x, root, "sweep", 1, files=4)
    runs.save_run(x.where("xp_id % 10 <> 7"), root, "sweep", 2)
    new = runs.compacted(spark, root, "sweep", 2, 1)
    assert runs.latest_run(spark, root, "sweep") == new
    return runs.crashed(x.select("xp_id"), runs.load_run(spark, root, "sweep"))


_SETTINGS = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::{'DOUBLE' if isinstance(v, float) else 'INTEGER'}" for v in row) + ")" for row in settings.SETTINGS)


@query("settings_table", f"WITH {EVENTS}, v AS (SELECT * FROM (VALUES {_SETTINGS}) v({', '.join(c.split()[0] for c in settings.KIND.split(', '))})) SELECT s.sys, v.name, v.model, count(*)::BIGINT AS steps, count(*) FILTER (s.k % v.dko = 0)::BIGINT AS observed, count(*) FILTER (s.k * v.dt > v.burn_in)::BIGINT AS counted FROM s, v GROUP BY s.sys, v.name, v.model")
def settings_table(spark, d):
    """What each named setting makes of each series: its steps, those observed, and those after burn-in."""
    return settings.configured(_events(spark, d))


@query("settings_load", f"WITH {EVENTS} SELECT sys, 'lorenz96_sakov2008' AS name, 'lorenz96' AS model, count(*)::BIGINT AS steps, count(*)::BIGINT AS observed, count(*) FILTER (k * 0.05::DOUBLE > 20)::BIGINT AS counted FROM s GROUP BY sys")
def settings_load(spark, d):
    """One setting, loaded by its name, on each series."""
    return settings.configured(_events(spark, d), "lorenz96_sakov2008")

"""The registered queries of the data-assimilation engine, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlake.functions import ensemble as en
from twinlake.functions import rounding as ro
from twinlake.functions import series as se
from twinlake.operators import experiments as xp
from twinlake.operators import localization as lo
from twinlake.operators import particle as pa
from twinlake.plans import filters
from twinlake.plans.registry import query
from twinlake.sources.tables import ensembles, grids, read, series


def r6(c, places: int = 6):
    return F.round(c, places) + F.lit(0.0)


def rounded(df, *cols, places: int = 6):
    return df.withColumns({c: r6(F.col(c), places) for c in cols})


ENS = "ens AS (SELECT label::BIGINT AS ens, vec_id::BIGINT AS n, i::BIGINT - 1 AS i, x::DOUBLE AS x FROM (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))"
TRUTH = "truth AS (SELECT i, avg(x) AS truth FROM ens GROUP BY i)"
#: Members get weights in proportion to 1 + vec_id mod 3.
WEIGHTED = "r AS (SELECT label::BIGINT AS ens, vec_id::BIGINT AS n, (1 + vec_id % 3)::DOUBLE AS r FROM embeddings), wens AS (SELECT e.ens, e.n, e.i, e.x, r.r / t.t AS w FROM ens e JOIN r USING (ens, n) JOIN (SELECT ens, sum(r) AS t FROM r GROUP BY ens) t USING (ens))"
UNIFORM = "wens AS (SELECT e.*, 1.0 / c.c AS w FROM ens e JOIN (SELECT label::BIGINT AS ens, count(*)::DOUBLE AS c FROM embeddings GROUP BY 1) c USING (ens))"
MOMENTS = """c AS (SELECT ens, i, sum(w * x) AS mu, CASE WHEN 1 - max(w) < 1e-10 THEN 1 ELSE 1 / (1 - sum(w * w)) END AS ub FROM wens GROUP BY ens, i),
mom AS (SELECT ens, i, mu, ub * sum(w * (x - mu) ** 2) AS var, sum(w * (x - mu) ** 3) AS m3, sum(w * (x - mu) ** 4) AS m4, sum(w * abs(x - mu)) AS mad FROM wens JOIN c USING (ens, i) GROUP BY ens, i, mu, ub)"""
EVENTS = "s AS (SELECT event_type AS sys, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)::BIGINT AS k, value AS y FROM events)"


def _ens(spark, d):
    return ensembles(read(spark, d, "embeddings"))


def _truth(e):
    return e.groupBy("i").agg(F.avg("x").alias("truth"))


def _weighted(spark, d):
    return en.normalised(_ens(spark, d), (1 + F.col("n") % 3).cast("double"))


def _events(spark, d):
    return series(read(spark, d, "events"))


# --- ensembles -------------------------------------------------------------------------------------------


@query("ens_scores", f"WITH {ENS}, {TRUTH}, {UNIFORM}, {MOMENTS} SELECT ens, round(sqrt(avg((mu - truth) ** 2)), 6) + 0.0 AS rmse, round(sqrt(avg(var)), 6) + 0.0 AS rmv FROM mom JOIN truth USING (i) GROUP BY ens")
def ens_scores(spark, d):
    """Root mean square error and spread of each ensemble: the flagship query."""
    e = _ens(spark, d)
    s = en.errors(en.uniform_weights(e), _truth(e))
    return s.groupBy("ens").agg(r6(F.sqrt(F.avg(F.col("err") ** 2))).alias("rmse"), r6(F.sqrt(F.avg(F.col("spread") ** 2))).alias("rmv"))


@query("ens_mean", f"WITH {ENS} SELECT ens, i, round(avg(x), 6) + 0.0 AS mu FROM ens GROUP BY ens, i")
def ens_mean(spark, d):
    return _ens(spark, d).groupBy("ens", "i").agg(r6(F.avg("x")).alias("mu"))


@query("ens_weighted_mu", f"WITH {ENS}, {WEIGHTED} SELECT ens, i, round(sum(w * x), 6) + 0.0 AS mu FROM wens GROUP BY ens, i")
def ens_weighted_mu(spark, d):
    return rounded(en.centre(_weighted(spark, d)).select("ens", "i", "mu"), "mu")


@query("ens_center", f"WITH {ENS} SELECT ens, n, i, round((x - avg(x) OVER (PARTITION BY ens, i)) * sqrt(count(*) OVER (PARTITION BY ens, i) / (count(*) OVER (PARTITION BY ens, i) - 1.0)), 6) + 0.0 AS a FROM ens")
def ens_center(spark, d):
    return rounded(en.anomalies(_ens(spark, d), rescale=True).select("ens", "n", "i", "a"), "a")


@query("ens_inflate", f"WITH {ENS} SELECT ens, n, i, round(avg(x) OVER (PARTITION BY ens, i) + 1.1 * (x - avg(x) OVER (PARTITION BY ens, i)), 6) + 0.0 AS x FROM ens")
def ens_inflate(spark, d):
    return rounded(en.inflated(_ens(spark, d), 1.1), "x")


@query("ens_moments", f"WITH {ENS}, {UNIFORM}, {MOMENTS} SELECT ens, i, round(mu, 6) + 0.0 AS mu, round(var, 6) + 0.0 AS var, round(sqrt(var), 6) + 0.0 AS spread, round(m3 / var ** 1.5, 6) + 0.0 AS skew, round(m4 / var ** 2 - 3, 6) + 0.0 AS kurt, round(mad, 6) + 0.0 AS mad FROM mom")
def ens_moments(spark, d):
    return rounded(en.moments(en.uniform_weights(_ens(spark, d))), "mu", "var", "spread", "skew", "kurt", "mad")


@query("ens_moments_weighted", f"WITH {ENS}, {WEIGHTED}, {MOMENTS} SELECT ens, round(avg(sqrt(var)), 6) + 0.0 AS spread, round(avg(m3 / var ** 1.5), 6) + 0.0 AS skew, round(avg(m4 / var ** 2 - 3), 6) + 0.0 AS kurt, round(avg(mad), 6) + 0.0 AS mad FROM mom GROUP BY ens")
def ens_moments_weighted(spark, d):
    m = en.moments(_weighted(spark, d))
    return m.groupBy("ens").agg(*[r6(F.avg(c)).alias(c) for c in ("spread", "skew", "kurt", "mad")])


@query("ens_gscore", f"WITH {ENS}, {TRUTH}, {UNIFORM}, {MOMENTS} SELECT ens, i, round(2 * ln(sqrt(var)) + ((mu - truth) / sqrt(var)) ** 2, 6) + 0.0 AS gscore FROM mom JOIN truth USING (i)")
def ens_gscore(spark, d):
    e = _ens(spark, d)
    return rounded(en.errors(en.uniform_weights(e), _truth(e)).select("ens", "i", "gscore"), "gscore")


_FIELD = "round(avg(v), 6) + 0.0 AS m, round(avg(v * v), 6) + 0.0 AS ms, round(sqrt(avg(v * v)), 6) + 0.0 AS rms, round(avg(abs(v)), 6) + 0.0 AS ma, round(exp(avg(ln(abs(v)))), 6) + 0.0 AS gm"


@query("field_summaries", f"WITH {ENS}, {TRUTH}, {UNIFORM}, {MOMENTS}, f AS (SELECT ens, mu - truth AS v FROM mom JOIN truth USING (i)) SELECT ens, {_FIELD} FROM f GROUP BY ens")
def field_summaries(spark, d):
    e = _ens(spark, d)
    return rounded(en.field_summaries(en.errors(en.uniform_weights(e), _truth(e)), "err", ["ens"]), "m", "ms", "rms", "ma", "gm")


@query("sector_summaries", f"WITH {ENS}, {TRUTH}, {UNIFORM}, {MOMENTS}, sec AS (SELECT 'low' AS sector, i FROM range(0, 24) t(i) UNION ALL SELECT 'mid', i FROM range(16, 48) t(i) UNION ALL SELECT 'high', i FROM range(40, 64) t(i)), f AS (SELECT ens, sector, mu - truth AS v FROM mom JOIN truth USING (i) JOIN sec USING (i)) SELECT ens, sector, {_FIELD} FROM f GROUP BY ens, sector")
def sector_summaries(spark, d):
    e = _ens(spark, d)
    sec = [spark.range(a, z).select(F.lit(s).alias("sector"), F.col("id").alias("i")) for s, a, z in (("low", 0, 24), ("mid", 16, 48), ("high", 40, 64))]
    sec = sec[0].union(sec[1]).union(sec[2])
    return rounded(en.sector_summaries(en.errors(en.uniform_weights(e), _truth(e)), "err", sec, ["ens"]), "m", "ms", "rms", "ma", "gm")


_CRPS = """, one AS (SELECT ens, i, sum(w * abs(x - truth)) AS a FROM wens JOIN truth USING (i) GROUP BY ens, i), two AS (SELECT p.ens, p.i, sum(p.w * q.w * abs(p.x - q.x)) AS b FROM wens p JOIN wens q ON p.ens = q.ens AND p.i = q.i GROUP BY p.ens, p.i) SELECT ens, i, round(a - b / 2, 6) + 0.0 AS crps FROM one JOIN two USING (ens, i)"""


@query("crps_ens", f"WITH {ENS}, {TRUTH}, {UNIFORM}{_CRPS}")
def crps_ens(spark, d):
    e = _ens(spark, d)
    return rounded(en.crps(en.uniform_weights(e), _truth(e)), "crps")


@query("crps_weighted", f"WITH {ENS}, {TRUTH}, {WEIGHTED}{_CRPS}")
def crps_weighted(spark, d):
    e = _weighted(spark, d)
    return rounded(en.crps(e, _truth(e)), "crps")


@query("rank_hist", f"WITH {ENS}, {TRUTH}, rk AS (SELECT ens, i, sum(CASE WHEN x < truth THEN 1 ELSE 0 END)::BIGINT AS rh FROM ens JOIN truth USING (i) GROUP BY ens, i) SELECT ens, rh, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY ens), 6) + 0.0 AS density FROM rk GROUP BY ens, rh")
def rank_hist(spark, d):
    e = _ens(spark, d)
    return rounded(en.rank_histogram(en.rank_of_truth(e, _truth(e))), "density")


_COV = f"WITH {ENS}, a AS (SELECT ens, n, i, x - avg(x) OVER (PARTITION BY ens, i) AS a FROM ens), cov AS (SELECT p.ens, p.i, q.i AS j, sum(p.a * q.a) / (count(*) - 1) AS cov FROM a p JOIN a q ON p.ens = q.ens AND p.n = q.n AND p.i <= q.i GROUP BY p.ens, p.i, q.i)"


@query("ens_cov_corr", f"{_COV} SELECT c.ens, c.i, c.j, round(c.cov, 6) + 0.0 AS cov, round(c.cov / sqrt(l.cov * r.cov), 6) + 0.0 AS corr FROM cov c JOIN cov l ON l.ens = c.ens AND l.i = c.i AND l.j = c.i JOIN cov r ON r.ens = c.ens AND r.i = c.j AND r.j = c.j")
def ens_cov_corr(spark, d):
    return rounded(en.covariance(_ens(spark, d), 64), "cov", "corr")


@query("circulant_acf", f"{_COV}, b AS (SELECT ens, i, j, cov FROM cov UNION ALL SELECT ens, j, i, cov FROM cov WHERE i < j) SELECT ens, (j - i + 64) % 64 AS lag, round(sum(cov) / 64, 6) + 0.0 AS acf FROM b GROUP BY ens, (j - i + 64) % 64")
def circulant_acf(spark, d):
    return rounded(en.circulant_acf(en.covariance(_ens(spark, d), 64), 64), "acf")


@query("ring_mean", f"WITH {ENS}, wide AS (SELECT * FROM ens UNION ALL SELECT ens, n, i + 64, x FROM ens WHERE i < 2 UNION ALL SELECT ens, n, i - 64, x FROM ens WHERE i >= 62), w AS (SELECT ens, n, i, avg(x) OVER (PARTITION BY ens, n ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS x FROM wide) SELECT ens, n, i, round(x, 6) + 0.0 AS x FROM w WHERE i BETWEEN 0 AND 63")
def ring_mean(spark, d):
    return rounded(se.ring_mean(_ens(spark, d), 2, 64).select("ens", "n", "i", "x"), "x")


@query("select_state", f"WITH {ENS} SELECT ens, n, i // 8 AS j, x FROM ens WHERE i % 8 = 0")
def select_state(spark, d):
    """Observation of every eighth state variable, cut from the array before anything is exploded."""
    e = read(spark, d, "embeddings").select("label", "vec_id", F.transform(F.sequence(F.lit(0), F.lit(56), F.lit(8)), lambda i: F.get("embedding", i)).alias("embedding"))
    return ensembles(e).withColumnRenamed("i", "j")


@query("spectral_obs", f"WITH {ENS} SELECT ens, n, j, round(sum(x * CASE WHEN j % 2 = 0 THEN cos(2 * pi() * (j // 2 + 1) * i / 64) ELSE sin(2 * pi() * (j // 2 + 1) * i / 64) END / sqrt(32)), 6) + 0.0 AS y FROM ens CROSS JOIN range(0, 4) t(j) GROUP BY ens, n, j")
def spectral_obs(spark, d):
    """Observation by harmonics: array arithmetic in the row, no join."""

    def harmonic(j):
        wave = F.sin if j % 2 else F.cos
        part = F.transform("embedding", lambda x, i: x.cast("double") * wave(2 * F.pi() * (j // 2 + 1) * i / 64) / F.sqrt(F.lit(32.0)))
        return F.reduce(part, F.lit(0.0), lambda s, v: s + v)

    y = [harmonic(j) for j in range(4)]
    e = read(spark, d, "embeddings").select(F.col("label").cast("long").alias("ens"), F.col("vec_id").alias("n"), F.posexplode(F.array(*y)).alias("j", "y"))
    return e.select("ens", "n", F.col("j").cast("long").alias("j"), r6(F.col("y")).alias("y"))


# --- time and series -------------------------------------------------------------------------------------


_GRID = f"{EVENTS}, gr AS (SELECT sys, unnest(range(0, ((max(k) + 4) // 5) * 5 + 1)) AS k FROM s GROUP BY sys)"


def _grid(spark, d):
    return grids(_events(spark, d).groupBy("sys").agg(F.max("k").alias("last")), 0.05, 5)


@query("tseq_ticker", f"WITH {_GRID} SELECT sys, k::BIGINT AS k, CASE WHEN k % 5 = 0 AND k > 0 THEN (k // 5 - 1)::BIGINT END AS ko, round(k * 0.05, 6) AS t, CASE WHEN k > 0 THEN 0.05::DOUBLE END AS dt FROM gr")
def tseq_ticker(spark, d):
    """The time grid of each series, as long as it is."""
    return rounded(_grid(spark, d), "t")


_ACOV = "c AS (SELECT sys, k, y - avg(y) OVER (PARTITION BY sys) AS a, avg(y) OVER (PARTITION BY sys) AS mu, count(*) OVER (PARTITION BY sys) AS n FROM s), ac AS (SELECT p.sys, p.n, p.mu, l.l, sum(p.a * q.a) / (p.n - l.l) AS v FROM c p CROSS JOIN range(0, 5) l(l) JOIN c q ON q.sys = p.sys AND q.k = p.k + l.l GROUP BY p.sys, p.n, p.mu, l.l)"
_AR1 = "neg AS (SELECT sys, coalesce(min(CASE WHEN v <= 0 THEN l END), 5) AS m FROM ac GROUP BY sys), ar AS (SELECT n.sys, n.m, CASE WHEN m = 0 THEN 0 WHEN m = 1 THEN 0.01 ELSE (b.v / z.v) ** (1.0 / (m - 1)) END AS a, z.v AS v0, z.n, z.mu FROM neg n JOIN ac z ON z.sys = n.sys AND z.l = 0 LEFT JOIN ac b ON b.sys = n.sys AND b.l = n.m - 1)"


@query("acov_lags", f"WITH {EVENTS}, {_ACOV} SELECT sys, l::BIGINT AS lag, round(v, 6) + 0.0 AS acov FROM ac")
def acov_lags(spark, d):
    a = se.autocovariance(_events(spark, d))
    return a.select("sys", F.posexplode("acov").alias("lag", "acov")).select("sys", F.col("lag").cast("long").alias("lag"), r6(F.col("acov")).alias("acov"))


@query("acf_ar1", f"WITH {EVENTS}, {_ACOV}, {_AR1} SELECT sys, round(a, 6) + 0.0 AS a, round(CASE WHEN a = 0 THEN 0 ELSE 1 / ln(1 / a) END, 6) + 0.0 AS length FROM ar")
def acf_ar1(spark, d):
    a = se.autocovariance(_events(spark, d)).select("sys", se.ar1(F.col("acov")).alias("a"))
    return a.select("sys", r6(F.col("a")).alias("a"), r6(se.correlation_length(F.col("a"))).alias("length"))


@query("mean_with_conf", f"WITH {EVENTS}, {_ACOV}, {_AR1} SELECT sys, round(mu, 6) + 0.0 AS val, round(sqrt(v0 / n * (1 + 2.0 / n * ((n - 1) * a - n * a ** 2 + a ** (n + 1)) / (1 - a) ** 2)), 6) + 0.0 AS prec FROM ar")
def mean_with_conf(spark, d):
    return rounded(se.mean_with_confidence(_events(spark, d)), "val", "prec")


_DAILY = "s AS (SELECT o_orderpriority AS sys, row_number() OVER (PARTITION BY o_orderpriority ORDER BY day)::BIGINT AS k, y FROM (SELECT o_orderpriority, o_orderdate::DATE AS day, sum(o_totalprice) / 1000 AS y FROM orders GROUP BY 1, 2))"


@query("mean_with_conf_daily", f"WITH {_DAILY}, {_ACOV}, {_AR1} SELECT sys, round(mu, 4) + 0.0 AS val, round(sqrt(v0 / n * (1 + 2.0 / n * ((n - 1) * a - n * a ** 2 + a ** (n + 1)) / (1 - a) ** 2)), 4) + 0.0 AS prec FROM ar")
def mean_with_conf_daily(spark, d):
    from pyspark.sql import Window

    o = read(spark, d, "orders").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg((F.sum("o_totalprice") / 1000).alias("y"))
    s = o.select(F.col("o_orderpriority").alias("sys"), F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("day")).cast("long").alias("k"), "y")
    return rounded(se.mean_with_confidence(s), "val", "prec", places=4)


@query("rolling_window", f"WITH {EVENTS} SELECT sys, k, round(avg(y) OVER (PARTITION BY sys ORDER BY k ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) + 1e-9, 6) + 0.0 AS rolling, round(avg(y) OVER (PARTITION BY sys ORDER BY k ROWS UNBOUNDED PRECEDING) + 1e-9, 6) + 0.0 AS running FROM s")
def rolling_window(spark, d):
    r = se.rolling(_events(spark, d), 9)  # means of decimals fall on ties of the sixth place: both sides add a little
    return r.select("sys", "k", *[r6(F.col(c) + 1e-9).alias(c) for c in ("rolling", "running")])


@query("time_avg_burnin", f"WITH {EVENTS} SELECT sys, round(avg(y), 6) + 0.0 AS val, count(*)::BIGINT AS n FROM s WHERE k * 0.05 > 4 GROUP BY sys")
def time_avg_burnin(spark, d):
    return se.after_burn_in(_events(spark, d), 4.0, 0.05).groupBy("sys").agg(r6(F.avg("y")).alias("val"), F.count(F.lit(1)).alias("n"))


# --- rounding --------------------------------------------------------------------------------------------


@query("round2_cases", "SELECT p_partkey, CASE WHEN f <= 0 THEN round_even(p_retailprice * 10 ** (-f), 0) / 10 ** (-f) ELSE round_even(p_retailprice / 10 ** f, 0) * 10 ** f END AS y FROM (SELECT *, floor(log10(p_size * 0.37::DOUBLE)) AS f FROM part)")
def round2_cases(spark, d):
    """Prices to the order of a precision of their own."""
    return read(spark, d, "part").select("p_partkey", ro.round_to(F.col("p_retailprice"), F.col("p_size") * 0.37).alias("y"))


@query("round2sigfig_prices", "SELECT o_orderkey, CASE WHEN 2 - floor(log10(o_totalprice)) >= 0 THEN round_even(o_totalprice * 10 ** (2 - floor(log10(o_totalprice))), 0) / 10 ** (2 - floor(log10(o_totalprice))) ELSE round_even(o_totalprice / 10 ** (floor(log10(o_totalprice)) - 2), 0) * 10 ** (floor(log10(o_totalprice)) - 2) END AS price FROM orders WHERE o_totalprice > 0")
def round2sigfig_prices(spark, d):
    return read(spark, d, "orders").where("o_totalprice > 0").select("o_orderkey", ro.round_figures(F.col("o_totalprice"), 3).alias("price"))


# --- localization ----------------------------------------------------------------------------------------

_SITES = "pt AS (SELECT p_partkey AS id, (p_partkey * 7.31::DOUBLE) % 360 AS pos FROM part), st AS (SELECT s_suppkey AS id, (s_suppkey * 3.7::DOUBLE) % 360 AS pos FROM supplier), pr AS (SELECT pt.id AS p, st.id AS s, least(abs(pt.pos - st.pos), 360 - abs(pt.pos - st.pos)) AS dist FROM pt JOIN st ON least(abs(pt.pos - st.pos), 360 - abs(pt.pos - st.pos)) <= 9)"
_TAPERS = {
    "Gauss": "exp(-0.5 * (dist / 4) ** 2)",
    "Exp": "exp(-0.5 * (dist / 4) ** 3)",
    "Cubic": "CASE WHEN dist <= 7.48 THEN (1 - (dist / 7.48) ** 3) ** 3 ELSE 0 END",
    "Quadro": "CASE WHEN dist <= 6.56 THEN (1 - (dist / 6.56) ** 4) ** 4 ELSE 0 END",
    "GC": "CASE WHEN dist <= 7.28 THEN 1 - 5.0 / 3 * (dist / 7.28) ** 2 + 5.0 / 8 * (dist / 7.28) ** 3 + 0.5 * (dist / 7.28) ** 4 - 0.25 * (dist / 7.28) ** 5 WHEN dist <= 14.56 THEN 4 - 5 * dist / 7.28 + 5.0 / 3 * (dist / 7.28) ** 2 + 5.0 / 8 * (dist / 7.28) ** 3 - 0.5 * (dist / 7.28) ** 4 + (dist / 7.28) ** 5 / 12 - 2.0 / 3 / (dist / 7.28) ELSE 0 END",
    "Step": "CASE WHEN dist <= 4 THEN 1 ELSE 0 END",
}


def pairs_rounded(df, c):
    """``r6`` of a column that is not negative, in plain arithmetic: decimals of a row a pair are most of the work else."""
    return df.withColumn(c, F.floor(F.col(c) * 1e6 + 0.5) / 1e6)


def _sites(spark, d):
    pts = read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7.31 % 360).cast("double").alias("pos"))
    st = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 3.7 % 360).cast("double").alias("pos"))
    return pts, st


def _pairs(spark, d, reach=9.0):
    return lo.near_pairs(*_sites(spark, d), cell=0.9, reach=reach, period=360.0)


@query("pairwise_dist_periodic", f"WITH {_SITES} SELECT p, s, round(dist, 6) + 0.0 AS dist FROM pr")
def pairwise_dist_periodic(spark, d):
    return pairs_rounded(_pairs(spark, d), "dist")


def _taper(kind):
    sql = f"WITH {_SITES}, c AS (SELECT p, s, {_TAPERS[kind]} AS coeff FROM pr) SELECT p, s, round(coeff, 6) + 0.0 AS coeff FROM c WHERE coeff > 1e-3"

    @query(f"taper_{kind.lower()}", sql)
    def run(spark, d):
        reach = min(9.0, lo.felt(4.0, kind))
        return pairs_rounded(lo.local_observations(_pairs(spark, d, reach), 4.0, kind, reach=reach), "coeff")


for _kind in _TAPERS:
    _taper(_kind)


@query("local_obs_mean_dist", f"WITH {_SITES}, b AS (SELECT *, CASE WHEN p < (SELECT count(*) FROM part) % 7 * ((SELECT count(*) FROM part) // 7 + 1) THEN p // ((SELECT count(*) FROM part) // 7 + 1) ELSE (SELECT count(*) FROM part) % 7 + (p - (SELECT count(*) FROM part) % 7 * ((SELECT count(*) FROM part) // 7 + 1)) // ((SELECT count(*) FROM part) // 7) END AS batch FROM pr) SELECT batch::BIGINT AS batch, s, round(avg(dist), 6) + 0.0 AS dist, count(*)::BIGINT AS n FROM b GROUP BY batch, s")
def local_obs_mean_dist(spark, d):
    size = read(spark, d, "part").count()
    points, sites = _sites(spark, d)
    b = lo.near_sums(lo.batches(points, "id", size, 7), sites, 9.0, 360.0)
    return b.select("batch", "s", r6(F.col("total") / F.col("n")).alias("dist"), "n")


_REACH = "a.s_suppkey < b.s_suppkey AND sqrt((a.s_acctbal - b.s_acctbal) ** 2 + (a.s_suppkey - b.s_suppkey) ** 2) <= 300"


@query("pairwise_dist", f"SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(sqrt((a.s_acctbal - b.s_acctbal) ** 2 + (a.s_suppkey - b.s_suppkey) ** 2), 6) + 0.0 AS dist FROM supplier a JOIN supplier b ON {_REACH}")
def pairwise_dist(spark, d):
    """All pairs of suppliers that lie within a reach in two dimensions, by grid cell."""
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal"), F.col("s_suppkey").cast("double")).alias("pos"))
    j = lo.near_points(s, s, 2, cell=300.0, reach=300.0).where("p < s")
    return j.select(F.col("p").alias("a"), F.col("s").alias("b"), r6(F.col("dist")).alias("dist"))


_TORUS = "pt AS (SELECT p_partkey AS id, (p_partkey * 7.31::DOUBLE) % 360 AS x, (p_partkey * 3.17::DOUBLE) % 100 AS y FROM part), st AS (SELECT s_suppkey AS id, (s_suppkey * 3.7::DOUBLE) % 360 AS x, (s_suppkey * 13.3::DOUBLE) % 100 AS y FROM supplier), dd AS (SELECT pt.id AS p, st.id AS s, sqrt(least(abs(pt.x - st.x), 360 - abs(pt.x - st.x)) ** 2 + least(abs(pt.y - st.y), 100 - abs(pt.y - st.y)) ** 2) AS dist FROM pt, st)"


@query("pairwise_dist_torus", f"WITH {_TORUS} SELECT p, s, round(dist, 6) + 0.0 AS dist FROM dd WHERE dist <= 15")
def pairwise_dist_torus(spark, d):
    """Points and sites on a grid that is periodic both ways, within a reach."""
    pts = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array((F.col("p_partkey") * 7.31 % 360).cast("double"), (F.col("p_partkey") * 3.17 % 100).cast("double")).alias("pos"))
    st = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array((F.col("s_suppkey") * 3.7 % 360).cast("double"), (F.col("s_suppkey") * 13.3 % 100).cast("double")).alias("pos"))
    return pairs_rounded(lo.near_points(pts, st, 2, cell=5.0, reach=15.0, period=[360.0, 100.0]), "dist")


@query("taper_torus", f"WITH {_TORUS}, c AS (SELECT p, s, {_TAPERS['GC']} AS coeff FROM dd WHERE dist <= 15) SELECT p, s, round(coeff, 6) + 0.0 AS coeff FROM c WHERE coeff > 1e-3")
def taper_torus(spark, d):
    """Local observations of each point of a two-dimensional state."""
    pts = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array((F.col("p_partkey") * 7.31 % 360).cast("double"), (F.col("p_partkey") * 3.17 % 100).cast("double")).alias("pos"))
    st = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array((F.col("s_suppkey") * 3.7 % 360).cast("double"), (F.col("s_suppkey") * 13.3 % 100).cast("double")).alias("pos"))
    return pairs_rounded(lo.local_observations(lo.near_points(pts, st, 2, cell=5.0, reach=lo.felt(4.0, "GC"), period=[360.0, 100.0]), 4.0, "GC"), "coeff")


@query("no_localization", "SELECT 0::BIGINT AS batch, s_suppkey AS s, 1.0::DOUBLE AS coeff FROM supplier")
def no_localization(spark, d):
    return lo.no_localization(read(spark, d, "supplier").select(F.col("s_suppkey").alias("s")))


# --- particles -------------------------------------------------------------------------------------------

_PART = f"{EVENTS}, p AS (SELECT sys, k AS n, y, 1.0 / count(*) OVER (PARTITION BY sys) AS w0 FROM s), l AS (SELECT *, ln(w0) - 0.5 * ((y - 50) / 20) ** 2 AS lw FROM p), e AS (SELECT *, exp(lw - max(lw) OVER (PARTITION BY sys)) AS e FROM l), rw AS (SELECT sys, n, e / sum(e) OVER (PARTITION BY sys) AS w FROM e)"


def _particles(spark, d):
    s = _events(spark, d)
    p = s.join(s.groupBy("sys").agg((1 / F.count(F.lit(1))).alias("w")), "sys").withColumnRenamed("k", "n")
    return pa.reweight(p, -0.5 * ((F.col("y") - 50) / 20) ** 2).select("sys", "n", "w")


@query("pf_reweight", f"WITH {_PART} SELECT sys, n, round(w, 9) + 0.0 AS w FROM rw")
def pf_reweight(spark, d):
    return rounded(_particles(spark, d), "w", places=9)


@query("pf_neff", f"WITH {_PART} SELECT sys, round(1 / sum(w * w), 6) + 0.0 AS n_eff, count(*)::BIGINT AS size, 1 - max(w) < 1e-10 AS degenerate FROM rw GROUP BY sys")
def pf_neff(spark, d):
    return rounded(pa.effective_size(_particles(spark, d)), "n_eff")


@query("pf_temper", f"WITH {_PART}, t AS (SELECT *, least(w ** (1 / 2.0 - 1), 1e100) AS s0 FROM rw), u AS (SELECT *, s0 / sum(s0 * w) OVER (PARTITION BY sys) AS s FROM t) SELECT sys, n, round(ln(s), 6) + 0.0 AS log_s, round(s * w, 8) + 0.0 AS sw FROM u")
def pf_temper(spark, d):
    t = pa.tempered(_particles(spark, d), 2.0)
    return t.select("sys", "n", r6(F.log("s")).alias("log_s"), r6(F.col("sw"), 8).alias("sw"))  # s spans many orders


_SYS = f"{_PART}, c AS (SELECT sys, n, sum(w) OVER (PARTITION BY sys ORDER BY n ROWS UNBOUNDED PRECEDING) AS hi, count(*) OVER (PARTITION BY sys) AS size FROM rw), iv AS (SELECT sys, n, coalesce(lag(hi) OVER (PARTITION BY sys ORDER BY n), -1) AS lo, CASE WHEN n = size THEN 2 ELSE hi END AS hi FROM c), tooth AS (SELECT sys, (0.37 + t.j) / size AS u FROM (SELECT sys, size, unnest(range(size)) AS j FROM (SELECT DISTINCT sys, size FROM c)) t), cp AS (SELECT iv.sys, iv.n, count(tooth.u)::BIGINT AS copies FROM iv LEFT JOIN tooth ON tooth.sys = iv.sys AND tooth.u > iv.lo AND tooth.u <= iv.hi GROUP BY iv.sys, iv.n)"


@query("pf_resample_sys", f"WITH {_SYS} SELECT sys, n, copies FROM cp")
def pf_resample_sys(spark, d):
    return pa.systematic(_particles(spark, d), 0.37)


@query("pf_duplicates", f"WITH {_SYS} SELECT sys, n, c::BIGINT AS copy, copies > 1 AS again FROM (SELECT sys, n, copies, unnest(range(1, copies + 1)) AS c FROM cp)")
def pf_duplicates(spark, d):
    return pa.duplicates(pa.systematic(_particles(spark, d), 0.37))


@query("pf_resample_res", f"WITH {_PART}, z AS (SELECT sys, n, w * count(*) OVER (PARTITION BY sys) AS nw FROM rw) SELECT sys, n, floor(nw)::BIGINT AS copies, round((nw - floor(nw)) / sum(nw - floor(nw)) OVER (PARTITION BY sys), 9) + 0.0 AS rest FROM z")
def pf_resample_res(spark, d):
    return rounded(pa.residual(_particles(spark, d)), "rest", places=9)


# --- experiments -----------------------------------------------------------------------------------------

#: Orders as runs of experiments: coordinates from their attributes, the price as score, NaN for some runs.
_XPS = "x AS (SELECT o_orderkey AS seq, o_orderpriority AS da_method, o_orderstatus AS upd_a, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey % 5 END::BIGINT AS infl, (o_orderkey % 7)::BIGINT AS seed, CASE WHEN o_orderkey % 997 = 0 THEN 'NaN'::DOUBLE ELSE o_totalprice END AS val FROM orders)"


def _xps(spark, d):
    o = read(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("da_method"), F.col("o_orderstatus").alias("upd_a"),
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey") % 5).cast("long").alias("infl"), (F.col("o_orderkey") % 7).cast("long").alias("seed"),
        F.when(F.col("o_orderkey") % 997 == 0, float("nan")).otherwise(F.col("o_totalprice")).alias("val"),
    )


@query("grid_combinator", f"WITH {_XPS} SELECT da_method, upd_a, seed, infl, 8::BIGINT AS f FROM (SELECT DISTINCT da_method, upd_a FROM x) JOIN (SELECT DISTINCT da_method, upd_a, seed FROM x) USING (da_method, upd_a) JOIN (SELECT DISTINCT da_method, upd_a, infl FROM x WHERE infl IS NOT NULL) USING (da_method, upd_a)")
def grid_combinator(spark, d):
    """Of each method every combination of the values that its parameters have."""
    return xp.combined(_xps(spark, d), ["da_method", "upd_a"], ["seed", "infl"], {"f": 8}).withColumn("f", F.col("f").cast("long"))


@query("xp_prep_table", f"WITH {_XPS} SELECT 'da_method' AS \"column\", CASE WHEN min(da_method) <> max(da_method) THEN 'distinct' WHEN count(da_method) = count(*) THEN 'common' ELSE 'redundant' END AS kind FROM x WHERE infl IS NULL OR infl = 2 UNION ALL SELECT 'infl', CASE WHEN min(infl) <> max(infl) THEN 'distinct' WHEN count(infl) = count(*) THEN 'common' ELSE 'redundant' END FROM x WHERE infl IS NULL OR infl = 2 UNION ALL SELECT 'seed', 'distinct'")
def xp_prep_table(spark, d):
    return xp.classify(_xps(spark, d).where("infl is null or infl = 2"), ["da_method", "infl", "seed"], nomerge=("seed",))


@query("xp_subspace", f"WITH {_XPS} SELECT seq, da_method, seed, val FROM x WHERE infl IS NULL AND upd_a = 'F' AND NOT isnan(val)")
def xp_subspace(spark, d):
    return xp.subspace(_xps(spark, d), infl=None, upd_a="F").where(~F.isnan("val"))


@query("xp_inds_loose", f"WITH {_XPS} SELECT count(*)::BIGINT AS n, count(infl)::BIGINT AS set FROM x WHERE infl IS NULL OR infl = 3")
def xp_inds_loose(spark, d):
    return xp.matching(_xps(spark, d), strict=False, infl=3).agg(F.count(F.lit(1)).alias("n"), F.count("infl").alias("set"))


@query("xp_nest", f"WITH {_XPS}, c AS (SELECT da_method, seed, infl, count(*)::BIGINT AS size FROM x GROUP BY da_method, seed, infl) SELECT da_method, seed, infl, size, count(*) OVER (PARTITION BY da_method)::BIGINT AS cells FROM c")
def xp_nest(spark, d):
    """The inner coordinates of each outer one, as rows."""
    return xp.nest(_xps(spark, d), ["da_method"], ["seed", "infl"])


_MEAN = f"WITH {_XPS}, g AS (SELECT da_method, upd_a, infl, count(*)::BIGINT AS n_total, sum(CASE WHEN isnan(val) THEN 1 ELSE 0 END)::BIGINT AS n_fail, avg(CASE WHEN isnan(val) THEN 0 ELSE val END) AS m, var_samp(CASE WHEN isnan(val) THEN 0 ELSE val END) AS v FROM x GROUP BY da_method, upd_a, infl)"


@query("xp_mean", f"{_MEAN} SELECT da_method, upd_a, infl, CASE WHEN n_fail > 0 THEN -1 ELSE round(m, 3) END AS val, CASE WHEN n_fail > 0 THEN -1 ELSE round(sqrt(v / n_total), 3) END AS prec, n_total, n_fail, n_total - n_fail AS n_success FROM g")
def xp_mean(spark, d):
    """Mean over seeds; a NaN run makes a NaN mean, shown as -1 because the check compares numbers."""
    m = xp.mean_over(_xps(spark, d), ["da_method", "upd_a", "infl"])
    return m.withColumns({c: F.when(F.col("n_fail") > 0, -1.0).otherwise(F.round(c, 3)) for c in ("val", "prec")})


def _tune(name, sign):
    sql = f"WITH {_XPS}, r AS (SELECT *, row_number() OVER (PARTITION BY da_method, seed ORDER BY isnan(val), {sign}val, seq DESC) AS r FROM x) SELECT da_method, seed, CASE WHEN NOT isnan(val) THEN infl END AS infl, CASE WHEN NOT isnan(val) THEN upd_a END AS upd_a, val FROM r WHERE r = 1"

    @query(name, sql)
    def run(spark, d):
        return xp.tune(_xps(spark, d), ["da_method", "seed"], ["infl", "upd_a"], decreasing=not sign)


_tune("xp_tune", "")
_tune("xp_tune_increasing", "-")


@query("xp_pivot", f"WITH {_XPS} SELECT da_method, round(avg(CASE WHEN upd_a = 'F' THEN val END), 3) AS \"F\", round(avg(CASE WHEN upd_a = 'O' THEN val END), 3) AS \"O\", round(avg(CASE WHEN upd_a = 'P' THEN val END), 3) AS \"P\" FROM x WHERE NOT isnan(val) GROUP BY da_method")
def xp_pivot(spark, d):
    m = xp.mean_over(_xps(spark, d).where(~F.isnan("val")), ["da_method", "upd_a"])
    return rounded(xp.table(m, ["da_method"], "upd_a", ["F", "O", "P"]), "F", "O", "P", places=3)


@query("xp_xsection", f"WITH {_XPS}, u AS (SELECT seq, da_method, infl, NULL AS section FROM x UNION ALL SELECT seq, da_method, NULL, 'tuned' FROM x WHERE infl = 2) SELECT section, da_method, count(*)::BIGINT AS n, count(infl)::BIGINT AS set FROM u GROUP BY section, da_method")
def xp_xsection(spark, d):
    u = xp.with_section(_xps(spark, d), "tuned", F.col("infl") == 2, ["infl"])
    return u.groupBy("section", "da_method").agg(F.count(F.lit(1)).alias("n"), F.count("infl").alias("set"))


@query("xp_ticks", f"WITH {_XPS} SELECT infl AS tick, row_number() OVER (ORDER BY infl NULLS LAST)::BIGINT AS place FROM (SELECT DISTINCT infl FROM x)")
def xp_ticks(spark, d):
    return xp.ticks(_xps(spark, d), "infl")


@query("xp_union_unique", f"WITH {_XPS} SELECT DISTINCT da_method, infl, NULL::BIGINT AS seed FROM x UNION SELECT DISTINCT da_method, NULL, seed FROM x")
def xp_union_unique(spark, d):
    x = _xps(spark, d)
    return xp.union_unique(x.select("da_method", "infl"), x.select("da_method", "seed")).select("da_method", "infl", "seed")


@query("xp_names", f"WITH {_XPS} SELECT DISTINCT concat_ws(' ', da_method, 'upd_a:' || upd_a, 'infl:' || infl) AS name FROM x")
def xp_names(spark, d):
    return xp.names(_xps(spark, d), ["upd_a", "infl"]).select("name").distinct()


@query("xp_table_tree", f"{_MEAN}, ok AS (SELECT *, row_number() OVER (PARTITION BY da_method, upd_a ORDER BY n_fail > 0, m, infl DESC NULLS LAST) AS r FROM g) SELECT da_method, upd_a, CASE WHEN n_fail = 0 THEN infl END AS infl, CASE WHEN n_fail > 0 THEN -1 ELSE round(m, 3) END AS val FROM ok WHERE r = 1")
def xp_table_tree(spark, d):
    """Mean over seeds, then the best inflation per row."""
    m = xp.mean_over(_xps(spark, d), ["da_method", "upd_a", "infl"])
    t = xp.tune(m, ["da_method", "upd_a"], ["infl"], order="infl")
    return t.withColumn("val", F.when(F.isnan("val"), -1.0).otherwise(F.round("val", 3)))


# --- assimilation ----------------------------------------------------------------------------------------


@query("climatology", f"WITH {EVENTS} SELECT sys, round(avg(y), 6) + 0.0 AS mu, round(var_samp(y), 6) + 0.0 AS var FROM s GROUP BY sys")
def climatology(spark, d):
    return rounded(filters.climatology(_events(spark, d)), "mu", "var")


@query("persistence", f"WITH {EVENTS}, f AS (SELECT sys, k, y, lag(y) OVER (PARTITION BY sys ORDER BY k) AS f FROM s) SELECT sys, round(sqrt(avg((y - f) ** 2)), 6) + 0.0 AS rmse, count(f)::BIGINT AS n FROM f GROUP BY sys")
def persistence(spark, d):
    p = filters.persistence(_events(spark, d))
    return p.groupBy("sys").agg(r6(F.sqrt(F.avg((F.col("y") - F.col("forecast")) ** 2))).alias("rmse"), F.count("forecast").alias("n"))


@query("previous_obs", f"WITH {EVENTS} SELECT a.sys, a.k, b.y AS forecast FROM s a LEFT JOIN s b ON b.sys = a.sys AND b.k % 5 = 0 AND b.k = ((a.k - 1) // 5) * 5 AND b.k > 0")
def previous_obs(spark, d):
    return filters.previous_observation(_events(spark, d), 5).select("sys", "k", "forecast")


def _interpolation(name, scale):
    @query(name, f"WITH {EVENTS}, c AS (SELECT sys, avg(y) AS mu, {scale} * var_samp(y) AS b FROM s GROUP BY sys) SELECT sys, k, round(mu + b / (b + 50.0) * (y - mu), 6) + 0.0 AS analysis FROM s JOIN c USING (sys)")
    def run(spark, d):
        return rounded(filters.optimal_interpolation(_events(spark, d), 50.0, scale).select("sys", "k", "analysis"), "analysis")


_interpolation("optinterp_scalar", 1.0)
_interpolation("var3d_scalar", 0.1)

_KF = f"WITH RECURSIVE {EVENTS}, kf(sys, k, fc, pf, m, p) AS (SELECT sys, k, y, 50.0::DOUBLE, y, 50.0::DOUBLE FROM s WHERE k = 1 UNION ALL SELECT sys, k, fc, pf, fc + pf / (pf + 50.0) * (y - fc), (1 - pf / (pf + 50.0)) * pf FROM (SELECT s.sys, s.k, 0.98 * kf.m AS fc, 0.98 * 0.98 * kf.p + 5.0 AS pf, s.y FROM kf JOIN s ON s.sys = kf.sys AND s.k = kf.k + 1))"


@query("kf_scalar", f"{_KF} SELECT sys, k, round(fc, 6) + 0.0 AS forecast, round(m, 6) + 0.0 AS mean, round(p, 6) + 0.0 AS var FROM kf")
def kf_scalar(spark, d):
    return rounded(filters.kalman(_events(spark, d), 0.98, 5.0, 50.0).select("sys", "k", "forecast", "mean", "var"), "forecast", "mean", "var")


@query("kf_smoother_scalar", f"{_KF}, top AS (SELECT sys, max(k) AS last FROM kf GROUP BY sys), sm(sys, k, z) AS (SELECT kf.sys, kf.k, m FROM kf JOIN top ON top.sys = kf.sys AND top.last = kf.k UNION ALL SELECT a.sys, a.k, a.m + a.p * 0.98 / b.pf * (sm.z - b.fc) FROM sm JOIN kf a ON a.sys = sm.sys AND a.k = sm.k - 1 JOIN kf b ON b.sys = sm.sys AND b.k = sm.k) SELECT sys, k, round(z, 6) + 0.0 AS smoothed FROM sm")
def kf_smoother_scalar(spark, d):
    return rounded(filters.kalman(_events(spark, d), 0.98, 5.0, 50.0, smooth=True).select("sys", "k", "smoothed"), "smoothed")


def _update(name, flavour, part):
    sql = f"WITH {ENS}, a AS (SELECT *, avg(x) OVER (PARTITION BY ens, i) AS mu, x - avg(x) OVER (PARTITION BY ens, i) AS a FROM ens), y AS (SELECT ens, n, a AS ya, mu AS ym FROM a WHERE i = 3), c AS (SELECT a.ens, a.i, sum(a.a * y.ya) / (count(*) - 1) AS c FROM a JOIN y USING (ens, n) GROUP BY a.ens, a.i), v AS (SELECT ens, c AS v FROM c WHERE i = 3) SELECT a.ens, a.n, a.i, round(a.x + c.c / (v.v + 0.02) * (0.1 - y.ym) - {part} * c.c / (v.v + 0.02) * y.ya, 6) + 0.0 AS x FROM a JOIN y USING (ens, n) JOIN c USING (ens, i) JOIN v USING (ens)"

    @query(name, sql)
    def run(spark, d):
        return rounded(filters.scalar_update(_ens(spark, d), 3, 0.1, 0.02, flavour), "x")


_update("enkf_denkf_scalar", "DEnKF", "0.5")
_update("enkf_serial_scalar", "Serial", "1 / (1 + sqrt(0.02 / (v.v + 0.02)))")


# --- streams ---------------------------------------------------------------------------------------------


def _stream(spark, d):
    from twinlake.streaming.online import event_stream

    return event_stream(spark, d).select(F.col("event_type").alias("sys"), "ts", "event_id", F.col("value").alias("y"))


def _shared(spark, name):
    """A new path in the folder that driver and executors share; a temporary one where all is one machine."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp()
    return f"{root}/{name}-{uuid.uuid4().hex}"


@query("stream_kf", f"{_KF} SELECT sys, count(*)::BIGINT AS n, round(sum(m), 4) + 0.0 AS total, round(min(p), 6) + 0.0 AS var FROM kf GROUP BY sys")
def stream_kf(spark, d):
    """The Kalman filter of ``kf_scalar`` online, its state kept by system."""
    from twinlake.streaming.online import drained, online_kalman

    out = drained(online_kalman(_stream(spark, d), 0.98, 5.0, 50.0), _shared(spark, "stream-kf"))
    return out.groupBy("sys").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("mean"), 4).alias("total"), r6(F.min("var")).alias("var"))


@query("stream_window", "SELECT event_type AS sys, count(*)::BIGINT AS n, round(sum(value), 4) + 0.0 AS total, count(DISTINCT time_bucket(INTERVAL '1 hour', ts))::BIGINT AS windows FROM events WHERE time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) GROUP BY event_type")
def stream_window(spark, d):
    """Hourly windows by system, those that the watermark has closed."""
    from twinlake.streaming.online import drained, windowed

    w = drained(windowed(_stream(spark, d), "1 hour", "0 seconds"), _shared(spark, "stream-window"))
    return w.groupBy("sys").agg(F.sum("n").alias("n"), r6(F.sum(F.col("n") * F.col("mean")), 4).alias("total"), F.count(F.lit(1)).alias("windows"))

"""Registered queries: sampling, selection, printed and plotted tables, schedules, regressions, likelihoods, grids."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from twinlake.functions import draws
from twinlake.functions import observation as ob
from twinlake.functions import series as se
from twinlake.operators import experiments as xp
from twinlake.operators import localization as lo
from twinlake.operators import particle as pa
from twinlake.plans import filters
from twinlake.plans.catalog import _XPS, ENS, EVENTS, TRUTH, _ens, _events, _shared, _truth, _xps, pairs_rounded, r6, rounded
from twinlake.plans.registry import query
from twinlake.sources import runs
from twinlake.sources.tables import read

GOLD = 0.6180339887498949

# --- draws -----------------------------------------------------------------------------------------------

_FILE = f"p AS (SELECT c_mktsegment AS sys, c_custkey AS n, (c_acctbal + 1000) / sum(c_acctbal + 1000) OVER (PARTITION BY c_mktsegment) AS w FROM customer), cu AS (SELECT *, sum(w) OVER (PARTITION BY sys ORDER BY n ROWS UNBOUNDED PRECEDING) AS hi, row_number() OVER (PARTITION BY sys ORDER BY n DESC) AS last FROM p), iv AS (SELECT sys, n, coalesce(lag(hi) OVER (PARTITION BY sys ORDER BY n), 0) AS lo, CASE WHEN last = 1 THEN 2 ELSE hi END AS hi FROM cu), dr AS (SELECT sys, (n * {GOLD}::DOUBLE) % 1 AS u FROM p)"


@query("rv_file", f"WITH {_FILE} SELECT iv.sys, iv.n, count(dr.u)::BIGINT AS copies FROM iv LEFT JOIN dr ON dr.sys = iv.sys AND dr.u >= iv.lo AND dr.u < iv.hi GROUP BY iv.sys, iv.n")
def rv_file(spark, d):
    """Draws from the rows of a table in proportion to a weight of theirs."""
    c = read(spark, d, "customer").select(F.col("c_mktsegment").alias("sys"), F.col("c_custkey").alias("n"), (F.col("c_acctbal") + 1000).alias("w"))
    total = c.groupBy("sys").agg(F.sum("w").alias("t"))
    p = c.join(total, "sys").select("sys", "n", (F.col("w") / F.col("t")).alias("w"))
    return pa.multinomial(p, p.select("sys", (F.col("n") * GOLD % 1).alias("u")))


@query("rv_coloured", "SELECT p_partkey AS n, round(1 + 2 * sin(p_partkey * 1.7), 6) + 0.0 AS x0, round(-1 + 0.5 * sin(p_partkey * 1.7) + sqrt(0.75) * sin(p_partkey * 2.9 + 1), 6) + 0.0 AS x1 FROM part")
def rv_coloured(spark, d):
    """Draws with a full covariance; here the standard draws are waves, so that SQL has the same."""
    wave = [F.sin(F.col("n") * 1.7), F.sin(F.col("n") * 2.9 + 1)]
    x = draws.coloured(lambda j: wave[j], [1.0, -1.0], [[4.0, 1.0], [1.0, 1.0]])
    return read(spark, d, "part").select(F.col("p_partkey").alias("n")).select("n", *[r6(c).alias(f"x{i}") for i, c in enumerate(x)])


@query("rv_dispatch", f"SELECT p_partkey AS n, round(-ln(1 - (p_partkey * {GOLD}::DOUBLE) % 1), 6) + 0.0 AS exponential, CASE WHEN (p_partkey * {GOLD}::DOUBLE) % 1 < 0.2 THEN 'a' WHEN (p_partkey * {GOLD}::DOUBLE) % 1 < 0.7 THEN 'b' ELSE 'c' END AS kind FROM part")
def rv_dispatch(spark, d):
    """Draws by an inverse distribution function and by a table of running probabilities."""
    u = F.col("p_partkey") * GOLD % 1
    return read(spark, d, "part").select(F.col("p_partkey").alias("n"), r6(draws.sampled(u, "icdf", icdf=lambda v: -F.log(1 - v))).alias("exponential"), draws.sampled(u, "cdf", values=["a", "b", "c"], cdf=[0.2, 0.7, 1.0]).alias("kind"))


@query("pf_laplace", f"WITH {EVENTS}, l AS (SELECT sys, k AS n, -sqrt(2) * abs(y - 50) / 20 AS lw FROM s), e AS (SELECT *, exp(lw - max(lw) OVER (PARTITION BY sys)) AS e FROM l) SELECT sys, n, round(e / sum(e) OVER (PARTITION BY sys), 9) + 0.0 AS w FROM e")
def pf_laplace(spark, d):
    """Weights by a Laplace likelihood, in logs."""
    s = _events(spark, d)
    p = s.join(s.groupBy("sys").agg((1 / F.count(F.lit(1))).alias("w")), "sys").withColumnRenamed("k", "n")
    return rounded(pa.reweight(p, pa.laplace_loglik(F.col("y") - 50, 20.0)).select("sys", "n", "w"), "w", places=9)


# --- observation -----------------------------------------------------------------------------------------


@query("obs_track", f"WITH {ENS} SELECT e.ens, e.n, t.j::BIGINT AS j, e.x AS y FROM ens e JOIN range(0, 8) t(j) ON e.i = (t.j * 8 + floor(10 * ((e.n * {GOLD}::DOUBLE) % 1))::BIGINT) % 64")
def obs_track(spark, d):
    """A track of sites moved along by an offset that depends on the observation time alone (the member stands for it)."""
    sites = ob.even_sites(spark, 64, 8)
    return ob.tracked(_ens(spark, d), sites, F.floor(10 * (F.col("n") * GOLD % 1)).cast("long"), 64)


@query("subsample_alignment", f"WITH {EVENTS} SELECT m.sys, m.k, m.y AS model, t.y AS truth FROM s m JOIN s t ON t.sys = m.sys AND t.k = 2 * m.k")
def subsample_alignment(spark, d):
    """A model whose step is twice that of the truth: step k goes with the truth's step 2 k."""
    s = _events(spark, d)
    t = s.where("k % 2 = 0").select("sys", (F.col("k") / 2).cast("long").alias("k"), F.col("y").alias("truth"))
    return s.withColumnRenamed("y", "model").join(t, ["sys", "k"])


@query("nd_id_localization", "WITH n AS (SELECT max(p_partkey) // 40 + 1 AS h FROM part), g AS (SELECT p_partkey AS i, p_partkey // 40 AS y, p_partkey % 40 AS x, h FROM part, n), o AS (SELECT * FROM g WHERE i % 4 = 0), dd AS (SELECT g.i AS p, o.i AS s, sqrt(least(abs(g.y - o.y), g.h - abs(g.y - o.y)) ** 2 + least(abs(g.x - o.x), 40 - abs(g.x - o.x)) ** 2) AS dist FROM g, o), c AS (SELECT p, s, CASE WHEN dist <= 3.28 THEN (1 - (dist / 3.28) ** 4) ** 4 ELSE 0 END AS coeff FROM dd) SELECT p, s, round(coeff, 6) + 0.0 AS coeff FROM c WHERE coeff > 1e-3")
def nd_id_localization(spark, d):
    """Parts as points of a periodic grid, every fourth observed: which of them inform each point, and how much."""
    points = read(spark, d, "part").select(F.col("p_partkey").alias("i"))
    high = points.agg(F.floor(F.max("i") / 40) + 1).first()[0]
    return pairs_rounded(lo.direct_localization(points, [high, 40], F.col("i") % 4 == 0, 2.0, "Quadro"), "coeff")


# --- series ----------------------------------------------------------------------------------------------


@query("preprog_schedule", f"WITH {EVENTS}, c AS (SELECT r.i AS slot, 10.0 * r.i + 5 AS mu FROM range(0, 7) r(i)) SELECT s.sys, s.k, c.mu, round(c.mu - s.y, 6) + 0.0 AS err FROM s JOIN c ON c.slot = s.k % 7")
def preprog_schedule(spark, d):
    """Estimates that a schedule gives beforehand."""
    plan = spark.range(7).select(F.col("id").alias("slot"), (10.0 * F.col("id") + 5).alias("mu"))
    return filters.scheduled(_events(spark, d), plan, F.col("k") % 7).select("sys", "k", "mu", r6(F.col("mu") - F.col("y")).alias("err"))


_TEND = f"{EVENTS}, t AS (SELECT a.sys, a.y / 100 AS x, (b.y - a.y) / 100 AS z FROM s a JOIN s b ON b.sys = a.sys AND b.k = a.k + 1), m AS (SELECT sys, count(*)::DOUBLE AS n, sum(x) AS s1, sum(x ** 2) AS s2, sum(x ** 3) AS s3, sum(x ** 4) AS s4, sum(z) AS t0, sum(x * z) AS t1, sum(x * x * z) AS t2 FROM t GROUP BY sys)"
_DET2 = "(n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))"


@query("tendency_regression", f"WITH {_TEND} SELECT sys, 0 AS degree, round(t0 / n, 5) + 0.0 AS c0, NULL::DOUBLE AS c1, NULL::DOUBLE AS c2 FROM m UNION ALL SELECT sys, 1, round((t0 * s2 - s1 * t1) / (n * s2 - s1 * s1), 5) + 0.0, round((n * t1 - s1 * t0) / (n * s2 - s1 * s1), 5) + 0.0, NULL FROM m UNION ALL SELECT sys, 2, round((t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / {_DET2}, 5) + 0.0, round((n * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / {_DET2}, 5) + 0.0, round((n * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / {_DET2}, 5) + 0.0 FROM m")
def tendency_regression(spark, d):
    """Polynomials of several degrees for the change of a series, from sums of powers: one pass, and a small system a series."""
    f = se.polynomials(filters.persistence(_events(spark, d)).where("forecast is not null"), F.col("forecast") / 100, (F.col("y") - F.col("forecast")) / 100, [0, 1, 2])
    return f.select("sys", "degree", *[r6(F.get("coefficients", j), 5).alias(f"c{j}") for j in range(3)])


@query("ext_spectra", f"WITH {ENS}, {TRUTH}, m AS (SELECT ens, i, avg(x) AS mu, var_samp(x) AS v FROM ens GROUP BY ens, i) SELECT ens, (row_number() OVER (PARTITION BY ens ORDER BY round(v, 9) DESC, i) - 1)::BIGINT AS s, round(sqrt(v), 6) + 0.0 AS sval, round(mu - truth, 6) + 0.0 AS umisf FROM m JOIN truth USING (i)")
def ext_spectra(spark, d):
    """Singular values and misfits of an estimate with a diagonal covariance: its directions are the coordinates, in order."""
    from twinlake.operators.assimilation import diagonal_spectra

    e = _ens(spark, d)
    m = e.groupBy("ens", "i").agg(F.avg("x").alias("mu"), F.var_samp("x").alias("var"))
    return rounded(diagonal_spectra(m, _truth(e)), "sval", "umisf")


@query("zeta_a", f"WITH {ENS}, {TRUTH}, a AS (SELECT ens, sum((x - mu) ** 2) / 0.02 AS s, any_value((truth - mu) ** 2) / 0.02 AS dy2, count(*)::DOUBLE AS n FROM (SELECT *, avg(x) OVER (PARTITION BY ens) AS mu FROM ens WHERE i = 0) JOIN truth USING (i) GROUP BY ens), w AS (SELECT *, s * dy2 / (n - 1 + s) ** 2 AS ww FROM a) SELECT ens, round((n - 1) * (n / (n - 1)) / ((n + 1) / n + ww), 6) + 0.0 AS zeta FROM w")
def zeta_a(spark, d):
    """The weight of the prior's precision that a finite ensemble leaves, from the size of the mean's weights."""
    from twinlake.operators.assimilation import mean_weight, zeta

    e = _ens(spark, d)
    w = mean_weight(e, 0, _truth(e).where("i = 0").select(F.col("truth").alias("y")), 0.02)
    return w.select("ens", r6(zeta(F.col("size"), F.col("ww"))).alias("zeta"))


# --- experiments -----------------------------------------------------------------------------------------

_BEST = f"{_XPS}, g AS (SELECT da_method, upd_a, infl, avg(val) AS m, sqrt(var_samp(val) / count(*)) AS prec, sum(CASE WHEN isnan(val) THEN 1 ELSE 0 END)::BIGINT AS n_fail, count(*)::BIGINT AS n FROM x GROUP BY da_method, upd_a, infl), b AS (SELECT *, row_number() OVER (PARTITION BY da_method, upd_a ORDER BY isnan(m), m, infl NULLS FIRST) AS r FROM g)"


@query("xp_print", f"WITH {_BEST} SELECT da_method, upd_a, infl, CASE WHEN isnan(m) THEN NULL ELSE round(m, 3) END AS val, n_fail, n - n_fail AS n_success FROM b WHERE r = 1")
def xp_print(spark, d):
    """The data of a printed table: means over seeds, at the best inflation of each row, with failures."""
    t = xp.printed(_xps(spark, d), ["da_method"], ["upd_a"], ["seed"], ["infl"])
    return t.select("da_method", "upd_a", "infl", F.when(~F.isnan("val"), F.round("val", 3)).alias("val"), "n_fail", "n_success")


@query("xp_plot", f"WITH {_XPS}, g AS (SELECT da_method, upd_a, infl, avg(val) AS m FROM x GROUP BY da_method, upd_a, infl), t AS (SELECT infl, row_number() OVER (ORDER BY infl NULLS LAST)::BIGINT AS place FROM (SELECT DISTINCT infl FROM x)) SELECT g.da_method, g.upd_a, g.infl, t.place, CASE WHEN isnan(m) THEN NULL ELSE round(m, 3) END AS val FROM g JOIN t ON g.infl IS NOT DISTINCT FROM t.infl")
def xp_plot(spark, d):
    """The data of a plot: a panel a method, a line an update, a point an inflation."""
    t = xp.plotted(_xps(spark, d), ["da_method"], ["upd_a"], "infl", ["seed"])
    return t.select("da_method", "upd_a", "infl", "place", F.when(~F.isnan("val"), F.round("val", 3)).alias("val"))


@query("xp_slice", f"WITH {_XPS} (SELECT 'slice' AS part, seq FROM x ORDER BY seq LIMIT 5 OFFSET 10) UNION ALL (SELECT 'one', seq FROM x ORDER BY seq LIMIT 1 OFFSET 3) UNION ALL SELECT 'list', seq FROM (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS k FROM x) WHERE k IN (2, 7) UNION ALL SELECT 'step', seq FROM (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS k FROM x) WHERE k IN (0, 3, 6)")
def xp_slice(spark, d):
    """Experiments by their place in the list."""
    x = _xps(spark, d)
    parts = {"slice": slice(10, 15), "one": 3, "list": [2, 7], "step": slice(0, 9, 3)}
    out = [xp.at(x, p).select(F.lit(n).alias("part"), "seq") for n, p in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("xp_columns", "SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders")
def xp_columns(spark, d):
    """Columns by name, by expression and by test, and without others: nothing else is read."""
    o = xp.intersect(read(spark, d, "orders"), "o_orderkey", re.compile("^o_order"), lambda c: c.endswith("price"))
    return xp.complement(o, "o_totalprice", re.compile("priority$"))


@query("xp_error_column", f"WITH {_XPS} SELECT seq, CASE WHEN isnan(val) THEN 'finite' WHEN infl IS NULL THEN 'inflation' WHEN val >= 400000 THEN 'bounded' END AS error, isnan(val) OR infl IS NULL OR val >= 400000 AS crashed FROM x")
def xp_error_column(spark, d):
    """Failures as a column of the results; the others go on."""
    checks = {"finite": ~F.isnan("val"), "inflation": F.col("infl") > 0, "bounded": F.col("val") < 400000}
    return xp.guarded(_xps(spark, d), checks).select("seq", "error", "crashed")


@query("xp_put", f"WITH {_XPS}, n AS (SELECT da_method, upd_a, infl, max(val) AS val FROM x WHERE seed = 1 AND NOT isnan(val) GROUP BY da_method, upd_a, infl), o AS (SELECT da_method, upd_a, infl, min(val) AS val FROM x WHERE NOT isnan(val) GROUP BY da_method, upd_a, infl) SELECT * FROM n UNION ALL SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.da_method = o.da_method AND n.upd_a = o.upd_a AND n.infl IS NOT DISTINCT FROM o.infl)")
def xp_put(spark, d):
    """Values set at coordinates of a sparse space, where nulls are equal."""
    x = _xps(spark, d).where(~F.isnan("val"))
    dims = ["da_method", "upd_a", "infl"]
    return xp.put(x.groupBy(dims).agg(F.min("val").alias("val")), x.where("seed = 1").groupBy(dims).agg(F.max("val").alias("val")), dims)


@query("runs_overwritten", f"WITH {_XPS} SELECT seq AS xp_id, 2 * val AS val FROM x WHERE NOT isnan(val)")
def runs_overwritten(spark, d):
    """A run replaced by what is made of it; the folders of jobs are told by their numbers."""
    root = _shared(spark, "runs")
    x = _xps(spark, d).where(~F.isnan("val")).select(F.col("seq").alias("xp_id"), "val")
    for job in (10, 2):
        runs.save_run(x, f"{root}/{job}", "sweep", 1)
    assert runs.job_folders(spark, root) == [2, 10]
    run = runs.load_run(spark, f"{root}/2", "sweep")
    runs.overwritten(spark, run.withColumn("val", 2 * F.col("val")), f"{root}/2", "sweep", 1)
    return runs.load_run(spark, f"{root}/2", "sweep")

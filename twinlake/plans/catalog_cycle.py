"""Registered queries of the assimilation cycle: phases and time averages, updates by several observations, draws of particles."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlake.functions import statistics as st
from twinlake.operators import assimilation as da
from twinlake.operators import particle as pa
from twinlake.plans import filters
from twinlake.plans.catalog import _ACOV, _AR1, _PART, ENS, EVENTS, _ens, _events, _particles, r6, rounded
from twinlake.plans.registry import query

# --- phases ----------------------------------------------------------------------------------------------

EVERY, DT, BURN_IN = 5, 0.05, 4.0
#: The last observation is the forecast, four fifths of the way from it to the present one the analysis.
_STEPS = EVENTS.replace("s AS (", "ev AS (", 1) + """, fc AS (SELECT a.sys, a.k, a.y, b.y AS f FROM ev a JOIN ev b ON b.sys = a.sys AND b.k = ((a.k - 1) // 5) * 5 AND b.k > 0),
ph AS (SELECT sys, k, CASE WHEN k % 5 = 0 THEN k // 5 - 1 END AS ko, 'i' AS sub, CASE WHEN k % 5 = 0 THEN f + 0.8 * (y - f) ELSE f END AS mu, CASE WHEN k % 5 = 0 THEN 80.0 ELSE 400.0 END AS var, y FROM fc
UNION ALL SELECT sys, k, k // 5 - 1, 'f', f, 400.0, y FROM fc WHERE k % 5 = 0 UNION ALL SELECT sys, k, k // 5 - 1, 'a', f + 0.8 * (y - f), 80.0, y FROM fc WHERE k % 5 = 0)"""


def _estimates(spark, d):
    s = filters.previous_observation(_events(spark, d), EVERY)
    s = s.withColumns({"mean": F.col("forecast") + 0.8 * (F.col("y") - F.col("forecast")), "forecast_var": F.lit(400.0), "var": F.lit(80.0)})
    return st.phases(s, EVERY), s.select("sys", "k", F.col("y").alias("x"))


@query("assess_phases", f"WITH {_STEPS} SELECT sys, k, ko::BIGINT AS ko, sub, round(mu - y, 6) + 0.0 AS err, round(abs(mu - y), 6) + 0.0 AS rms, round(sqrt(var), 6) AS spread, round(sqrt(var) * 0.7978845608028654, 6) AS mad, round(2 * ln(sqrt(var)) + ((mu - y) / sqrt(var)) ** 2, 6) + 0.0 AS gscore FROM ph")
def assess_phases(spark, d):
    """Statistics of every step by phase: forecast and analysis at observation times, one estimate at every step."""
    wanted = ["err", "rms", "spread", "mad", "gscore"]
    s = st.assess(*_estimates(spark, d))
    return rounded(s.groupBy("sys", "k", "ko", "sub").pivot("stat", wanted).agg(F.first("value")), *wanted)


_PHASE_SERIES = "s AS (SELECT sys || ':' || sub AS sys, CASE WHEN sub = 'i' THEN k ELSE ko END AS k, abs(mu - y) AS y FROM ph WHERE k * 0.05 > 4)"


@query("average_in_time", f"WITH {_STEPS}, {_PHASE_SERIES}, {_ACOV}, {_AR1} SELECT split_part(sys, ':', 1) AS sys, split_part(sys, ':', 2) AS sub, round(mu, 6) + 0.0 AS val, round(sqrt(v0 / n * (1 + 2.0 / n * ((n - 1) * a - n * a ** 2 + a ** (n + 1)) / (1 - a) ** 2)), 6) + 0.0 AS prec FROM ar")
def average_in_time(spark, d):
    """The root mean square error of each phase, averaged over time after burn-in, with its precision."""
    s = st.assess(*_estimates(spark, d)).where("stat = 'rms'")
    return rounded(st.average_in_time(s, BURN_IN, DT, EVERY).select("sys", "sub", "val", "prec"), "val", "prec")


@query("average_unfinished", f"WITH {_STEPS} SELECT sys, sub, CASE WHEN sys = 'click' THEN NULL ELSE round(avg(abs(mu - y)), 6) + 0.0 END AS val FROM ph WHERE k * 0.05 > 4 AND NOT (sys = 'view' AND sub = 'a') GROUP BY sys, sub")
def average_unfinished(spark, d):
    """One system fails at one step, so its averages are NaN (null here); one phase of another has no finite value and is left out."""
    s = st.assess(*_estimates(spark, d)).where("stat = 'rms'")
    lost = ((F.col("sys") == "click") & (F.col("k") == 100)) | ((F.col("sys") == "view") & (F.col("sub") == "a"))
    m = st.average_in_time(s.withColumn("value", F.when(lost, float("nan")).otherwise(F.col("value"))), BURN_IN, DT, EVERY)
    return m.select("sys", "sub", F.when(~F.isnan("val"), r6(F.col("val"))).alias("val"))


@query("registered_statistic", f"WITH {_STEPS} SELECT sys, sub, round(avg(ln(1 + abs(mu - y))), 6) + 0.0 AS val FROM ph WHERE k * 0.05 > 4 GROUP BY sys, sub")
def registered_statistic(spark, d):
    """A statistic of the caller's own beside the built-in ones."""
    s = st.register(st.assess(*_estimates(spark, d)).where("stat = 'rms'"), "log", "rms", F.log(1 + F.col("value"))).where("stat = 'log'")
    return rounded(st.average_in_time(s, BURN_IN, DT, EVERY).select("sys", "sub", "val"), "val")


# --- updates by several observations ---------------------------------------------------------------------


def _step(k: int, src: str, index: int, move: str, noise: str | None = None, unit: bool = False) -> str:
    """SQL of one scalar update of table ``src`` to table ``e<k>``; ``move`` is over ya, ym, v and z."""
    z = ""
    if noise:
        scale = " * sqrt(count(*) OVER p / ((sum(z * z) OVER p) - (sum(z) OVER p) * (avg(z) OVER p)))" if unit else ""
        z = f"z{k} AS MATERIALIZED (SELECT ens, n, (z - avg(z) OVER p){scale} AS z FROM (SELECT label::BIGINT AS ens, vec_id::BIGINT AS n, {noise} AS z FROM embeddings) WINDOW p AS (PARTITION BY ens)), "
    return f"""m{k} AS MATERIALIZED (SELECT ens, i, avg(x) AS mu FROM {src} GROUP BY ens, i), a{k} AS MATERIALIZED (SELECT ens, n, i, x, x - mu AS a, mu FROM {src} JOIN m{k} USING (ens, i)),
y{k} AS MATERIALIZED (SELECT ens, n, a AS ya, mu AS ym FROM a{k} WHERE i = {index}), v{k} AS (SELECT ens, var_samp(ya) AS v FROM y{k} GROUP BY ens),
c{k} AS MATERIALIZED (SELECT a.ens, a.i, sum(a.a * y.ya) / (count(*) - 1) AS c FROM a{k} a JOIN y{k} y USING (ens, n) GROUP BY a.ens, a.i),
{z}d{k} AS MATERIALIZED (SELECT y.ens, y.n, v.v, {move} AS move FROM y{k} y JOIN v{k} v USING (ens){f' JOIN z{k} z USING (ens, n)' if noise else ''}),
e{k} AS MATERIALIZED (SELECT a.ens, a.n, a.i, a.x + c.c / d.v * d.move AS x FROM a{k} a JOIN c{k} c ON c.ens = a.ens AND c.i = a.i JOIN d{k} d ON d.ens = a.ens AND d.n = a.n)"""


_GAIN = "v / (v + 0.02)"
_ROOT = lambda obs: f"{_GAIN} * ({obs} - ym) - {_GAIN} / (1 + sqrt(0.02 / (v + 0.02))) * ya"
_HALF = lambda obs: f"{_GAIN} * ({obs} - ym) - 0.5 * {_GAIN} * ya"
_OWN = lambda obs: f"{_GAIN} * ({obs} + sqrt(0.02) * z - ym - ya)"
OBSERVATIONS = [(3, 0.1), (20, -0.05)]


def _flavour(name, flavour, steps, observations=OBSERVATIONS, inflation=1.0, noise=None):
    last = f"e{len(observations)}"
    out = "x" if inflation == 1.0 else f"avg(x) OVER (PARTITION BY ens, i) + {inflation} * (x - avg(x) OVER (PARTITION BY ens, i))"

    @query(name, f"WITH {ENS}, {', '.join(steps)} SELECT ens, n, i, round({out}, 6) + 0.0 AS x FROM {last}")
    def run(spark, d):
        return rounded(da.analysis(_ens(spark, d), observations, 0.02, flavour, noise, inflation), "x")


_WAVE = lambda j: f"sin(vec_id * 1.7 + {j})"
_flavour("enkf_serial_two", "Serial", [_step(1, "ens", 3, _ROOT(0.1)), _step(2, "e1", 20, _ROOT(-0.05))])
_flavour("enkf_serial_inflated", "Serial", [_step(1, "ens", 3, _ROOT(0.1)), _step(2, "e1", 20, _ROOT(-0.05))], inflation=1.05)
_flavour("enkf_denkf_two", "Serial DEnKF", [_step(1, "ens", 3, _HALF(0.1)), _step(2, "e1", 20, _HALF(-0.05))])
# noise of the queries is a wave over the member, so that SQL has the same; its default use is with row-keyed draws
_flavour("enkf_pert_obs", "PertObs", [_step(1, "ens", 3, _OWN(0.1), _WAVE(0))], OBSERVATIONS[:1], noise=lambda j: F.sin(F.col("n") * 1.7 + j))
_flavour("enkf_serial_stoch", "Stoch", [_step(1, "ens", 3, _OWN(0.1), _WAVE(0)), _step(2, "e1", 20, _OWN(-0.05), _WAVE(1))], noise=lambda j: F.sin(F.col("n") * 1.7 + j))
_flavour("enkf_serial_var1", "Var1", [_step(1, "ens", 3, _OWN(0.1), _WAVE(0), True), _step(2, "e1", 20, _OWN(-0.05), _WAVE(1), True)], noise=lambda j: F.sin(F.col("n") * 1.7 + j))


# --- particles -------------------------------------------------------------------------------------------

_SHARES = f"{_PART}, cu AS (SELECT sys, n, w, sum(w) OVER (PARTITION BY sys ORDER BY n ROWS UNBOUNDED PRECEDING) AS hi, count(*) OVER (PARTITION BY sys) AS size FROM rw)"
_FALL = lambda src: f"iv AS (SELECT sys, n, coalesce(lag(hi) OVER (PARTITION BY sys ORDER BY n), 0) AS lo, CASE WHEN n = size THEN 2 ELSE hi END AS hi FROM {src})"


@query("pf_multinomial", f"WITH {_SHARES}, {_FALL('cu')}, dr AS (SELECT sys, (j * 0.6180339887498949::DOUBLE) % 1 AS u FROM (SELECT sys, unnest(range(1, size + 1)) AS j FROM (SELECT DISTINCT sys, size FROM cu))) SELECT iv.sys, iv.n, count(dr.u)::BIGINT AS copies FROM iv LEFT JOIN dr ON dr.sys = iv.sys AND dr.u >= iv.lo AND dr.u < iv.hi GROUP BY iv.sys, iv.n")
def pf_multinomial(spark, d):
    """As many independent draws as particles; here they are multiples of a fixed number, so that SQL has the same."""
    p = _particles(spark, d)
    u = p.select("sys", (F.col("n") * 0.6180339887498949 % 1).alias("u"))
    return pa.multinomial(p, u)


@query("pf_residual_draws", f"WITH {_PART}, z AS (SELECT sys, n, w * count(*) OVER (PARTITION BY sys) AS nw, count(*) OVER (PARTITION BY sys) AS size FROM rw), re AS (SELECT sys, n, size, floor(nw)::BIGINT AS whole, (nw - floor(nw)) / sum(nw - floor(nw)) OVER (PARTITION BY sys) AS w FROM z), cu AS (SELECT *, sum(w) OVER (PARTITION BY sys ORDER BY n ROWS UNBOUNDED PRECEDING) AS hi FROM re), {_FALL('cu')}, dr AS (SELECT sys, ((j + 1) * 0.6180339887498949::DOUBLE) % 1 AS u FROM (SELECT sys, unnest(range(size - sum(whole)::BIGINT)) AS j FROM re GROUP BY sys, size)), hit AS (SELECT iv.sys, iv.n, count(dr.u)::BIGINT AS more FROM iv LEFT JOIN dr ON dr.sys = iv.sys AND dr.u >= iv.lo AND dr.u < iv.hi GROUP BY iv.sys, iv.n) SELECT re.sys, re.n, re.whole + hit.more AS copies FROM re JOIN hit ON hit.sys = re.sys AND hit.n = re.n")
def pf_residual_draws(spark, d):
    """Whole copies, and draws for what is left."""
    return pa.residual_draws(_particles(spark, d), (F.col("j") + 1) * 0.6180339887498949 % 1)


@query("ens_ext_statistics", f"WITH {EVENTS} SELECT sys, round(sqrt(var_samp(y)), 6) AS spread, round(sqrt(var_samp(y)) * 0.7978845608028654, 6) AS mad FROM s GROUP BY sys")
def ens_ext_statistics(spark, d):
    """Spread and mean absolute deviation of an estimate that is a mean and a variance."""
    c = filters.climatology(_events(spark, d))
    return c.select("sys", r6(F.sqrt("var")).alias("spread"), r6(F.sqrt("var") * 0.7978845608028654).alias("mad"))

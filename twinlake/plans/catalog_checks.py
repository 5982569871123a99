"""Registered queries of metrics on the way, table functions, the ordered stream, and experiments by role, cost and place."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlake.functions import checks
from twinlake.functions import series as se
from twinlake.functions import statistics as st
from twinlake.operators import assimilation as da
from twinlake.operators import experiments as xp
from twinlake.operators import smoothers as sm
from twinlake.plans.catalog import _ACOV, _AR1, _MEAN, _XPS, ENS, EVENTS, MOMENTS, TRUTH, _ens, _events, _shared, _truth, _xps, r6, read, rounded
from twinlake.plans.catalog_smoothers import _FILTER, LEVEL
from twinlake.plans.registry import query


@query("watched_metrics", "SELECT 'rows' AS metric, count(*)::DOUBLE AS value FROM events UNION ALL SELECT 'value_finite', count(value)::DOUBLE FROM events WHERE isfinite(value) UNION ALL SELECT 'value_least', min(value) FROM events UNION ALL SELECT 'value_most', max(value) FROM events UNION ALL SELECT 'total', round(sum(value), 6) FROM events")
def watched_metrics(spark, d):
    """Metrics of the series beside its sum, of one pass."""
    e, o = checks.watched(read(spark, d, "events"), "events", "value")
    total = e.agg(F.sum("value").alias("s")).first()["s"]
    m = checks.warn_of(o, "events", "value")
    rows = [(k, float(v)) for k, v in m.items()] + [("total", round(total, 6))]
    return spark.createDataFrame(rows, "metric string, value double")


@query("steps_function", f"WITH {EVENTS}, l AS (SELECT sys, max(k) AS last FROM s GROUP BY sys) SELECT sys, k::BIGINT AS k, CASE WHEN k % 5 = 0 THEN k // 5 - 1 END::BIGINT AS ko, round(k * 0.05, 6) AS t, k * 0.05 > 4 AS counts FROM (SELECT sys, unnest(range(1, last + 1)) AS k FROM l)")
def steps_function(spark, d):
    """The steps of each series by a table function in SQL."""
    checks.register(spark)
    last = _events(spark, d).groupBy("sys").agg(F.max("k").alias("last"))
    last.createOrReplaceTempView("twinlake_last_steps")
    return rounded(spark.sql("SELECT l.sys, s.* FROM twinlake_last_steps l, LATERAL steps(l.last, 5, 0.05D, 4.0D) s"), "t")


_ALL = _FILTER.replace("CASE WHEN s.k % 5 = 0 THEN 0 ELSE 1 / (p11 + 2 * p12 + p22 + 54) END", "1 / (p11 + 2 * p12 + p22 + 54)")


@query("stream_kf_ordered", f"WITH RECURSIVE {_ALL}, id AS (SELECT event_type AS sys, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)::BIGINT AS k, event_id, ts FROM events) SELECT sys, event_id, round(m1, 6) + 0.0 AS level, round(m2, 6) + 0.0 AS slope, round(p11, 6) + 0.0 AS var FROM fl JOIN id USING (sys, k) WHERE epoch_ms(ts) < (SELECT max(epoch_ms(ts)) FROM events)")
def stream_kf_ordered(spark, d):
    """Level and slope online from seven files of events, two a micro-batch: rows that the watermark has passed."""
    from twinlake.streaming.online import drained
    from twinlake.streaming.ordered import ordered_kalman, sliced_stream, slices, state_store

    e = read(spark, d, "events").select(F.col("event_type").alias("sys"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("y"))
    path = _shared(spark, "stream-files")
    slices(spark, e, path, 7)
    with state_store(spark):
        out = drained(ordered_kalman(sliced_stream(spark, e, path, 2), LEVEL), _shared(spark, "stream-ordered"))
    return rounded(out.select("sys", "event_id", F.get("mean", 0).alias("level"), F.get("mean", 1).alias("slope"), F.get("cov", 0).alias("var")), "level", "slope", "var")


# --- experiments -----------------------------------------------------------------------------------------


@query("xp_tune_cost", f"WITH {_XPS}, r AS (SELECT *, row_number() OVER (PARTITION BY da_method, upd_a ORDER BY abs(val - 150000), seq DESC) AS r FROM x WHERE NOT isnan(val)) SELECT da_method, upd_a, seed, infl, round(val, 3) AS val FROM r WHERE r = 1")
def xp_tune_cost(spark, d):
    """The experiment nearest to a target, by a cost of the caller's own."""
    t = xp.tune(_xps(spark, d), ["da_method", "upd_a"], ["seed", "infl"], cost=lambda v: F.abs(v - 150000))
    return rounded(t, "val", places=3)


@query("xp_roles", f"{_MEAN}, ok AS (SELECT *, row_number() OVER (PARTITION BY da_method, upd_a ORDER BY n_fail > 0, abs(m - 150000), infl NULLS FIRST) AS r FROM g) SELECT da_method, upd_a, infl, round(m, 3) AS val, n_fail, n_total - n_fail AS n_success FROM ok WHERE r = 1 AND n_fail = 0")
def xp_roles(spark, d):
    """A nested table by the roles of its dimensions: seeds averaged over, inflation set at the least cost."""
    x = _xps(spark, d)
    t = xp.table_tree(x, {"outer": ["da_method"], "inner": ["upd_a"], "optim": ["infl"]}, cost=lambda v: F.abs(v - 150000))
    return rounded(t.where("n_fail = 0").drop("prec"), "val", places=3)


@query("xp_places", f"WITH {_XPS}, k AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS k, count(*) OVER () AS n FROM x) SELECT part, seq FROM k, (VALUES ('last'), ('tail'), ('middle'), ('back'), ('list')) p(part) WHERE CASE part WHEN 'last' THEN k = n - 1 WHEN 'tail' THEN k >= n - 4 WHEN 'middle' THEN k >= n - 9 AND k < n - 5 WHEN 'back' THEN k >= n - 9 AND (n - 1 - k) % 3 = 0 ELSE k IN (1, n - 2) END")
def xp_places(spark, d):
    """Places counted from the end, as a list has them."""
    x = _xps(spark, d)
    parts = {"last": -1, "tail": slice(-4, None), "middle": slice(-9, -5), "back": slice(None, -10, -3), "list": [1, -2]}
    out = [xp.at(x, p).select(F.lit(n).alias("part"), "seq") for n, p in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


# --- statistics of ensembles over time -------------------------------------------------------------------

#: Embeddings as eight times of eight variables; the truth is the mean of all ensembles.
_LAG8 = "e0 AS (SELECT label::BIGINT AS lab, vec_id::BIGINT AS n, i::BIGINT - 1 AS i, x::DOUBLE AS x FROM (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)), ens AS (SELECT lab * 8 + i // 8 AS ens, n, i % 8 AS i, x FROM e0), tr AS (SELECT i // 8 AS k, i % 8 AS i, avg(x) AS truth FROM e0 GROUP BY 1, 2)"
_WENS = "wens AS (SELECT e.*, 1.0 / c.c AS w FROM ens e JOIN (SELECT ens, count(DISTINCT n)::DOUBLE AS c FROM ens GROUP BY 1) c USING (ens))"
_ALL8 = f"""WITH {_LAG8}, {_WENS}, {MOMENTS}, own AS MATERIALIZED (SELECT w.ens, w.n, w.i, w.x, w.w, truth FROM wens w JOIN tr ON tr.k = w.ens % 8 AND tr.i = w.i),
one AS (SELECT ens, i, sum(w * abs(x - truth)) AS a, sum(CASE WHEN x < truth THEN 1.0 ELSE 0.0 END) AS rh, any_value(truth) AS truth FROM own GROUP BY ens, i), two AS (SELECT p.ens, p.i, sum(p.w * q.w * abs(p.x - q.x)) AS b FROM own p JOIN own q ON p.ens = q.ens AND p.i = q.i GROUP BY p.ens, p.i),
st AS MATERIALIZED (SELECT mom.ens, mom.i, mu - truth AS err, sqrt(var) AS spread, mad, m3 / var ** 1.5 AS skew, m4 / var ** 2 - 3 AS kurt, 2 * ln(sqrt(var)) + (mu - truth) ** 2 / var AS gscore, a - b / 2 AS crps, rh FROM mom JOIN one USING (ens, i) JOIN two USING (ens, i)),
lg AS (UNPIVOT st ON err, spread, mad, skew, kurt, gscore, crps, rh INTO NAME stat VALUE v), pt AS (SELECT *, 'field' AS part FROM lg UNION ALL SELECT *, 'low' FROM lg WHERE i < 5 UNION ALL SELECT *, 'high' FROM lg WHERE i >= 3)"""


@query("assess_ensembles", f"{_ALL8} SELECT ens // 8 AS ens, ens % 8 AS k, stat, part, round(avg(v), 6) + 0.0 AS m, round(avg(v * v), 6) + 0.0 AS ms, round(sqrt(avg(v * v)), 6) + 0.0 AS rms, round(avg(abs(v)), 6) + 0.0 AS ma FROM pt GROUP BY ens, stat, part")
def assess_ensembles(spark, d):
    """Eight statistics of ensembles at each time, over the field and two sectors that overlap."""
    e = sm.lag_states(_ens(spark, d), 8)
    truth = e.groupBy("k", "i").agg(F.avg("x").alias("truth"))
    sec = e.select("i").distinct().select("i", F.explode(F.array(F.when(F.col("i") < 5, "low"), F.when(F.col("i") >= 3, "high"))).alias("sector")).where("sector is not null")
    out = st.assess_ensembles(e, truth, sec).select("ens", "k", "stat", "part", "m", "ms", "rms", "ma")
    return rounded(out, "m", "ms", "rms", "ma")


@query("spectra_values", f"WITH {_LAG8.replace('lab * 8 + i // 8', 'lab * 32 + i // 2').replace('i % 8 AS i, x FROM e0)', 'i % 2 AS i, x FROM e0)')}, t AS (SELECT i, avg(x) AS truth FROM ens GROUP BY i), w AS (SELECT ens, n, max(x) FILTER (i = 0) AS x0, max(x) FILTER (i = 1) AS x1 FROM ens GROUP BY ens, n), c AS (SELECT ens, var_samp(x0) AS a, covar_samp(x0, x1) AS b, var_samp(x1) AS d, avg(x0) - (SELECT truth FROM t WHERE i = 0) AS e0, avg(x1) - (SELECT truth FROM t WHERE i = 1) AS e1 FROM w GROUP BY ens), l AS (SELECT *, (a + d) / 2 + sqrt((a - d) ** 2 / 4 + b * b) AS l0, (a + d) / 2 - sqrt((a - d) ** 2 / 4 + b * b) AS l1 FROM c), v AS (SELECT ens, unnest([0, 1])::BIGINT AS s, unnest([l0, l1]) AS l, a, b, d, e0, e1 FROM l) SELECT ens, s, round(sqrt(l), 6) AS sval, round(abs(b * e0 + (l - a) * e1) / sqrt(b * b + (l - a) ** 2), 6) + 0.0 AS umisf FROM v")
def spectra_values(spark, d):
    """Singular values and misfits of ensembles of two variables, each by itself against closed forms."""
    e = _ens(spark, d).select((F.col("ens") * 32 + F.floor(F.col("i") / 2)).cast("long").alias("ens"), "n", (F.col("i") % 2).alias("i"), "x")
    s = da.ensemble_spectra(e, _truth(e), 2)
    return rounded(s.withColumn("umisf", F.abs("umisf")), "sval", "umisf")


@query("spectra_members", f"WITH {ENS}, {TRUTH}, m AS (SELECT ens, i, avg(x) AS mu FROM ens GROUP BY ens, i), g AS (SELECT ens, n, sum((x - mu) * (mu - truth)) AS b, sum((x - mu) ** 2) AS aa FROM ens JOIN m USING (ens, i) JOIN truth USING (i) GROUP BY ens, n) SELECT ens, round(sum(aa) / (count(*) - 1), 5) AS total, round(sum(b * b) / (count(*) - 1), 5) + 0.0 AS along FROM g GROUP BY ens")
def spectra_members(spark, d):
    """The same by members: squares of the values add up to the variance, and with the misfits to the error's product with it."""
    e = _ens(spark, d)
    s = da.ensemble_spectra(e, _truth(e), 64, side="members")
    return s.groupBy("ens").agg(r6(F.sum(F.col("sval") ** 2), 5).alias("total"), r6(F.sum((F.col("sval") * F.col("umisf")) ** 2), 5).alias("along"))


@query("zeta_a_corrected", f"WITH {ENS}, {TRUTH}, a AS (SELECT ens, sum((x - mu) ** 2) / 0.02 AS s, any_value((truth - mu) ** 2) / 0.02 AS dy2, count(*)::DOUBLE AS n FROM (SELECT *, avg(x) OVER (PARTITION BY ens) AS mu FROM ens WHERE i = 0) JOIN truth USING (i) GROUP BY ens), w AS (SELECT *, s * dy2 / (n - 1 + s) ** 2 AS ww, (n + 1) / n AS e, n / (n - 1) AS c, ((n - 1) / (s + n - 1) + n - 1) / n AS h FROM a) SELECT ens, round((n - 1) * c * (e / c) ** (h / 2) / (e / (e / c) ** (h / 2) + ww), 6) + 0.0 AS zeta FROM w")
def zeta_a_corrected(spark, d):
    """The same weight by the constants that are corrected for what the observation says."""
    e = _ens(spark, d)
    w = da.mean_weight(e, 0, _truth(e).where("i = 0").select(F.col("truth").alias("y")), 0.02)
    return w.select("ens", r6(da.zeta(F.col("size"), F.col("ww"), F.col("s2"))).alias("zeta"))


@query("corr_length_long", f"WITH {EVENTS}, {_ACOV.replace('range(0, 5)', 'range(0, 101)')}, {_AR1.replace('END), 5) AS m', 'END), 101) AS m')} SELECT sys, round(CASE WHEN a = 0 THEN 0 ELSE 1 / ln(1 / a) END, 6) + 0.0 AS length FROM ar")
def corr_length_long(spark, d):
    """Correlation length from a hundred lags."""
    a = se.autocovariance(_events(spark, d), 100).select("sys", se.ar1(F.col("acov")).alias("a"))
    return a.select("sys", r6(se.correlation_length(F.col("a"))).alias("length"))


@query("ring_mean_half", f"WITH {ENS}, wide AS (SELECT * FROM ens UNION ALL SELECT ens, n, i + 64, x FROM ens WHERE i < 2 UNION ALL SELECT ens, n, i - 64, x FROM ens WHERE i >= 62), w AS (SELECT ens, n, i, (sum(x) OVER p - (first_value(x) OVER p + last_value(x) OVER p) / 2) / 4 AS x FROM wide WINDOW p AS (PARTITION BY ens, n ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT ens, n, i, round(x, 6) + 0.0 AS x FROM w WHERE i BETWEEN 0 AND 63")
def ring_mean_half(spark, d):
    """Circular mean whose outer neighbours count half."""
    return rounded(se.ring_mean(_ens(spark, d), 2, 64, half_ends=True).select("ens", "n", "i", "x"), "x")

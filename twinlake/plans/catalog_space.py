"""Registered queries of updates in ensemble space: many observations at once and in turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinlake.operators import ensemble_space as es
from twinlake.plans.catalog import ENS, _ens, rounded
from twinlake.plans.catalog_cycle import _ROOT, _step
from twinlake.plans.matrix_sql import inverse, inverse_root, product, shifted
from twinlake.plans.registry import query

#: Every fourth variable is observed.
MANY = [(4 * j, round(0.01 * (j % 5 - 2), 2)) for j in range(16)]
R = 0.02
_OBS = f"o(j, i, y) AS (VALUES {', '.join(f'({j}, {i}, {y}::DOUBLE)' for j, (i, y) in enumerate(MANY))})"
#: Scaled anomalies of observed variables, their Gram matrix over N1 plus I, the mean's misfit, and products with the state.
_GRAM = f"""{ENS}, {_OBS}, m AS MATERIALIZED (SELECT ens, i, avg(x) AS mu, count(*) AS size FROM ens GROUP BY ens, i), a AS MATERIALIZED (SELECT ens, n, i, x, x - mu AS a FROM ens JOIN m USING (ens, i)),
y AS MATERIALIZED (SELECT ens, n, j, a / sqrt({R}) AS s FROM a JOIN o USING (i)), su AS MATERIALIZED (SELECT ens, n, list(s ORDER BY j) AS s FROM y GROUP BY ens, n),
d AS MATERIALIZED (SELECT ens, list((y - mu) / sqrt({R}) ORDER BY j) AS d, any_value(size) - 1.0 AS n1 FROM m JOIN o USING (i) GROUP BY ens),
g AS (SELECT p.ens, p.j, q.j AS k, sum(p.s * q.s) AS g FROM y p JOIN y q ON q.ens = p.ens AND q.n = p.n GROUP BY p.ens, p.j, q.j),
gr AS (SELECT ens, j, list(g ORDER BY k) AS r FROM g GROUP BY ens, j), gm AS (SELECT ens, list(r ORDER BY j) AS g FROM gr GROUP BY ens),
ga AS MATERIALIZED (SELECT ens, {shifted("g", "1.0", "1.0 / n1")} AS a FROM gm JOIN d USING (ens)),
b AS (SELECT a.ens, a.i, y.j, sum(a.a * y.s) AS b FROM a JOIN y ON y.ens = a.ens AND y.n = a.n GROUP BY a.ens, a.i, y.j), bl AS MATERIALIZED (SELECT ens, i, list(b ORDER BY j) AS b FROM b GROUP BY ens, i)"""
_MOVED = "SELECT ens, n, i, round(x + list_inner_product(b, c), 6) + 0.0 AS x FROM a JOIN bl USING (ens, i) JOIN c USING (ens, n)"
_SQRT = f"""WITH RECURSIVE {_GRAM}, {inverse_root("h", "ga", "a")}, h2 AS MATERIALIZED (SELECT ens, x AS h, {product("x", "x")} AS hh, {shifted("x", "1.0")} AS a FROM h), {inverse("w", "h2", "a")},
k AS MATERIALIZED (SELECT ens, n1, hh, d, {product("hh", "w.x")} AS k FROM h2 JOIN w USING (ens) JOIN d USING (ens)),
c AS MATERIALIZED (SELECT ens, n, list_transform(hh, lambda row, j: list_inner_product(row, d) / n1 - list_inner_product(k[j], s) / n1) AS c FROM su JOIN k USING (ens)) {_MOVED}"""


@query("enkf_sqrt_many", _SQRT)
def enkf_sqrt_many(spark, d):
    """The symmetric square-root update by 16 observations at once."""
    return rounded(es.updated(_ens(spark, d), MANY, R, "Sqrt"), "x")


@query("enkf_sqrt_members", _SQRT)
def enkf_sqrt_members(spark, d):
    """The same update with matrices by member: observations are a table."""
    e = _ens(spark, d)
    value = 0.01 * (F.col("j") % 5 - 2)
    obs = e.select("i").distinct().where("i % 4 = 0").select((F.col("i") / 4).cast("long").alias("j"), "i").select("j", "i", F.round(value, 2).alias("y"), F.lit(R).alias("r"))
    return rounded(es.square_root_by_members(e, obs), "x")


_INV = f"WITH RECURSIVE {_GRAM}, {inverse('p', 'ga', 'a')}, pd AS MATERIALIZED (SELECT ens, x AS p, d, n1 FROM p JOIN d USING (ens))"
_WAVES = "z AS (SELECT ens, n, j, sin(n * 1.7 + j) AS z FROM (SELECT DISTINCT ens, n FROM ens), o), zc AS (SELECT ens, n, j, z - avg(z) OVER (PARTITION BY ens, j) AS z FROM z), zl AS MATERIALIZED (SELECT ens, n, list(z ORDER BY j) AS z FROM zc GROUP BY ens, n)"


@query("enkf_pert_obs_many", f"{_INV}, {_WAVES}, c AS MATERIALIZED (SELECT ens, n, list_transform(p, lambda row: list_inner_product(row, list_transform(d, lambda v, j: v + z[j] - s[j])) / n1) AS c FROM su JOIN pd USING (ens) JOIN zl USING (ens, n)) {_MOVED}")
def enkf_pert_obs_many(spark, d):
    """All 16 observations at once, perturbed for each member; the draws are waves, so that SQL has the same."""
    return rounded(es.updated(_ens(spark, d), MANY, R, "PertObs", lambda j: F.sin(F.col("n") * 1.7 + j)), "x")


@query("enkf_denkf_many", f"{_INV}, c AS MATERIALIZED (SELECT ens, n, list_transform(p, lambda row: (list_inner_product(row, d) - 0.5 * list_inner_product(row, s)) / n1) AS c FROM su JOIN pd USING (ens)) {_MOVED}")
def enkf_denkf_many(spark, d):
    """The half-gain update by 16 observations at once."""
    return rounded(es.updated(_ens(spark, d), MANY, R, "DEnKF"), "x")


_TURNS = ", ".join(_step(j + 1, f"e{j}" if j else "ens", i, _ROOT(y)) for j, (i, y) in enumerate(MANY))


@query("enkf_serial_many", f"WITH {ENS}, {_TURNS} SELECT ens, n, i, round(x, 6) + 0.0 AS x FROM e{len(MANY)}")
def enkf_serial_many(spark, d):
    """Sixteen observations in turn: one pass of the state."""
    return rounded(es.updated(_ens(spark, d), MANY, R, "Serial"), "x")

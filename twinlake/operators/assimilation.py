"""Ensemble updates as jobs on the long table (ens, n, i, x): joins and aggregates, and small linear algebra by group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlake.functions.ensemble import KEY, anomalies
from twinlake.operators.ensemble_space import sides, state_grams, states, symmetric, together, updated
from twinlake.operators.localization import FACTORS, taper


def observed(e: DataFrame, index: int) -> DataFrame:
    """(ens, n, ya, ym): anomaly and mean of the observed state variable."""
    return anomalies(e.where(F.col("i") == index)).select("ens", "n", F.col("a").alias("ya"), F.col("mu").alias("ym"))


def localised_update(e: DataFrame, index: int, obs: float, r: float, weight: Column) -> DataFrame:
    """(ens, n, i, x) after one observation by the square-root filter, its regression on index i times ``weight``.

    Rows of weight nought stay as they are. An ensemble without variance at the observed variable stays too."""
    y = observed(e, index)
    v = y.groupBy("ens").agg(F.var_samp("ya").alias("v"), F.first("ym").alias("m"))
    a = anomalies(e).withColumn("h", weight)
    j = a.where("h > 0").join(y.select("ens", "n", "ya"), ["ens", "n"])
    c = j.groupBy(*KEY).agg((F.sum(F.col("a") * F.col("ya")) / (F.count(F.lit(1)) - 1)).alias("c"))
    j = a.join(c, KEY, "left").join(y.select("ens", "n", "ya"), ["ens", "n"]).join(v, "ens")
    slope = F.when(F.col("v") > 1e-12, F.coalesce("c", F.lit(0.0)) * F.col("h") / F.col("v")).otherwise(0.0)
    gain = F.col("v") / (F.col("v") + r)
    shrink = F.sqrt(F.lit(r) / (F.col("v") + r)) - 1
    return j.select("ens", "n", "i", (F.col("x") + slope * (gain * (obs - F.col("m")) + shrink * F.col("ya"))).alias("x"))


def serial_updates(e: DataFrame, observations: list[tuple[int, float]], r: float, flavour: str = "Serial", noise=None) -> DataFrame:
    """One observation (index, value) after another, each of variance ``r``; the state is read once, not once an observation.

    Flavours: ``Serial`` (square root), ``DEnKF`` (half gain), ``Stoch`` (noise of its own for each member) and
    ``Var1`` (the same with mean square one). ``noise(j)`` is the draw of the j-th observation."""
    if flavour not in ("Serial", "DEnKF", "Stoch", "Var1"):
        raise ValueError(f"no such flavour: {flavour}")
    return updated(e, observations, r, "Serial DEnKF" if flavour == "DEnKF" else flavour, noise)


def analysis(e: DataFrame, observations: list[tuple[int, float]], r: float | list[float], flavour: str, noise=None, inflation: float = 1.0) -> DataFrame:
    """The ensemble update of a named flavour (those of ``ensemble_space.updated``), then inflation."""
    from twinlake.functions.ensemble import inflated

    e = updated(e, observations, r, flavour, noise)
    return e if inflation == 1.0 else inflated(e, inflation)


def rank_histogram_update(e: DataFrame, index: int, obs: float, r: float) -> DataFrame:
    """(ens, n, i, x): the observed variable's members move to even quantiles of their reweighted distribution,
    interpolated between members; all others follow by regression.

    Members in order, running sums of weights, and the two sums that enclose a quantile: windows and one
    as-of join, made by merging quantiles and members in one order."""
    y = observed(e, index).withColumn("d", (F.lit(obs) - F.col("ym") - F.col("ya")) / np.sqrt(r))
    by = Window.partitionBy("ens")
    order = by.orderBy("d", "n")
    lw = -0.5 * F.col("d") ** 2
    w = y.withColumn("lw", lw).withColumn("e", F.exp(F.col("lw") - F.max("lw").over(by)))
    w = w.withColumn("w", F.greatest(F.col("e") / F.sum("e").over(by), F.lit(1e-10)))
    size = F.count(F.lit(1)).over(by)
    cum = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(by) * (size - 1) / size
    w = w.withColumns({"cw": cum, "rank": F.row_number().over(order), "size": size})
    grid = (F.col("rank") - 0.5) / F.col("size")
    ends = w.groupBy("ens").agg(F.min("cw").alias("lo"), F.max("cw").alias("hi"))
    w = w.join(ends, "ens").withColumn("q", F.least(F.greatest(grid, F.col("lo")), F.col("hi")))
    points = w.select("ens", F.col("cw").alias("at"), F.lit(0).alias("kind"), "rank", F.struct("cw", "d").alias("p"))
    asked = w.select("ens", F.col("q").alias("at"), F.lit(1).alias("kind"), "rank", F.lit(None).cast("struct<cw:double,d:double>").alias("p"))
    line = points.union(asked)
    merged = Window.partitionBy("ens").orderBy("at", "kind", "rank")
    back = Window.partitionBy("ens").orderBy(F.desc("at"), F.desc("kind"), F.desc("rank"))  # a frame to the end is gone through anew for each row
    upto = lambda w: F.last("p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    line = line.withColumns({"a": upto(merged), "b": upto(back)})
    slope = F.when(F.col("b.cw") > F.col("a.cw"), (F.col("at") - F.col("a.cw")) / (F.col("b.cw") - F.col("a.cw"))).otherwise(0.0)
    new = line.where("kind = 1").select("ens", "rank", F.when(F.col("b").isNull(), F.col("a.d")).otherwise(F.col("a.d") + slope * (F.col("b.d") - F.col("a.d"))).alias("nd"))
    move = w.join(new, ["ens", "rank"]).select("ens", "n", "ya", (F.col("nd") - F.col("d")).alias("move"))
    j = anomalies(e).join(move, ["ens", "n"])
    c = j.groupBy(*KEY).agg((F.sum(F.col("a") * F.col("ya")) / F.sum(F.col("ya") ** 2)).alias("slope"))
    return j.join(c, KEY).select("ens", "n", "i", (F.col("x") - F.col("move") * F.col("slope") * np.sqrt(r)).alias("x"))


def square_root_weights(y: np.ndarray, dy: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The square-root update of N members whose scaled observed anomalies are ``y`` (N, Ny), as a map of state anomalies (N, Nx).

    By the smaller side: along an eigenvector of y'y (or yy') of value s, anomalies shrink by h with h^2 = N1 / (s + N1)."""
    n1 = len(y) - 1
    if y.shape[1] < len(y):
        s, v = np.linalg.eigh(y.T @ y)
        h2 = n1 / (np.maximum(s, 0) + n1)
        mean, cut = v * (h2 / n1) @ v.T @ dy, v * (h2 / (1 + np.sqrt(h2)) / n1) @ v.T
        return lambda a: a + (mean - y @ cut) @ (y.T @ a)
    s, v = np.linalg.eigh(y @ y.T)
    h2 = n1 / (np.maximum(s, 0) + n1)
    w = v * (h2 / n1) @ v.T @ (y @ dy) + v * np.sqrt(h2) @ v.T
    return lambda a: w @ a


def second_order_weights(y: np.ndarray, dy: np.ndarray, scale: float = 1.0, laplace: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """The nonlinear transform: members weighed by their likelihood, and the symmetric root of diag(w) - w w' times root N.

    The new mean is the weighted one, the new covariance the weighted one's. ``scale`` divides misfits; ``laplace`` takes
    double-exponential errors for Gauss ones."""
    misfit = (dy - y) / scale
    lw = -np.sqrt(2) * np.abs(misfit).sum(1) if laplace else -0.5 * (misfit**2).sum(1)
    w = np.exp(lw - lw.max())
    w /= w.sum()
    if len(y) <= MATRIX:
        s, v = np.linalg.eigh(np.diag(w) - np.outer(w, w))
        root = np.sqrt(len(y)) * (v * np.sqrt(np.maximum(s, 0))) @ v.T + w
        return lambda a: root @ a
    return lambda a: np.sqrt(len(y)) * weight_root(w, a) + w @ a


#: Members up to which the root of their weights is made as a matrix.
MATRIX = 256


def weight_root(w: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The symmetric root of diag(w) - w w' times ``a`` (N, Nx), without the matrix: time and memory are as N, not its square.

    A root is 2 / pi times the integral of A (A + t^2)^-1 over t from nought on; for these weights that is f (a - the mean of a
    by f), with f = w / (w + t^2). With t = e^u the trapezoid rule's error falls as e^(-pi^2 / step), and the ends leave out
    less than 1e-11 of the largest weight's root."""
    step, top = 0.3, np.log(w.max()) / 2
    out = np.zeros_like(a, dtype=float)
    for t in np.exp(np.arange(top - 27, top + 27, step)):
        f = w / (w + t * t)
        out += t * f[:, None] * (a - f @ a / f.sum())
    return 2 / np.pi * step * out


def local_transform(e: DataFrame, obs: DataFrame, r: float, radius: float, size: int, batch: int = 2, kind: str = "GC", weights=square_root_weights) -> DataFrame:
    """(ens, n, i, x) of a ring of ``size``: each batch of state variables is updated by what is observed near it.

    ``obs`` is (j, i, y): observed indices and values. An observation's weight is the taper of its mean
    distance to the batch; observations under the cutoff are not sent to it. A group is one batch of one
    ensemble: its members and its few local observations, whatever the size of the state. ``weights`` gives the map of
    anomalies: ``square_root_weights`` or ``second_order_weights``. A batch that sees no observation stays as it is."""
    reach = int(np.ceil(2 * radius * FACTORS[kind])) + batch  # no taper is felt farther off
    d = lambda i: F.least(F.abs(i - F.col("oi")), size - F.abs(i - F.col("oi")))
    hit = F.array_distinct(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: F.floor(F.pmod(F.col("oi") + k, F.lit(size)) / batch).cast("long")))
    near = obs.select("j", F.col("i").alias("oi")).select("j", "oi", F.explode(hit).alias("batch"))
    own = F.filter(F.sequence(F.col("batch") * batch, F.col("batch") * batch + batch - 1), lambda i: i < size)
    mean = F.reduce(F.transform(own, d), F.lit(0.0), lambda t, x: t + x) / F.size(own)
    near = near.select("batch", "j", taper(mean, radius, kind).alias("h")).where("h > 1e-3")
    yo = anomalies(e).join(obs.select("j", "i", "y"), "i").select("ens", "n", "j", F.col("a").alias("ya"), (F.col("y") - F.col("mu")).alias("dy"))
    seen = near.join(yo, "j").select("ens", "batch", "n", F.col("j").alias("i"), "ya", "dy", "h")
    mine = e.select(*[F.col(c).alias(c) for c in ("ens", "n", "i", "x")], F.floor(F.col("i") / batch).cast("long").alias("batch"))

    def run(state: pd.DataFrame, local: pd.DataFrame) -> pd.DataFrame:
        if state.empty or local.empty:
            return state[["ens", "n", "i", "x"]]
        x = state.pivot(index="n", columns="i", values="x")
        y = local.pivot(index="n", columns="i", values="ya").reindex(x.index).to_numpy()
        one = local.drop_duplicates("i").sort_values("i")
        root = np.sqrt(one["h"].to_numpy() / r)
        mu = x.to_numpy().mean(0)
        new = weights(y * root, one["dy"].to_numpy() * root)
        out = pd.DataFrame(mu + new(x.to_numpy() - mu), index=x.index, columns=x.columns)
        return out.stack().rename("x").reset_index().assign(ens=state["ens"].iat[0])[["ens", "n", "i", "x"]]

    return mine.groupBy("ens", "batch").cogroup(seen.groupBy("ens", "batch")).applyInPandas(run, "ens long, n long, i long, x double")


def noise_inflation(e: DataFrame, q: float, by_index: bool) -> DataFrame:
    """(ens, n, i, x): model noise of variance ``q`` an index put in by stretching anomalies.

    One factor an ensemble, that gives the total variance, or one an index."""
    a = anomalies(e)
    v = a.groupBy(*KEY).agg((F.sum(F.col("a") ** 2) / (F.count(F.lit(1)) - 1)).alias("v"))
    f = v.select(*KEY, F.sqrt(1 + q / F.col("v")).alias("f")) if by_index else v.groupBy("ens").agg(F.sqrt(1 + F.count(F.lit(1)) * q / F.sum("v")).alias("f"))
    return a.join(f, KEY if by_index else "ens").select("ens", "n", "i", (F.col("mu") + F.col("f") * F.col("a")).alias("x"))


#: State variables up to which spectra are made from the covariance; beyond it from the members' Gram matrix.
STATE_SIDE = 256


def ensemble_spectra(e: DataFrame, truth: DataFrame, dims: int, side: str | None = None) -> DataFrame:
    """(ens, s, sval, umisf): singular values of the anomalies (largest first, as standard deviations) and the error along each.

    From the smaller of two matrices that one aggregate gives: the covariance of ``dims`` variables, or the members' products
    (which, with those of members and error, tell the misfits too: no singular vector of the state is made). By members there
    are as many values as members less one, at most ``dims``; an ensemble of more members than that is worked on by its
    variables all the same. A group is one small matrix; signs of misfits are arbitrary."""
    e, side = e.where(F.col("i") < dims), side or ("state" if dims <= STATE_SIDE else "members")
    tall, wide = (anomalies(e), None) if side == "state" else sides(e)
    parts, pad = [], 0 if side == "state" else dims  # members give values of nought too
    if tall is not None:
        a = tall.join(truth, "i").select("ens", "n", "i", "a", (F.col("mu") - F.col("truth")).alias("mu"))  # the error in the mean's place
        parts.append(state_grams(states(a)).groupBy("ens").applyInPandas(lambda pdf: _spectra_by_state(pdf, pad), SPECTRA))
    if wide is not None:
        parts.append(_spectra_by_members(wide.join(truth, "i").select("ens", "n", "i", "a", (F.col("mu") - F.col("truth")).alias("err")), dims))
    return together(parts)


def _spectra_by_members(a: DataFrame, dims: int) -> DataFrame:
    b = a.select("ens", F.col("n").alias("j"), "i", F.col("a").alias("b"))
    g = a.join(b, KEY).groupBy("ens", F.col("n").alias("i"), "j").agg(F.sum(F.col("a") * F.col("b")).alias("g"), F.sum(F.col("a") * F.col("err")).alias("err"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="i", columns="j", values="g")
        err = pdf.drop_duplicates("i").set_index("i")["err"].reindex(m.index).to_numpy()
        d, v = np.linalg.eigh(m.to_numpy())
        d, along = np.maximum(d[::-1], 0), v.T[::-1] @ err
        many = min(len(d) - 1, dims)
        along, d = along[:many] / np.sqrt(np.maximum(d[:many], 1e-300)), d[:many] / (len(d) - 1)
        return pd.DataFrame({"ens": pdf["ens"].iat[0], "s": range(len(d)), "sval": np.sqrt(d), "umisf": along})

    return g.groupBy("ens").applyInPandas(run, SPECTRA)


SPECTRA = "ens long, s long, sval double, umisf double"


def _spectra_by_state(pdf: pd.DataFrame, pad: int) -> pd.DataFrame:
    """From products of variables; up to ``pad`` values, those that are not there being nought."""
    at, g = symmetric(pdf)
    err, size = pdf.drop_duplicates("i").set_index("i")["mu"].reindex(at).to_numpy(), int(pdf["n"].max())
    d, v = np.linalg.eigh(g / (size - 1) if size > 1 else g)
    d, along = np.maximum(d[::-1], 0), v.T[::-1] @ err
    more = np.zeros(max(0, min(pad, size - 1) - len(d)))
    return pd.DataFrame({"ens": pdf["ens"].iat[0], "s": range(len(d) + len(more)), "sval": np.sqrt(np.concatenate([d, more])), "umisf": np.concatenate([along, more])})


def finite_size_inflation(e: DataFrame, obs: DataFrame, r: float, xn: float = 1.0, g: int = 0) -> DataFrame:
    """(ens, infl): the inflation that a finite ensemble asks for, from the Gram matrix of its observations ``obs`` (j, i, y).

    With s_k^2 the eigenvalues of that matrix, d_k the misfit along them and N1 = N - 1, it is the factor l that makes

        sum_k d_k^2 / (l^2 s_k^2 + N1)  +  e / l^2  +  c log l^2

    least, where e = (N + 1) / N and c = (N + g) / N1 are a finite ensemble's constants, times ``xn`` for one that is surer.
    The prior of l^2 by itself is greatest at e / c; so that it is one where observations say nothing, e is divided and c
    multiplied by (e / c)^(h / 2), h being the mean over all N directions of N1 / (s^2 + N1). (Bocquet, Raanes and Hannart,
    "Expanding the validity of the ensemble Kalman filter without the intrinsic need for inflation", 2015.)"""
    a = anomalies(e).join(obs, "i").select("ens", "n", "j", (F.col("a") / float(np.sqrt(r))).alias("a"), ((F.col("y") - F.col("mu")) / float(np.sqrt(r))).alias("d"))
    b = a.select("ens", "n", F.col("j").alias("k"), F.col("a").alias("b"))
    gram = a.join(b, ["ens", "n"]).groupBy("ens", "j", "k").agg(F.sum(F.col("a") * F.col("b")).alias("g"), F.first("d").alias("d"), F.count(F.lit(1)).alias("size"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="j", columns="k", values="g")
        d = pdf.drop_duplicates("j").set_index("j")["d"].reindex(m.index).to_numpy()
        n = int(pdf["size"].iat[0])
        s2, v = np.linalg.eigh(m.to_numpy())
        s2, d2 = np.maximum(s2, 0), (v.T @ d) ** 2
        e_, c_ = constants(n, s2, xn, g)
        slope = lambda p: c_ - e_ * np.exp(-p) - np.exp(p) * np.sum(s2 * d2 / (np.exp(p) * s2 + n - 1) ** 2)
        lo, hi = -12.0, 12.0  # in the log of the squared factor the slope rises through nought once or stays on a side
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if slope(mid) < 0 else (lo, mid)
        return pd.DataFrame({"ens": [pdf["ens"].iat[0]], "infl": [float(np.exp((lo + hi) / 4))]})

    return gram.groupBy("ens").applyInPandas(run, "ens long, infl double")


def constants(n: int, s2: np.ndarray, xn: float = 1.0, g: int = 0) -> tuple[float, float]:
    """e and c of ``finite_size_inflation`` for ``n`` members whose observations' Gram matrix has eigenvalues ``s2`` (others nought)."""
    e, c = (n + 1) / n, (n + g) / (n - 1)
    lam = np.sort(s2)[::-1][:n]
    h = (np.sum((n - 1) / (lam + n - 1)) + n - len(lam)) / n
    shift = (e / c) ** (h / 2)
    return xn * e / shift, xn * c * shift


def diagonal_spectra(m: DataFrame, truth: DataFrame) -> DataFrame:
    """(ens, s, sval, umisf) of estimates (ens, i, mu, var) whose covariance is diagonal: coordinates, largest variance first."""
    order = Window.partitionBy("ens").orderBy(F.desc(F.round("var", 9)), "i")
    d = m.join(truth, "i").withColumn("s", (F.row_number().over(order) - 1).cast("long"))
    return d.select("ens", "s", F.sqrt("var").alias("sval"), (F.col("mu") - F.col("truth")).alias("umisf"))


def mean_weight(e: DataFrame, index: int, obs: DataFrame, r: float) -> DataFrame:
    """(ens, size, ww, s2): the squared length of the mean's weights in ensemble space after one observation (y) of a state, and
    the eigenvalue of the observation's Gram matrix."""
    a = anomalies(e.where(F.col("i") == index))
    s = a.groupBy("ens").agg((F.sum(F.col("a") ** 2) / r).alias("s"), F.first("mu").alias("mu"), F.count(F.lit(1)).cast("double").alias("size"))
    s = s.withColumn("one", F.lit(1)).join(obs.withColumn("one", F.lit(1)), "one")
    return s.select("ens", "size", (F.col("s") * (F.col("y") - F.col("mu")) ** 2 / r / (F.col("size") - 1 + F.col("s")) ** 2).alias("ww"), F.col("s").alias("s2"))


def zeta(size: Column, ww: Column, s2: Column | None = None) -> Column:
    """The effective number of the prior's precision after an analysis, for squared weights ``ww``.

    With ``s2``, the eigenvalue of the one observation, by the constants of ``finite_size_inflation`` as corrected there."""
    e, c = (size + 1) / size, size / (size - 1)
    if s2 is not None:
        h = ((size - 1) / (s2 + size - 1) + size - 1) / size
        shift = F.pow(e / c, h / 2)
        e, c = e / shift, c * shift
    return (size - 1) * c / (e + ww)

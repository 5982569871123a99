"""Kalman filter and smoother with covariance matrices, as an associative scan over blocks of a series.

A step of the filter is an element of five small arrays: given a Gauss state before it, (A, b, C) is what the state
after it will be, and (eta, J) what its observation tells of the state before. Elements of neighbouring stretches combine to
the element of both, in any bracketing, so blocks are scanned by themselves with whole arrays, block sums are scanned a row a
block, and each block is then entered with the state it starts from. The smoother is a scan of its own from the end.

Sarkka and Garcia-Fernandez, "Temporal parallelization of Bayesian smoothers", 2021."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.functions.series import BLOCK


@dataclass(frozen=True)
class Model:
    """State x' = f x + noise of covariance q, observation y = h x + noise of covariance r; mean m0 and covariance p0 before the first step."""

    f: np.ndarray
    q: np.ndarray
    h: np.ndarray
    r: np.ndarray
    m0: np.ndarray
    p0: np.ndarray
    #: Whether the first step takes its observation as it is (``h`` is then square): nothing is known before it.
    fresh: bool = False


T = lambda x: np.swapaxes(x, -1, -2)
V = lambda m, x: np.einsum("...ij,...j->...i", m, x)
Elements = tuple[np.ndarray, ...]


def elements(o: Model, y: np.ndarray, first: bool = False) -> Elements:
    """The element of each step with observations ``y`` (n, Ny); a step of which any is missing (NaN) only forecasts.

    ``first``: these steps begin their series."""
    n, d = len(y), len(o.m0)
    seen = ~np.isnan(y).any(1)
    hq = o.h @ o.q
    s = hq @ o.h.T + o.r
    gain, back = np.linalg.solve(s, hq).T, np.linalg.solve(s, o.h @ o.f).T
    yy = np.where(seen[:, None], y, 0.0)
    keep = np.eye(d) - gain @ o.h
    pick = lambda a, b: np.where(seen[:, None, None], a, b)
    x = pick(keep @ o.f, o.f), yy @ gain.T, pick(keep @ o.q, o.q), yy @ back.T, pick(back @ o.h @ o.f, np.zeros((d, d)))
    if first and o.fresh:
        inv = np.linalg.inv(o.h)
        for v, new in zip(x, (0.0, inv @ yy[0], inv @ o.r @ inv.T, 0.0, 0.0), strict=True):
            v[0] = new
    return x


def joined(one: Elements, two: Elements) -> Elements:
    """The elements of stretches ``one`` followed by ``two``."""
    (a1, b1, c1, e1, j1), (a2, b2, c2, e2, j2) = one, two
    eye = np.eye(a1.shape[-1])
    left = a2 @ np.linalg.inv(eye + c1 @ j2)
    right = T(a1) @ np.linalg.inv(eye + j2 @ c1)
    return left @ a1, V(left, b1 + V(c1, e2)) + b2, left @ c1 @ T(a2) + c2, V(right, e2 - V(j2, b1)) + e1, right @ j2 @ a1 + j1


def joined_back(one: Elements, two: Elements) -> Elements:
    """Smoothing elements (E, g, L) of stretches ``one`` followed by ``two``."""
    (e1, g1, l1), (e2, g2, l2) = one, two
    return e1 @ e2, V(e1, g2) + g1, e1 @ l2 @ T(e1) + l1


def scanned(x: Elements, join, back: bool = False) -> Elements:
    """Running combinations from the first element (or, ``back``, from the last), by doubling: no loop over steps."""
    if back:
        x = tuple(v[::-1] for v in x)
    step, n = 1, len(x[0])
    while step < n:
        near, far = tuple(v[:-step] for v in x), tuple(v[step:] for v in x)
        new = join(far, near) if back else join(near, far)
        x = tuple(np.concatenate([v[:step], w]) for v, w in zip(x, new, strict=True))
        step *= 2
    return tuple(v[::-1] for v in x) if back else x


def _rows(key: list, x: Elements, names: str) -> pd.DataFrame:
    return pd.DataFrame({"sys": [k[0] for k in key], "blk": [k[1] for k in key], **{c: [v[i].ravel().tolist() for i in range(len(key))] for c, v in zip(names, x, strict=True)}})


def _stacked(pdf: pd.DataFrame, names: str, d: int) -> Elements:
    return tuple(np.array(pdf[c].to_list()).reshape((len(pdf), d) if c in "beg" else (len(pdf), d, d)) for c in names)


def kalman_matrix(s: DataFrame, model: Model, smooth: bool = False, relax: float = 1.0, size: int = BLOCK) -> DataFrame:
    """(sys, k, forecast, mean, cov[, smoothed, smoothed_cov]) of series (sys, k, y): k from 1 without gaps, ``y`` an array of observations.

    Null arrays or entries are steps without an observation. Covariances are arrays of rows. ``relax`` multiplies the
    smoother's gain. A task holds a block of ``size`` steps; what links blocks is one row a block."""
    d = len(model.m0)
    s = s.select("sys", "k", "y", F.floor((F.col("k") - 1) / size).cast("long").alias("blk"))
    ny = len(model.r)

    def observed(pdf: pd.DataFrame) -> np.ndarray:
        lack = [np.nan] * ny
        return np.array([lack if v is None else [np.nan if x is None else x for x in v] for v in pdf["y"]], "f8").reshape(len(pdf), ny)

    def forward(pdf: pd.DataFrame, m: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = pdf["k"].iat[0] == 1
        a, b, c, e, j = scanned(elements(model, observed(pdf), first), joined)
        left = a @ np.linalg.inv(np.eye(d) + p @ j)
        mean, cov = V(left, m + V(p[None], e)) + b, left @ p @ T(a) + c
        forecast = np.concatenate([m[None], mean[:-1]]) @ model.f.T
        if first and model.fresh:
            forecast[0] = mean[0]
        return forecast, mean, (cov + T(cov)) / 2

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        x = scanned(elements(model, observed(pdf), pdf["k"].iat[0] == 1), joined)
        return _rows([(pdf["sys"].iat[0], pdf["blk"].iat[0])], tuple(v[-1:] for v in x), "abcej")

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        """The state that each block starts from."""
        pdf = pdf.sort_values("blk")
        a, b, c, e, j = scanned(_stacked(pdf, "abcej", d), joined)
        left = a @ np.linalg.inv(np.eye(d) + model.p0 @ j)
        mean, cov = V(left, model.m0 + V(model.p0[None], e)) + b, left @ model.p0 @ T(a) + c
        mean, cov = np.concatenate([model.m0[None], mean[:-1]]), np.concatenate([model.p0[None], cov[:-1]])
        return _rows(list(zip(pdf["sys"], pdf["blk"], strict=True)), (mean, cov), "mp")

    sums = "sys string, blk long, a array<double>, b array<double>, c array<double>, e array<double>, j array<double>"
    start = s.groupBy("sys", "blk").applyInPandas(summed, sums).groupBy("sys").applyInPandas(linked, "sys string, blk long, m array<double>, p array<double>")

    def filtered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        fc, mean, cov = forward(pdf, np.array(pdf["m"].iat[0]), np.array(pdf["p"].iat[0]).reshape(d, d))
        return pd.DataFrame({"sys": pdf["sys"], "blk": pdf["blk"], "k": pdf["k"], "forecast": fc.tolist(), "mean": mean.tolist(), "cov": cov.reshape(-1, d * d).tolist()})

    steps = "sys string, blk long, k long, forecast array<double>, mean array<double>, cov array<double>"
    out = s.join(start, ["sys", "blk"]).groupBy("sys", "blk").applyInPandas(filtered, steps)
    if not smooth:
        return out.drop("blk")
    last = s.groupBy("sys").agg(F.max("k").alias("end"))
    out = out.join(last, "sys")

    def backward(pdf: pd.DataFrame) -> Elements:
        mean, cov = np.array(pdf["mean"].to_list()), np.array(pdf["cov"].to_list()).reshape(-1, d, d)
        pf = model.f @ cov @ model.f.T + model.q
        e = relax * T(np.linalg.solve(pf, model.f @ cov))
        e[(pdf["k"] == pdf["end"]).to_numpy()] = 0.0
        return scanned((e, mean - V(e, mean @ model.f.T), cov - e @ pf @ T(e)), joined_back, back=True)

    def summed_back(pdf: pd.DataFrame) -> pd.DataFrame:
        return _rows([(pdf["sys"].iat[0], pdf["blk"].iat[0])], tuple(v[:1] for v in backward(pdf.sort_values("k"))), "agl")

    def linked_back(pdf: pd.DataFrame) -> pd.DataFrame:
        """The smoothed state at the first step of the next block (none after the last)."""
        pdf = pdf.sort_values("blk")
        _, g, l = scanned(_stacked(pdf, "agl", d), joined_back, back=True)  # noqa: E741
        none = np.zeros((1, d))
        return _rows(list(zip(pdf["sys"], pdf["blk"], strict=True)), (np.concatenate([g[1:], none]), np.concatenate([l[1:], none[..., None] * none[:, None]])), "mp")

    end = out.groupBy("sys", "blk").applyInPandas(summed_back, "sys string, blk long, a array<double>, g array<double>, l array<double>")
    end = end.groupBy("sys").applyInPandas(linked_back, "sys string, blk long, m array<double>, p array<double>")

    def smoothed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        e, g, l = backward(pdf)  # noqa: E741
        mean, cov = V(e, np.array(pdf["m"].iat[0])[None]) + g, e @ np.array(pdf["p"].iat[0]).reshape(d, d) @ T(e) + l
        return pdf[["sys", "k", "forecast", "mean", "cov"]].assign(smoothed=mean.tolist(), smoothed_cov=cov.reshape(-1, d * d).tolist())

    kinds = "sys string, k long, forecast array<double>, mean array<double>, cov array<double>, smoothed array<double>, smoothed_cov array<double>"
    return out.join(end, ["sys", "blk"]).groupBy("sys", "blk").applyInPandas(smoothed, kinds)

"""The ensemble smoother that goes back from the end: each time's members follow what later analyses changed.

From one time to the one before, changes pass through a regression of the analysed anomalies on the next forecast's:
sums of products by ensemble and time, solved in batches. A member's changes are then a chain of linear maps, cut into
blocks of times: blocks run by themselves, their maps are linked (a row a block and member), and each block runs again from
what comes in."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Variance that a truncated inverse may leave out, as a share.
LEFT_OUT = 1e-5


def wide(t: DataFrame, dims: int, name: str) -> DataFrame:
    """(ens, n, k, name): a member's state at a time as one array, from rows (ens, n, k, i, x) with i under ``dims``."""
    return t.groupBy("ens", "n", "k").agg(F.array(*[F.max(F.when(F.col("i") == i, F.col("x"))) for i in range(dims)]).alias(name))


def backward_gains(f: DataFrame, a: DataFrame, dims: int, relax: float = 1.0) -> DataFrame:
    """(ens, k, j): the regression (rows of a ``dims`` matrix) of the analysis at ``k`` on the forecast at ``k + 1``.

    Directions that hold under ``LEFT_OUT`` of the forecast's variance are left out of its inverse."""
    ahead = f.select("ens", "n", (F.col("k") - 1).alias("k"), F.col("f").alias("g"))
    both = a.join(ahead, ["ens", "n", "k"])
    g, x = (lambda i: F.get("g", i)), (lambda i: F.get("a", i))
    every = range(dims)
    s = both.groupBy("ens", "k").agg(
        F.count(F.lit(1)).cast("double").alias("size"), F.array(*[F.sum(g(i)) for i in every]).alias("gs"), F.array(*[F.sum(x(i)) for i in every]).alias("xs"),
        F.array(*[F.sum(g(i) * g(j)) for i in every for j in every]).alias("gg"), F.array(*[F.sum(g(i) * x(j)) for i in every for j in every]).alias("gx"),
    )

    def run(batches):
        for pdf in batches:
            size = pdf["size"].to_numpy()[:, None, None]
            gs, xs = (np.array(pdf[c].to_list()).reshape(-1, dims) for c in ("gs", "xs"))
            gg, gx = (np.array(pdf[c].to_list()).reshape(-1, dims, dims) for c in ("gg", "gx"))
            if len(pdf):
                gg, gx = gg - gs[:, :, None] * gs[:, None] / size, gx - gs[:, :, None] * xs[:, None] / size
                lam, vec = np.linalg.eigh(gg)
                share = np.cumsum(np.maximum(lam, 0), 1) / np.maximum(np.sum(np.maximum(lam, 0), 1), 1e-300)[:, None]
                inv = np.where(share > LEFT_OUT, 1 / np.where(lam > 0, lam, np.inf), 0.0)
                gain = relax * (vec * inv[:, None]) @ np.swapaxes(vec, 1, 2) @ gx
            else:
                gain = gx
            yield pd.DataFrame({"ens": pdf["ens"], "k": pdf["k"], "j": gain.reshape(-1, dims * dims).tolist()})

    return s.mapInPandas(run, "ens long, k long, j array<double>")


def ensemble_rts(forecast: DataFrame, analysis: DataFrame, dims: int, relax: float = 1.0, size: int = 256, chunk: int = 256) -> DataFrame:
    """(ens, n, k, i, x): the smoothed ensemble, from forecasts and analyses (ens, n, k, i, x) with i under ``dims``.

    Times are whole numbers without gaps. ``relax`` multiplies the gain. A task holds ``chunk`` members at ``size`` times."""
    f, a = wide(forecast, dims, "f"), wide(analysis, dims, "a")
    gains = backward_gains(f, a, dims, relax)
    ahead = f.join(a, ["ens", "n", "k"]).select("ens", "n", (F.col("k") - 1).alias("k"), F.zip_with("a", "f", lambda x, y: x - y).alias("e"))
    t = a.join(ahead, ["ens", "n", "k"], "left").join(gains, ["ens", "k"], "left")
    t = t.select("ens", "n", "k", "a", "e", "j", F.floor(F.col("k") / size).cast("long").alias("blk"), F.floor(F.col("n") / chunk).cast("long").alias("part"))

    def run(pdf: pd.DataFrame, come: np.ndarray) -> tuple[list, list[int], np.ndarray, np.ndarray]:
        """Changes at each time of a block from those (members, dims) just after it; and the product of its maps."""
        change, product, out, times = come, np.eye(dims), [], sorted(pdf["k"].unique(), reverse=True)
        for k in times:
            rows = pdf[pdf["k"] == k].sort_values("n")
            if rows["j"].iat[0] is None:  # the last time
                change, product = np.zeros_like(come), np.zeros((dims, dims))
            else:
                j = np.array(rows["j"].iat[0]).reshape(dims, dims)
                change, product = (change + np.array(rows["e"].to_list())) @ j, product @ j
            out.append(change)
        return out, times, change, product

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.sort(pdf["n"].unique())
        _, _, change, product = run(pdf, np.zeros((len(n), dims)))
        return pd.DataFrame({"ens": pdf["ens"].iat[0], "n": n, "blk": pdf["blk"].iat[0], "c": change.tolist(), "p": [product.ravel().tolist()] * len(n)})

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        """Changes that come into each block of one member, from the last block on."""
        pdf, come, out = pdf.sort_values("blk", ascending=False), np.zeros(dims), []
        for c, p in zip(pdf["c"], pdf["p"], strict=True):
            out.append(come.tolist())
            come = np.array(c) + come @ np.array(p).reshape(dims, dims)
        return pd.DataFrame({"ens": pdf["ens"], "n": pdf["n"], "blk": pdf["blk"], "come": out})

    def finished(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.drop_duplicates("n").sort_values("n")
        out, times, _, _ = run(pdf, np.array(first["come"].to_list()))
        rows = [pdf[pdf["k"] == k].sort_values("n") for k in times]
        x = np.array([np.array(r["a"].to_list()) + c for r, c in zip(rows, out, strict=True)])
        return pd.DataFrame({"ens": pdf["ens"].iat[0], "n": np.tile(first["n"].to_numpy(), len(times)), "k": np.repeat(times, len(first)), "s": x.reshape(-1, dims).tolist()})

    ends = t.groupBy("ens", "part", "blk").applyInPandas(summed, "ens long, n long, blk long, c array<double>, p array<double>")
    come = ends.groupBy("ens", "n").applyInPandas(linked, "ens long, n long, blk long, come array<double>")
    s = t.join(come, ["ens", "n", "blk"]).groupBy("ens", "part", "blk").applyInPandas(finished, "ens long, n long, k long, s array<double>")
    return s.select("ens", "n", "k", F.posexplode("s").alias("i", "x")).withColumn("i", F.col("i").cast("long"))


def lag_states(e: DataFrame, dims: int) -> DataFrame:
    """(ens, n, k, i, x): a long state as a series of states of ``dims`` variables."""
    return e.select("ens", "n", F.floor(F.col("i") / dims).cast("long").alias("k"), (F.col("i") % dims).alias("i"), "x")


def analysed(t: DataFrame, every: int, obs: float, r: float) -> DataFrame:
    """(ens, n, k, i, x): at each ``every``-th time the first variable is observed and all move by half-gain regression."""
    by = Window.partitionBy("ens", "k", "n")
    o = t.withColumn("o", F.max(F.when(F.col("i") == 0, F.col("x"))).over(by))
    m = o.groupBy("ens", "k", "i").agg(F.covar_samp("x", "o").alias("c"), F.var_samp("o").alias("v"), F.avg("o").alias("ym"))
    hit = (F.col("k") % every) == every - 1
    gain = F.col("c") / (F.col("v") + r)
    return o.join(m, ["ens", "k", "i"]).select("ens", "n", "k", "i", F.when(hit, F.col("x") + gain * (obs - F.col("ym")) - 0.5 * gain * (F.col("o") - F.col("ym"))).otherwise(F.col("x")).alias("x"))

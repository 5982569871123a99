"""Assimilation as DataFrame jobs: baselines by windows, linear-Gaussian recursions by key, ensemble updates by joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlake.functions.ensemble import KEY, anomalies
from twinlake.functions.series import BLOCK, blocked
from twinlake.plans.matrix_kalman import Model, kalman_matrix


def climatology(s: DataFrame) -> DataFrame:
    """(sys, mu, var): mean and variance of the whole series."""
    return s.groupBy("sys").agg(F.avg("y").alias("mu"), F.var_samp("y").alias("var"))


def persistence(s: DataFrame) -> DataFrame:
    """(sys, k, y, forecast): the last value; none at the start."""
    d = blocked(s, before=1).withColumn("forecast", F.lag("y").over(Window.partitionBy("sys", "blk").orderBy("k")))
    return d.where("own").select(*s.columns, "forecast")


def previous_observation(s: DataFrame, every: int) -> DataFrame:
    """As-of: the latest value at a multiple of ``every`` strictly before each step."""
    w = Window.partitionBy("sys", "blk").orderBy("k").rowsBetween(-every, -1)
    d = blocked(s, before=every).withColumn("forecast", F.last(F.when(F.col("k") % every == 0, F.col("y")), ignorenulls=True).over(w))
    return d.where("own").select(*s.columns, "forecast")


def optimal_interpolation(s: DataFrame, r: float, scale: float = 1.0) -> DataFrame:
    """(sys, k, y, analysis): the climatology as background with variance times ``scale``, one update a step.

    With scale 1 this is optimal interpolation, with another a fixed-background variational update."""
    c = climatology(s)
    b = F.col("var") * scale
    return s.join(c, "sys").select("sys", "k", "y", (F.col("mu") + b / (b + r) * (F.col("y") - F.col("mu"))).alias("analysis"))


def kalman(s: DataFrame, f: float, q: float, r: float, smooth: bool = False, size: int = BLOCK) -> DataFrame:
    """(sys, k, y, forecast, mean, var[, smoothed]): the scalar Kalman filter of each series (k from 1, without gaps).

    Starts from the first observation with variance r. ``smooth`` adds the backward pass. A scan over blocks of ``size`` steps
    with whole arrays (see ``matrix_kalman``): no task holds a whole series, and none loops over rows."""
    one = lambda x: np.array([[float(x)]])
    model = Model(one(f), one(q), one(1), one(r), np.zeros(1), one(0), fresh=True)
    out = kalman_matrix(s.select("sys", "k", F.array("y").alias("y")), model, smooth, size=size)
    more = [F.get("smoothed", 0).alias("smoothed")] if smooth else []
    return s.join(out, ["sys", "k"]).select("sys", "k", "y", F.get("forecast", 0).alias("forecast"), F.get("mean", 0).alias("mean"), F.get("cov", 0).alias("var"), *more)


def scalar_update(e: DataFrame, index: int, obs: float, r: float, flavour: str = "DEnKF") -> DataFrame:
    """(ens, n, i, x) after one observation of state ``index``, without perturbing it.

    Gains are regressions on the observed state. DEnKF moves anomalies by half the gain, Serial (Potter's
    square root) by gain / (1 + sqrt(r / (r + var)))."""
    a = anomalies(e)
    y = a.where(F.col("i") == index).select("ens", "n", F.col("a").alias("ya"), F.col("mu").alias("ym"))
    j = a.join(y, ["ens", "n"])
    cov = j.groupBy(KEY).agg((F.sum(F.col("a") * F.col("ya")) / (F.count(F.lit(1)) - 1)).alias("c"))
    var = cov.where(F.col("i") == index).select("ens", F.col("c").alias("v"))
    j = j.join(cov, KEY).join(var, "ens")
    gain = F.col("c") / (F.col("v") + r)
    part = F.lit(0.5) if flavour == "DEnKF" else 1 / (1 + F.sqrt(F.lit(r) / (F.col("v") + r)))
    return j.select("ens", "n", "i", (F.col("x") + gain * (obs - F.col("ym")) - part * gain * F.col("ya")).alias("x"))


def scheduled(s: DataFrame, plan: DataFrame, slot) -> DataFrame:
    """Adds ``mu``, the estimate that ``plan`` (slot, mu) gives beforehand for the slot of each step."""
    return s.withColumn("slot", slot).join(plan, "slot").drop("slot")

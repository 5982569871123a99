"""Statistics of estimates over time: phases of the cycle, assessment against the truth, averages in time.

Estimates are (sys, k, ko, sub, mu, var), statistics (sys, stat, sub, k, ko, value). ``sub`` is the phase: ``f``
forecast, ``a`` analysis and ``s`` smoothed at observation times, ``i`` at every step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlake.functions.ensemble import crps_gauss, field_summaries, moments, uniform_weights
from twinlake.functions.series import mean_with_confidence


def observation_number(k: Column, every: int) -> Column:
    """Observations come every ``every`` steps, numbered from nought; there is none at the start."""
    return F.when((k % every == 0) & (k > 0), (k / every - 1).cast("long"))


def phases(steps: DataFrame, every: int) -> DataFrame:
    """Estimates by phase of (sys, k, forecast, forecast_var, mean, var).

    At an observation time the forecast is ``f``, the analysis ``a`` and ``i``; between, the forecast is ``i``. Steps
    without a forecast yet have no phases."""
    d = steps.where("forecast is not null").withColumn("ko", observation_number(F.col("k"), every))
    one = lambda sub, mu, var: F.struct(F.lit(sub).alias("sub"), F.col(mu).alias("mu"), F.col(var).alias("var"))
    seen = F.array(one("f", "forecast", "forecast_var"), one("a", "mean", "var"), one("i", "mean", "var"))
    between = F.array(one("i", "forecast", "forecast_var"))
    return d.select("sys", "k", "ko", F.inline(F.when(F.col("ko").isNotNull(), seen).otherwise(between)))


def assess(estimates: DataFrame, truth: DataFrame) -> DataFrame:
    """(sys, stat, sub, k, ko, value): err, rms, spread, mad, crps and gscore of Gauss estimates against (sys, k, x).

    An observation at the start is an error, as are a missing mean and a variance under nought. Without variance
    there are no gscore and crps (null)."""
    e = estimates.join(truth, ["sys", "k"])
    bad = F.when((F.col("k") == 0) & F.col("ko").isNotNull(), F.raise_error(F.lit("there is no observation at the start")))
    bad = bad.when(F.col("mu").isNull() | F.isnan("mu") | (F.col("var") < 0), F.raise_error(F.lit("an estimate needs a mean, and a variance that is not under nought")))
    e = e.withColumn("err", F.col("mu") - F.col("x") + F.coalesce(bad.cast("double"), F.lit(0.0)))
    sd = F.sqrt("var")
    some = lambda c: F.when(F.col("var") > 0, c)
    values = {"err": F.col("err"), "rms": F.abs("err"), "spread": sd, "mad": sd * 0.7978845608028654, "crps": some(crps_gauss(F.col("x"), F.col("mu"), sd)), "gscore": some(2 * F.log(sd) + (F.col("err") / sd) ** 2)}  # sqrt(2 / pi) relates the two for Gauss
    return e.select("sys", "sub", "k", "ko", F.inline(F.array(*[F.struct(F.lit(n).alias("stat"), v.alias("value")) for n, v in values.items()]))).select("sys", "stat", "sub", "k", "ko", "value")


def assess_ensembles(e: DataFrame, truth: DataFrame, sectors: DataFrame | None = None) -> DataFrame:
    """(ens, k, stat, part, m, ms, rms, ma, gm): ensembles (ens, k, n, i, x[, w]) against (k, i, truth), summarised over the field.

    Statistics of each variable are err, spread, mad, skew, kurt, crps, gscore and rh; ``part`` is ``field`` or a sector of
    ``sectors`` (sector, i), which may overlap. A weight sum that is not one, and a member that is not finite, are errors;
    without variance skew, kurt and gscore are null and left out of the summaries."""
    bad = F.when(F.col("x").isNull() | F.isnan("x") | (F.abs("x") == float("inf")), F.raise_error(F.lit("a member is not finite")))
    keyed = e.select(F.struct("ens", "k").alias("ens"), "n", "i", (F.col("x") + F.coalesce(bad.cast("double"), F.lit(0.0))).alias("x"), *(["w"] if "w" in e.columns else []))
    if "w" in e.columns:
        total = keyed.groupBy("ens", "i").agg(F.sum("w").alias("t"))
        off = F.when(F.abs(F.col("t") - 1) > 1e-5, F.raise_error(F.lit("weights do not add up to one")))
        keyed = keyed.join(total, ["ens", "i"]).withColumn("w", F.col("w") + F.coalesce(off.cast("double"), F.lit(0.0))).drop("t")
    else:
        keyed = uniform_weights(keyed)
    x = truth.select("k", "i", "truth")
    at = lambda d: d.withColumn("k", F.col("ens.k")).join(x, ["k", "i"])
    own = at(keyed)
    point = own.select("ens", "i", "truth").distinct()
    one = moments(keyed).join(point, ["ens", "i"])
    err, sd = F.col("mu") - F.col("truth"), F.col("spread")
    one = one.select("ens", "i", err.alias("err"), "spread", "mad", "skew", "kurt", F.when(sd > 0, 2 * F.log(sd) + (err / sd) ** 2).alias("gscore"))
    below = own.groupBy("ens", "i").agg(F.sum((F.col("x") < F.col("truth")).cast("long")).cast("double").alias("rh"))
    one = one.join(crps_of(own), ["ens", "i"]).join(below, ["ens", "i"])
    names = ["err", "spread", "mad", "skew", "kurt", "gscore", "crps", "rh"]
    long = one.select("ens", "i", F.inline(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).alias("value")) for n in names]))).where("value is not null")
    whole = field_summaries(long.withColumn("part", F.lit("field")), "value", ["ens", "stat", "part"])
    if sectors is not None:
        whole = whole.unionByName(field_summaries(long.join(sectors.withColumnRenamed("sector", "part"), "i"), "value", ["ens", "stat", "part"]))
    return whole.select("ens.ens", "ens.k", "stat", "part", "m", "ms", "rms", "ma", "gm")


def crps_of(own: DataFrame) -> DataFrame:
    """(ens, i, crps) of rows that carry their ``truth``: members in order and running sums, no pairs."""
    below = Window.partitionBy("ens", "i").orderBy("x", "n").rowsBetween(Window.unboundedPreceding, -1)
    o = own.withColumns({"wb": F.coalesce(F.sum("w").over(below), F.lit(0.0)), "sb": F.coalesce(F.sum(F.col("w") * F.col("x")).over(below), F.lit(0.0))})
    pair = F.sum(F.col("w") * (F.col("x") * F.col("wb") - F.col("sb")))
    return o.groupBy("ens", "i").agg((F.sum(F.col("w") * F.abs(F.col("x") - F.col("truth"))) - pair).alias("crps"))


def register(stats: DataFrame, name: str, of: str, value: Column) -> DataFrame:
    """``stats`` with one more statistic: ``value``, a column over the rows of statistic ``of``."""
    return stats.unionByName(stats.where(F.col("stat") == of).withColumn("value", value).withColumn("stat", F.lit(name)))


def after_burn_in(stats: DataFrame, burn_in: float, dt: float, every: int) -> DataFrame:
    """Rows after ``burn_in``: phase ``i`` by its step, all others by their observation's."""
    step = F.when(F.col("sub") == "i", F.col("k")).otherwise((F.col("ko") + 1) * every)
    return stats.where(step * dt > burn_in)


def average_in_time(stats: DataFrame, burn_in: float, dt: float, every: int) -> DataFrame:
    """(sys, stat, sub, val, prec): time averages by system, statistic and phase, with correlation-aware confidence.

    A series without any finite value is left out; one with some that are not finite averages to NaN."""
    d = after_burn_in(stats, burn_in, dt, every)
    value = F.coalesce(F.col("value"), F.lit(float("nan")))
    d = d.select(F.struct("sys", "stat", "sub").alias("series"), F.when(F.col("sub") == "i", F.col("k")).otherwise(F.col("ko")).alias("k"), value.alias("value"))
    some = d.groupBy("series").agg(F.bool_or(~F.isnan("value") & (F.abs("value") < float("inf"))).alias("some")).where("some").select("series")
    m = mean_with_confidence(d.join(some, "series"), "series", "k", "value")
    return m.select("series.sys", "series.stat", "series.sub", "val", "prec")

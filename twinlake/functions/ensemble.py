"""Ensemble statistics as aggregations of the long table (ens, n, i, x[, w]).

Every sum is a plain aggregate with partial results before its shuffle; only CRPS orders the members of
one ensemble and index, which a window does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["ens", "i"]


def uniform_weights(e: DataFrame) -> DataFrame:
    """Adds ``w``, one over the number of members."""
    return e.join(e.groupBy("ens").agg((1 / F.count_distinct("n")).alias("w")), "ens")


def normalised(e: DataFrame, raw: Column) -> DataFrame:
    """Adds ``w`` in proportion to ``raw``, which depends on (ens, n); weights of an ensemble sum to one."""
    r = e.select("ens", "n", raw.alias("r")).distinct()
    total = r.groupBy("ens").agg(F.sum("r").alias("t"))
    return e.join(r.join(total, "ens").select("ens", "n", (F.col("r") / F.col("t")).alias("w")), ["ens", "n"])


def centre(e: DataFrame) -> DataFrame:
    """(ens, i, mu, ub): weighted mean, and the factor that makes the weighted variance unbiased.

    The factor is one where nearly all weight lies on one member, for which no variance is left."""
    ub = F.when(1 - F.max("w") < 1e-10, F.lit(1.0)).otherwise(1 / (1 - F.sum(F.col("w") * F.col("w"))))
    return e.groupBy(KEY).agg(F.sum(F.col("w") * F.col("x")).alias("mu"), ub.alias("ub"))


def anomalies(e: DataFrame, rescale: bool = False) -> DataFrame:
    """Adds ``mu`` and ``a = x - mu``; with ``rescale`` times sqrt(N / (N - 1))."""
    c = e.groupBy(KEY).agg(F.avg("x").alias("mu"), F.count(F.lit(1)).alias("size"))
    a = F.col("x") - F.col("mu")
    return e.join(c, KEY).withColumn("a", a * F.sqrt(F.col("size") / (F.col("size") - 1)) if rescale else a).drop("size")


def inflated(e: DataFrame, factor: float) -> DataFrame:
    """Members moved away from their mean by ``factor``."""
    return anomalies(e).select("ens", "n", "i", (F.col("mu") + factor * F.col("a")).alias("x"))


def moments(e: DataFrame) -> DataFrame:
    """(ens, i, mu, var, spread, skew, kurt, mad) of a weighted ensemble; shape statistics are null where var is 0."""
    d = F.col("x") - F.col("mu")
    s = e.join(centre(e), KEY).groupBy(*KEY, "mu", "ub").agg(*[F.sum(F.col("w") * d**p).alias(f"m{p}") for p in (2, 3, 4)], F.sum(F.col("w") * F.abs(d)).alias("mad"))
    var = F.col("ub") * F.col("m2")
    s = s.withColumn("var", var)
    return s.select(*KEY, "mu", "var", F.sqrt("var").alias("spread"), F.when(F.col("var") > 0, F.col("m3") / F.col("var") ** 1.5).alias("skew"), F.when(F.col("var") > 0, F.col("m4") / F.col("var") ** 2 - 3).alias("kurt"), "mad")


def errors(e: DataFrame, truth: DataFrame) -> DataFrame:
    """(ens, i, err, spread, gscore) against ``truth`` (i, truth)."""
    m = moments(e).join(truth, "i")
    err = F.col("mu") - F.col("truth")
    return m.select(*KEY, err.alias("err"), "spread", (2 * F.log("spread") + (err / F.col("spread")) ** 2).alias("gscore"))


def field_summaries(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, mean square, root mean square, mean absolute value and geometric mean over the field."""
    v = F.col(value)
    return df.groupBy(by).agg(F.avg(v).alias("m"), F.avg(v * v).alias("ms"), F.sqrt(F.avg(v * v)).alias("rms"), F.avg(F.abs(v)).alias("ma"), F.exp(F.avg(F.log(F.abs(v)))).alias("gm"))


def sector_summaries(df: DataFrame, value: str, sectors: DataFrame, by: list[str]) -> DataFrame:
    """Field summaries of each sector; ``sectors`` is (sector, i), and sectors may overlap."""
    return field_summaries(df.join(sectors, "i"), value, [*by, "sector"])


def rank_of_truth(e: DataFrame, truth: DataFrame) -> DataFrame:
    """(ens, i, rh): members below the truth."""
    return e.join(truth, "i").groupBy(KEY).agg(F.sum((F.col("x") < F.col("truth")).cast("long")).alias("rh"))


def rank_histogram(ranks: DataFrame) -> DataFrame:
    """(ens, rh, density) over the field."""
    total = ranks.groupBy("ens").agg(F.count(F.lit(1)).alias("t"))
    return ranks.groupBy("ens", "rh").agg(F.count(F.lit(1)).alias("c")).join(total, "ens").select("ens", "rh", (F.col("c") / F.col("t")).alias("density"))


def crps(e: DataFrame, truth: DataFrame) -> DataFrame:
    """(ens, i, crps): sum w |x - truth| less half the weighted mean distance of two members.

    With members in order, the pair sum is a running sum: no pair is formed."""
    below = Window.partitionBy(KEY).orderBy("x", "n").rowsBetween(Window.unboundedPreceding, -1)
    o = e.join(truth, "i").withColumns({"wb": F.coalesce(F.sum("w").over(below), F.lit(0.0)), "sb": F.coalesce(F.sum(F.col("w") * F.col("x")).over(below), F.lit(0.0))})
    pair = F.sum(F.col("w") * (F.col("x") * F.col("wb") - F.col("sb")))
    return o.groupBy(KEY).agg((F.sum(F.col("w") * F.abs(F.col("x") - F.col("truth"))) - pair).alias("crps"))


def covariance(e: DataFrame, dims: int) -> DataFrame:
    """(ens, i, j, cov, corr) for i <= j among the first ``dims`` indices; pairs of one member only."""
    a = anomalies(e.where(F.col("i") < dims)).groupBy("ens", "n").agg(F.array_sort(F.collect_list(F.struct("i", "a"))).alias("v"))
    p = a.select("ens", F.explode(F.flatten(F.transform("v", lambda p: F.transform(F.filter("v", lambda q: q.i >= p.i), lambda q: F.struct(p.i.alias("i"), q.i.alias("j"), (p.a * q.a).alias("ab")))))).alias("p"))
    c = p.groupBy("ens", "p.i", "p.j").agg((F.sum("p.ab") / (F.count(F.lit(1)) - 1)).alias("cov"))
    d = c.where("i = j")
    left, right = d.select("ens", "i", F.col("cov").alias("vi")), d.select("ens", F.col("i").alias("j"), F.col("cov").alias("vj"))
    return c.join(left, ["ens", "i"]).join(right, ["ens", "j"]).select("ens", "i", "j", "cov", (F.col("cov") / F.sqrt(F.col("vi") * F.col("vj"))).alias("corr"))


def circulant_acf(c: DataFrame, dims: int) -> DataFrame:
    """(ens, lag, acf): mean of the covariances at each distance on a ring of ``dims``."""
    both = c.select("ens", "i", "j", "cov").unionByName(c.where("i < j").select("ens", F.col("j").alias("i"), F.col("i").alias("j"), "cov"))
    return both.groupBy("ens", F.pmod(F.col("j") - F.col("i"), F.lit(dims)).alias("lag")).agg((F.sum("cov") / dims).alias("acf"))


#: Abramowitz and Stegun's 7.1.26, whose error is under 1.5e-7.
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z: Column) -> Column:
    """The Gauss distribution function, by a rational approximation of erf: there is no built-in one."""
    v = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * v)
    p = F.lit(0.0)
    for c in reversed(_ERF):
        p = (p + c) * t
    half = 0.5 * p * F.exp(-v * v)
    return F.when(z >= 0, 1 - half).otherwise(half)


def crps_gauss(x: Column, mu: Column, sd: Column) -> Column:
    """CRPS of a Gauss estimate against ``x``."""
    z = (x - mu) / sd
    return sd * (z * (2 * normal_cdf(z) - 1) + 2 * F.exp(-z * z / 2) / F.sqrt(2 * F.pi()) - 1 / F.sqrt(F.pi()))

"""Time series: autocovariance, AR(1) fit, correlation length, means with correlation-aware confidence.

Series are numbered by ``k`` without gaps and are dealt out in blocks of ``BLOCK`` numbers, with copies of the rows
next to a block's ends where a window looks over them: no task holds a whole series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAGS = 4
BLOCK = 4096


def blocked(s: DataFrame, before: int = 0, after: int = 0, time: str = "k", size: int = BLOCK) -> DataFrame:
    """Adds ``blk`` and ``own``: each row in its block, and once more (not ``own``) in a block that looks back or ahead to it."""
    own, at = F.floor(F.col(time) / size).cast("long"), F.col(time) % size
    more = [F.when(at >= size - before, own + 1)] * (before > 0) + [F.when(at < after, own - 1)] * (after > 0)
    d = s.withColumn("blk", F.explode(F.filter(F.array(own, *more), lambda b: b.isNotNull())))
    return d.withColumn("own", F.col("blk") == own)


def autocovariance(s: DataFrame, lags: int = LAGS, key: str = "sys", time: str = "k", value: str = "y") -> DataFrame:
    """(key, n, mu, acov): lagged products about the mean of the whole series, over the number of pairs."""
    c = s.join(s.groupBy(key).agg(F.avg(value).alias("mu"), F.count(value).alias("n")), key).withColumn("a", F.col(value) - F.col("mu"))
    w = Window.partitionBy(key, "blk").orderBy(time)
    c = blocked(c, after=lags, time=time).withColumns({f"p{i}": F.col("a") * F.lead("a", i).over(w) for i in range(lags + 1)}).where("own")
    return c.groupBy(key, "n", "mu").agg(F.array(*[F.sum(f"p{i}") / (F.col("n") - i) for i in range(lags + 1)]).alias("acov"), F.max(F.abs("a")).alias("far"))


def ar1(acov: Column) -> Column:
    """The AR(1) coefficient: geometric mean of successive ratios before the first value that is not positive.

    Nought if there is no such value, 0.01 if there is one. The ratios telescope."""
    bad = F.filter(F.transform(acov, lambda v, i: F.when(v <= 0, i)), lambda i: i.isNotNull())
    m = F.coalesce(F.get(bad, 0), F.size(acov))
    return F.when(m == 0, 0.0).when(m == 1, 0.01).otherwise(F.pow(F.get(acov, m - 1) / F.get(acov, 0), 1.0 / (m - 1)))


def correlation_length(a: Column) -> Column:
    return F.when(a == 0, 0.0).otherwise(1 / F.log(1 / a))


def mean_with_confidence(s: DataFrame, key: str = "sys", time: str = "k", value: str = "y") -> DataFrame:
    """(key, val, prec): mean and its standard deviation, corrected for correlation.

    NaN for five values or fewer; nought for a series that hardly moves."""
    c = autocovariance(s, LAGS, key, time, value).withColumn("a", ar1(F.col("acov")))
    n, a = F.col("n"), F.col("a")
    sum_ = ((n - 1) * a - n * a**2 + F.pow(a, n + 1)) / (1 - a) ** 2
    prec = F.sqrt(F.get("acov", 0) / n * (1 + 2 / n * sum_))
    still = F.col("far") <= 1e-8 + 1e-5 * F.abs("mu")
    return c.select(key, F.col("mu").alias("val"), F.when(n <= 5, float("nan")).when(still, 0.0).otherwise(prec).alias("prec"))


def running(s: DataFrame, key: str = "sys", time: str = "k", value: str = "y") -> DataFrame:
    """Adds ``before`` (the sum of all values before), ``so_far`` (with the row's own) and ``count`` (values so far).

    Sums of whole blocks of numbers, put in order a row a block, and sums inside a block."""
    w = Window.partitionBy(key, "blk").orderBy(time)
    d = blocked(s, time=time).withColumns({
        "_own": F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_sum": F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)), "_n": F.count(value).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    })
    ahead = Window.partitionBy(key).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    whole = blocked(s, time=time).groupBy(key, "blk").agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    whole = whole.select(F.col(key).alias("_key"), F.col("blk").alias("_blk"), F.coalesce(F.sum("s").over(ahead), F.lit(0.0)).alias("_base"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_many"))
    d = d.join(whole, F.col(key).eqNullSafe(F.col("_key")) & (F.col("blk") == F.col("_blk")))
    return d.select(*s.columns, (F.col("_base") + F.col("_own")).alias("before"), (F.col("_base") + F.col("_sum")).alias("so_far"), (F.col("_many") + F.col("_n")).alias("count"))


def rolling(s: DataFrame, before: int, key: str = "sys", time: str = "k", value: str = "y") -> DataFrame:
    """Adds ``rolling``, the mean of the last ``before + 1`` values, and ``running``, that of all so far."""
    w = Window.partitionBy(key, "blk").orderBy(time).rowsBetween(-before, 0)
    d = blocked(s, before, time=time).withColumn("rolling", F.avg(value).over(w)).where("own").select(*s.columns, "rolling")
    return running(d, key, time, value).withColumn("running", F.col("so_far") / F.col("count")).select(*s.columns, "rolling", "running")


def after_burn_in(s: DataFrame, burn_in: float, dt: float, time: str = "k") -> DataFrame:
    return s.where(F.col(time) * dt > burn_in)


def ring_mean(e: DataFrame, half: int, dims: int, half_ends: bool = False) -> DataFrame:
    """Circular moving average over ``2 * half + 1`` neighbours of each member; with ``half_ends`` the two outer ones count half."""
    wide = e.unionByName(e.where(F.col("i") < half).withColumn("i", F.col("i") + dims)).unionByName(e.where(F.col("i") >= dims - half).withColumn("i", F.col("i") - dims))
    by = Window.partitionBy("ens", "n").orderBy("i")
    w = by.rowsBetween(-half, half)
    ends = (F.first("x").over(w) + F.last("x").over(w)) / 2
    x = (F.sum("x").over(w) - ends) / (2 * half) if half_ends and half else F.avg("x").over(w)
    return wide.withColumn("x", x).where(F.col("i").between(0, dims - 1))


def logistic(k: Column, at: float, length: float, base: float) -> Column:
    """Logistic growth towards one, with the value ``at`` at ``k = base`` and rate one over ``length``."""
    import math

    return 1 / (1 + F.exp(-(math.log(at / (1 - at)) + (k - base) / length)))


def polynomials(s: DataFrame, x: Column, y: Column, degrees: list[int], key: str = "sys") -> DataFrame:
    """(key, degree, coefficients): least squares of ``y`` by powers of ``x``, lowest first, a row a degree.

    Sums of powers are plain aggregates of one pass; each small system is solved by elimination in columns."""
    top = max(degrees)
    d = s.select(key, x.alias("_x"), y.alias("_y"))
    m = d.groupBy(key).agg(*[F.sum(F.pow("_x", F.lit(float(p)))).alias(f"s{p}") for p in range(2 * top + 1)], *[F.sum(F.pow("_x", F.lit(float(p))) * F.col("_y")).alias(f"t{p}") for p in range(top + 1)])

    def solved(n: int) -> Column:
        a = [[F.col(f"s{i + j}") for j in range(n + 1)] + [F.col(f"t{i}")] for i in range(n + 1)]
        for i in range(n + 1):
            a[i] = [v / a[i][i] for v in a[i]]
            for k in range(n + 1):
                if k != i:
                    a[k] = [u - a[k][i] * v for u, v in zip(a[k], a[i], strict=True)]
        return F.array(*[row[-1] for row in a])

    return m.select(key, F.inline(F.array(*[F.struct(F.lit(n).alias("degree"), solved(n).alias("coefficients")) for n in degrees])))

"""Particle filters: reweighting, degeneracy, tempering and resampling as windows and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.functions.series import running

#: Particles to a slice of the running sum, on average.
SLICE = 256


def reweight(p: DataFrame, loglik: Column) -> DataFrame:
    """New ``w`` by Bayes' rule in logs: no likelihood underflows. Input (sys, n, w)."""
    lw = F.log("w") + loglik
    d = p.withColumn("lw", lw)
    top = d.groupBy("sys").agg(F.max("lw").alias("top"))
    d = d.join(top, "sys").withColumn("e", F.exp(F.col("lw") - F.col("top")))
    total = d.groupBy("sys").agg(F.sum("e").alias("total"))
    return d.join(total, "sys").withColumn("w", F.col("e") / F.col("total")).drop("lw", "top", "e", "total")


def effective_size(p: DataFrame) -> DataFrame:
    """(sys, n_eff, size, degenerate)."""
    return p.groupBy("sys").agg((1 / F.sum(F.col("w") * F.col("w"))).alias("n_eff"), F.count(F.lit(1)).alias("size"), (1 - F.max("w") < 1e-10).alias("degenerate"))


def tempered(p: DataFrame, root: float) -> DataFrame:
    """Adds ``sw``, weights flattened by ``root`` and normalised, and ``s = sw / w``."""
    d = p.withColumn("s0", F.least(F.pow("w", F.lit(1 / root - 1)), F.lit(1e100)))
    total = d.groupBy("sys").agg(F.sum(F.col("s0") * F.col("w")).alias("total"))
    return d.join(total, "sys").withColumn("s", F.col("s0") / F.col("total")).withColumn("sw", F.col("s") * F.col("w")).drop("s0", "total")


def systematic(p: DataFrame, u: float) -> DataFrame:
    """(sys, n, copies): how often a comb of N teeth at (u + j) / N falls in each particle's share.

    The teeth in a share are a difference of two ceilings of the running sum: no tooth is made."""
    size = p.groupBy("sys").agg(F.count(F.lit(1)).alias("size"))
    d = running(p, time="n", value="w").join(size, "sys")
    at = lambda c: F.greatest(F.least(F.floor(F.round(c, 13) * F.col("size") - u) + 1, F.col("size")), F.lit(0))
    last = F.col("count") == F.col("size")  # what rounding leaves of the last share belongs to it
    return d.select("sys", "n", (F.when(last, F.col("size")).otherwise(at(F.col("so_far"))) - at(F.col("before"))).cast("long").alias("copies"))


def residual(p: DataFrame) -> DataFrame:
    """(sys, n, copies, rest): whole copies, and what is left of N w, normalised, for a draw."""
    size = p.groupBy("sys").agg(F.count(F.lit(1)).alias("size"))
    d = p.join(size, "sys").withColumn("nw", F.col("w") * F.col("size")).withColumn("copies", F.floor("nw").cast("long")).withColumn("left", F.col("nw") - F.col("copies"))
    total = d.groupBy("sys").agg(F.sum("left").alias("total"))
    return d.join(total, "sys").select("sys", "n", "copies", (F.col("left") / F.col("total")).alias("rest"))


def multinomial(p: DataFrame, draws: DataFrame) -> DataFrame:
    """(sys, n, copies): how many of the draws (sys, u), u in [0, 1), fall in each particle's share of the running sum.

    Shares and draws are dealt to slices of [0, 1) and meet there: a share takes part in each slice that it reaches
    into, so no task holds a whole system and no draw is compared to a particle elsewhere."""
    size = p.groupBy("sys").agg(F.count(F.lit(1)).alias("size"))
    many = F.greatest(F.lit(1), F.ceil(F.col("size") / SLICE)).cast("long")
    d = running(p, time="n", value="w").join(size, "sys").withColumn("many", many)
    hi = F.when(F.col("count") == F.col("size"), F.lit(2.0)).otherwise(F.col("so_far"))
    slice_ = lambda c: F.least(F.floor(c * F.col("many")), F.col("many") - 1).cast("long")
    shares = d.select("sys", "n", F.col("before").alias("lo"), hi.alias("hi"), F.explode(F.sequence(slice_(F.col("before")), slice_(hi))).alias("slice"))
    u = draws.join(size.withColumn("many", many), "sys").select("sys", "u", slice_(F.col("u")).alias("slice"))
    hit = shares.join(u, ["sys", "slice"]).where("u >= lo and u < hi").groupBy("sys", "n").agg(F.count(F.lit(1)).alias("copies"))
    return p.select("sys", "n").join(hit, ["sys", "n"], "left").select("sys", "n", F.coalesce("copies", F.lit(0)).cast("long").alias("copies"))


def residual_draws(p: DataFrame, u: Column) -> DataFrame:
    """(sys, n, copies): whole copies of N w, and one more for each draw of the rest that falls to a particle.

    ``u``, in [0, 1), is over sys and j, the number of the draw from nought. The shares are read several times and
    are kept for that: they are as many rows as particles."""
    r = residual(p).persist()
    left = r.groupBy("sys").agg((F.count(F.lit(1)) - F.sum("copies")).alias("left")).where("left > 0")
    draws = left.select("sys", F.explode(F.sequence(F.lit(0).cast("long"), F.col("left") - 1)).alias("j")).select("sys", u.alias("u"))
    more = multinomial(r.select("sys", "n", F.col("rest").alias("w")), draws)
    return r.join(more.withColumnRenamed("copies", "more"), ["sys", "n"]).select("sys", "n", (F.col("copies") + F.col("more")).alias("copies"))


def duplicates(copies: DataFrame) -> DataFrame:
    """(sys, n, copy, again): one row per drawn particle; ``again`` marks those to be jittered."""
    d = copies.where("copies > 0").select("sys", "n", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"), "copies")
    return d.select("sys", "n", "copy", (F.col("copies") > 1).alias("again"))


def bandwidth(size: Column, dims: int) -> Column:
    """Scott's rule: the width of a jitter kernel."""
    return F.pow(size, F.lit(-1.0 / (dims + 4)))


def adaptive_root(p: DataFrame, share: float, step: float, at_once: int = 32) -> DataFrame:
    """(sys, root): the least of 1, 1 + step, ... after whose flattening the effective size is ``share`` of all.

    The effective size grows with the root, so steps are first doubled, all doublings at once, and then the bracket of
    each system is cut in ``at_once`` parts until it is one step; a row a particle and root is summed by system before
    the shuffle. Null where no root suits: too few particles have any weight."""
    size = p.groupBy("sys").agg(F.count(F.lit(1)).alias("size"))
    some = p.where("w > 0").select("sys", "w")

    def reached(tried: DataFrame) -> DataFrame:
        """(sys, k, ok) of particles (sys, w, k)."""
        v = F.pow("w", 1 / (1 + step * F.col("k")))
        s = tried.groupBy("sys", "k").agg((F.sum(v) * F.sum(v) / F.sum(v * v)).alias("n_eff")).join(size, "sys")
        return s.select("sys", "k", (F.col("n_eff") >= share * F.col("size")).alias("ok"))

    powers = F.array(*[F.lit((1 << j) - 1).cast("long") for j in range(41)])
    ends = lambda d: d.groupBy("sys").agg(F.max(F.when(~F.col("ok"), F.col("k"))).alias("lo"), F.min(F.when(F.col("ok"), F.col("k"))).alias("hi"))
    b = ends(reached(some.withColumn("k", F.explode(powers)))).withColumn("lo", F.coalesce("lo", F.lit(-1)))
    while (b.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0) > 1:
        part = F.transform(F.sequence(F.lit(1), F.lit(at_once)), lambda i: F.col("lo") + F.ceil((F.col("hi") - F.col("lo")) * i / at_once))
        cut = some.join(b.where("hi - lo > 1"), "sys").select("sys", "w", F.explode(F.array_distinct(part)).alias("k"))
        c = ends(reached(cut)).select("sys", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        b = b.join(c, "sys", "left").select("sys", F.coalesce("lo2", "lo").alias("lo"), F.coalesce("hi2", "hi").alias("hi"))
    return b.select("sys", (1 + step * F.col("hi")).alias("root"))


def coloured(p: DataFrame, value: str = "y") -> DataFrame:
    """Adds ``c``, the weighted anomaly whose squares add up to the unbiased weighted variance."""
    from twinlake.functions.ensemble import centre

    c = centre(p.select(F.col("sys").alias("ens"), F.lit(0).alias("i"), "w", F.col(value).alias("x"))).select(F.col("ens").alias("sys"), "mu", "ub")
    return p.join(c, "sys").withColumn("c", F.sqrt(F.col("ub") * F.col("w")) * (F.col(value) - F.col("mu")))


def jittered(drawn: DataFrame, width: float, seed: int, value: str = "y") -> DataFrame:
    """Repeats (``again``) moved by a Gauss draw of standard deviation ``width`` that depends on (sys, n, copy) alone."""
    from twinlake.functions.draws import gauss

    return drawn.withColumn(value, F.col(value) + F.when(F.col("again"), width * gauss(seed, F.col("sys"), F.col("n"), F.col("copy"))).otherwise(0.0))


def laplace_loglik(innovation: Column, spread: float) -> Column:
    """Log likelihood, up to a constant, of a double exponential error with standard deviation ``spread``."""
    return -(2.0**0.5) * F.abs(innovation) / spread

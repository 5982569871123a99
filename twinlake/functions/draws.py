"""Random draws as columns: hashes of a row's own keys, so a row's draw is the same in any task, order or retry.

All have mean nought and unit variance. ``keys`` name the row (say trajectory, step and index)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column, part: str = "uniform") -> Column:
    """Strictly between 0 and 1, of 52 bits. ``part`` names what the draw is for: parts of one seed are independent."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(part), *keys), 12).cast("double") + 0.5) / float(1 << 52)


def gauss(seed: int, *keys: Column, part: str = "gauss") -> Column:
    """Box and Muller's transform of two uniforms."""
    return F.sqrt(-2 * F.log(uniform(seed, *keys, part=part + "/length"))) * F.cos(2 * math.pi * uniform(seed, *keys, part=part + "/angle"))


def exponential(seed: int, *keys: Column, part: str = "exponential") -> Column:
    return -F.log(uniform(seed, *keys, part=part))


def cube(seed: int, *keys: Column) -> Column:
    """Uniform, each coordinate by itself."""
    return (uniform(seed, *keys, part="cube") - 0.5) * math.sqrt(12)


def laplace(seed: int, row: list[Column], *keys: Column) -> Column:
    """Elliptical: one exponential factor a ``row`` (its keys) on a Gauss draw for each of ``keys``."""
    return exponential(seed, *row, part="laplace/row") * gauss(seed, *keys, part="laplace") / math.sqrt(2)


def laplace_parallel(seed: int, *keys: Column) -> Column:
    """Double exponential, each coordinate by itself."""
    side = F.when(uniform(seed, *keys, part="laplace parallel/side") < 0.5, -1.0).otherwise(1.0)
    return side * exponential(seed, *keys, part="laplace parallel") / math.sqrt(2)


def student(seed: int, dof: int, row: list[Column], *keys: Column) -> Column:
    """Student's t of a whole ``dof`` over 2, scaled to unit variance; one factor a ``row``."""
    chi2 = sum((gauss(seed, *row, part=f"student/row {k}") ** 2 for k in range(dof)), F.lit(0.0))
    return gauss(seed, *keys, part="student") * math.sqrt(dof) / F.sqrt(chi2) * math.sqrt((dof - 2) / dof)


def ball(e: DataFrame, row: list[str], index: str, dims: int, seed: int, out: str = "x") -> DataFrame:
    """Adds ``out``: each row's coordinates are uniform in a ball of radius 2 (a direction by ``dims`` Gauss draws)."""
    g = gauss(seed, *[F.col(c) for c in row], F.col(index), part="ball")
    length = F.sqrt(F.sum(F.col("_g") ** 2).over(Window.partitionBy(row)))
    radius = 2 * F.pow(uniform(seed, *[F.col(c) for c in row], part="ball/radius"), F.lit(1 / dims))
    return e.withColumn("_g", g).withColumn(out, F.col("_g") / length * radius).drop("_g")


def coloured(draw, mean: list[float], cov: list[list[float]]) -> list[Column]:
    """Columns of a draw with a full mean and covariance: ``draw(j)`` is a standard draw, keyed by the row, for coordinate j.

    A number for ``cov`` is that variance in every coordinate. The factor is of the size of one state of few dimensions."""
    import numpy as np

    c = np.eye(len(mean)) * cov if np.isscalar(cov) else np.asarray(cov, "f8")
    d, v = np.linalg.eigh(c)
    if d.min() < -1e-9 * max(1.0, d.max()):
        raise ValueError("a covariance has no negative directions")
    root = np.linalg.cholesky(c) if d.min() > 0 else v * np.sqrt(np.maximum(d, 0))
    return [F.lit(float(mean[i])) + sum((float(root[i, j]) * draw(j) for j in range(len(mean)) if root[i, j]), F.lit(0.0)) for i in range(len(mean))]


def sampled(u: Column, kind: str, **of) -> Column:
    """A draw from a uniform one, by kind: ``icdf`` (a function of u) or ``cdf`` (values and their running probabilities)."""
    if kind == "icdf":
        return of["icdf"](u)
    if kind == "cdf":
        steps = list(zip(of["values"], of["cdf"], strict=True))
        out = F.when(u < steps[0][1], F.lit(steps[0][0]))
        for v, p in steps[1:-1]:
            out = out.when(u < p, F.lit(v))
        return out.otherwise(F.lit(steps[-1][0]))
    raise ValueError(f"no such kind: {kind}")


def tabulated(spark, cdf, lo: float, hi: float, steps: int = 1000) -> DataFrame:
    """(u, x, u2, x2): a distribution function (``cdf`` of a column) at ``steps`` even places of [lo, hi], each with the next one."""
    t = spark.range(steps + 1).select((F.lit(lo) + F.col("id") * ((hi - lo) / steps)).alias("x")).withColumn("u", cdf(F.col("x")))
    ahead = Window.orderBy("x")  # a table of ``steps`` rows
    return t.select("u", "x", F.lead("u").over(ahead).alias("u2"), F.lead("x").over(ahead).alias("x2")).where("u2 > u")


def integrated(spark, density, lo: float, hi: float, steps: int = 1000) -> DataFrame:
    """The same from a density by the rule of trapezia, brought to one at the end."""
    wide = (hi - lo) / steps
    t = spark.range(steps + 1).select((F.lit(lo) + F.col("id") * wide).alias("x")).withColumn("p", density(F.col("x")))
    order = Window.orderBy("x")  # a table of ``steps`` rows
    t = t.withColumn("a", (F.col("p") + F.lead("p").over(order)) * (wide / 2))
    t = t.withColumn("u", F.coalesce(F.sum("a").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("u", F.col("u") / F.max("u").over(Window.partitionBy()))
    return t.select("u", "x", F.lead("u").over(order).alias("u2"), F.lead("x").over(order).alias("x2")).where("u2 > u")


def by_table(rows: DataFrame, table: DataFrame, u: Column, out: str = "x", cells: int = 4096) -> DataFrame:
    """``rows`` and ``out``: the inverse of a tabulated distribution function at ``u``, linear between its places.

    An as-of join by cells of the unit interval: a row of the table is in each cell that it touches, a row has one cell. Before
    the first place and after the last one the ends of the table hold."""
    t = table.withColumn("_c", F.explode(F.sequence(F.floor(F.col("u") * cells).cast("int"), F.floor(F.least(F.col("u2"), F.lit(1.0)) * cells).cast("int"))))
    t = t.select("_c", F.col("u").alias("_u"), F.col("x").alias("_x"), F.col("u2").alias("_u2"), F.col("x2").alias("_x2"))
    ends = table.agg(F.min("u").alias("_first"), F.max("u2").alias("_last"))  # one row
    d = rows.withColumn("_v", u).join(F.broadcast(ends)).withColumn("_v", F.least(F.greatest("_v", "_first"), "_last"))
    d = d.withColumn("_d", F.floor(F.col("_v") * cells).cast("int"))
    on = (F.col("_d") == F.col("_c")) & (F.col("_v") >= F.col("_u")) & ((F.col("_v") < F.col("_u2")) | ((F.col("_v") == F.col("_last")) & (F.col("_u2") == F.col("_last"))))
    return d.join(t, on).select(*rows.columns, (F.col("_x") + (F.col("_v") - F.col("_u")) / (F.col("_u2") - F.col("_u")) * (F.col("_x2") - F.col("_x"))).alias(out))

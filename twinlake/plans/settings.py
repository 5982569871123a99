"""Named settings of twin experiments: model, sizes, times and errors, as a table to join or filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KIND = "name string, model string, nx int, ny int, dt double, dko int, burn_in double, r double, c0 double"
#: Fixed values of published settings: sizes, step, steps an observation, burn-in, variances of observations and starts.
SETTINGS = [
    ("lorenz63_sakov2012", "lorenz63", 3, 3, 0.01, 25, 16.0, 2.0, 2.0),
    ("lorenz63_anderson2010", "lorenz63", 3, 3, 0.01, 12, 16.0, 8.0, 2.0),
    ("lorenz84_pajonk2012", "lorenz84", 3, 3, 0.05, 1, 2.0, 0.1, 0.01),
    ("lorenz84_harder", "lorenz84", 3, 3, 0.05, 10, 20.0, 0.1, 0.01),
    ("lorenz96_sakov2008", "lorenz96", 40, 40, 0.05, 1, 20.0, 1.0, 0.001),
    ("lorenz96_bocquet2010", "lorenz96", 10, 5, 0.05, 1, 20.0, 2.25, 0.001),
    ("two_scale_lorenz96", "two_scale", 396, 36, 0.005, 10, 6.0, 1.0, 0.01),
    ("advection_small", "advection", 100, 4, 1.0, 5, -1.0, 0.01, 1.0),
    ("lorenz63_bocquet2012", "lorenz63", 3, 3, 0.01, 25, 16.0, 1.0, 2.0),
    ("lotka_volterra", "lotka_volterra", 4, 2, 0.5, 20, 100.0, 0.0016, 0.0001),
    ("ikeda", "ikeda", 2, 2, 1.0, 1, 40.0, 0.1, 0.1),
    ("double_pendulum", "double_pendulum", 4, 2, 0.01, 100, 10.0, 0.01, 0.0001),
]


def settings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SETTINGS, KIND)


def load(name: str) -> dict:
    """One setting by its name; an unknown name is an error that tells the known ones."""
    columns = [c.split()[0] for c in KIND.split(", ")]
    found = [dict(zip(columns, row, strict=True)) for row in SETTINGS if row[0] == name]
    if not found:
        raise KeyError(f"there is no setting {name}; there are {', '.join(row[0] for row in SETTINGS)}")
    return found[0]


def configured(s: DataFrame, *names: str) -> DataFrame:
    """(sys, name, model, steps, observed, counted) of series (sys, k): a row a series and setting (all, or those named); steps,
    those with an observation, and those after burn-in. Settings stand in each row as one array, so series are read once."""
    some = [load(n) for n in names or [row[0] for row in SETTINGS]]
    every = F.array(*[F.struct(*[F.lit(c[k]).alias(k) for k in ("name", "model", "dko", "dt", "burn_in")]) for c in some])
    d = s.select("sys", "k", F.inline(every))
    return d.groupBy("sys", "name", "model").agg(F.count(F.lit(1)).alias("steps"), F.sum((F.col("k") % F.col("dko") == 0).cast("long")).alias("observed"), F.sum((F.col("k") * F.col("dt") > F.col("burn_in")).cast("long")).alias("counted"))

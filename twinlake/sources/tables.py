"""Sources: time grids, ensembles, observation series and experiment tables as long DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grids(last: DataFrame, dt: float, dko: int, size: int = 4096) -> DataFrame:
    """(sys, k, ko, t, dt) for each row of (sys, last): a uniform grid of whole observation periods; no observation at the start.

    The number of steps is rounded up to a multiple of ``dko``; ``ko`` is null between observations. A long grid is dealt out
    in pieces of ``size`` steps before it is spelled out."""
    end = (F.ceil(F.col("last") / dko) * dko).cast("long")
    d = last.select("sys", end.alias("end")).select("sys", "end", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("end") / size))).alias("piece")).repartition("sys", "piece")
    d = d.select("sys", F.explode(F.sequence(F.col("piece") * size, F.least(F.col("end"), F.col("piece") * size + size - 1))).alias("k"))
    ko = F.when((F.col("k") % dko == 0) & (F.col("k") > 0), (F.col("k") / dko - 1).cast("long"))
    return d.select("sys", "k", ko.alias("ko"), (F.col("k") * dt).alias("t"), F.when(F.col("k") > 0, F.lit(dt)).alias("dt"))


def ensembles(df: DataFrame, ens: str = "label", member: str = "vec_id", state: str = "embedding") -> DataFrame:
    """(ens, n, i, x): one row per ensemble, member and state index, of one array a member."""
    return df.select(F.col(ens).cast("long").alias("ens"), F.col(member).cast("long").alias("n"), F.posexplode(state).alias("i", "x")).select("ens", "n", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))


def series(events: DataFrame, system: str = "event_type", time: str = "ts", value: str = "value", width: str = "hour") -> DataFrame:
    """(sys, k, y): observations of each system, numbered in order of time.

    Counts by system and span of time (``width``) give each span its first number, so a task numbers one span of one
    system at a time, and only a count a span is put in order for a whole system."""
    e = events.select(F.col(system).alias("sys"), F.date_trunc(width, F.col(time)).alias("span"), F.col(time).alias("t"), "event_id", F.col(value).alias("y"))
    ahead = Window.partitionBy("sys").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    n = e.groupBy("sys", "span").agg(F.count(F.lit(1)).alias("n"))
    base = n.select(F.col("sys").alias("s"), F.col("span").alias("p"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    d = e.join(base, F.col("sys").eqNullSafe(F.col("s")) & F.col("span").eqNullSafe(F.col("p")))
    k = F.col("base") + F.row_number().over(Window.partitionBy("sys", "span").orderBy("t", "event_id"))
    return d.select("sys", k.cast("long").alias("k"), "y")

"""Observation operators on the long table (ens, n, i, x): what is seen of a state is a join or a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def even_sites(spark: SparkSession, size: int, count: int, periodic: bool = True) -> DataFrame:
    """(j, i): ``count`` state indices at even distances, rounded down; on a ring the end is not a site."""
    step = size / count if periodic else (size - 1) / max(1, count - 1)
    return spark.range(count).select(F.col("id").alias("j"), F.floor(F.col("id") * step + 1e-9).cast("long").alias("i"))


def selected(e: DataFrame, sites: DataFrame) -> DataFrame:
    """(ens, n, j, y): the state at the sites; the few sites are the small side of the join."""
    return e.join(sites, "i").select("ens", "n", "j", F.col("x").alias("y"))


def interpolated(e: DataFrame, sites: DataFrame, size: int) -> DataFrame:
    """(ens, n, j, y) at positions (j, pos) between state indices on a ring: two weighted neighbours."""
    low = F.floor("pos").cast("long")
    part = F.col("pos") - low
    both = F.explode(F.array(F.struct(F.pmod(low, F.lit(size)).alias("i"), (1 - part).alias("h")), F.struct(F.pmod(low + 1, F.lit(size)).alias("i"), part.alias("h"))))
    h = sites.select("j", both.alias("at")).select("j", "at.*")
    return e.join(h, "i").groupBy("ens", "n", "j").agg(F.sum(F.col("h") * F.col("x")).alias("y"))


def alternating(e: DataFrame, time: Column, parts: int = 2) -> DataFrame:
    """Rows whose index is seen at observation time ``time``: one residue class after another."""
    return e.where(F.pmod(F.col("i"), F.lit(parts)) == F.pmod(time, F.lit(parts)))


def shifted_sites(sites: DataFrame, time: Column, size: int, most: int, seed: int) -> DataFrame:
    """(j, i) moved along by up to ``most``, by a draw that depends on the observation time alone."""
    from twinlake.functions.draws import uniform

    return sites.withColumn("i", F.pmod(F.col("i") + F.floor(uniform(seed, time) * most).cast("long"), F.lit(size)))


def tracked(e: DataFrame, sites: DataFrame, offset: Column, size: int) -> DataFrame:
    """(ens, n, j, y): the state at sites (j, i) moved along a ring by ``offset``, a column over the member's keys."""
    back = F.pmod(F.col("i") - offset, F.lit(size))
    return e.withColumn("site", back).join(sites.select("j", F.col("i").alias("site")), "site").select("ens", "n", "j", F.col("x").alias("y"))

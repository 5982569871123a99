"""Checks that ride along with a job: metrics of the same pass, warnings once, and steps as a table function."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import AnalyzeResult

_SAID: set = set()


def once(key: str, say) -> bool:
    """Call ``say()`` the first time that ``key`` comes in this process; whether it was called."""
    if key in _SAID:
        return False
    _SAID.add(key)
    say()
    return True


def watched(df: DataFrame, name: str, *values: str) -> tuple[DataFrame, Observation]:
    """``df``, and metrics of the given columns that are counted while its first action runs: rows, and for each column its finite
    values, least and largest. No pass of its own."""
    o = Observation(name)
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c))
    parts = [m for c in values for m in (F.count(finite(c)).alias(f"{c}_finite"), F.min(finite(c)).alias(f"{c}_least"), F.max(finite(c)).alias(f"{c}_most"))]
    return df.observe(o, F.count(F.lit(1)).alias("rows"), *parts), o


def warn_of(o: Observation, name: str, *values: str) -> dict:
    """The metrics once they are there; a column that is not finite somewhere, or does not vary, is warned of once."""
    m = o.get
    for c in values:
        if m[f"{c}_finite"] < m["rows"]:
            once(f"{name}.{c}: not finite", lambda c=c: warnings.warn(f"{name}: {c} has {m['rows'] - m[f'{c}_finite']} rows that are null or not finite", stacklevel=3))
        elif m["rows"] > 1 and m[f"{c}_least"] == m[f"{c}_most"]:
            once(f"{name}.{c}: no variance", lambda c=c: warnings.warn(f"{name}: {c} does not vary", stacklevel=3))
    return m


class Steps:
    """Table function ``steps(last, every, dt[, burn_in])``: a row a step up to ``last``, with its observation number (null between
    observations) and time; with ``burn_in`` also whether it counts."""

    @staticmethod
    def analyze(last, every, dt, burn_in=None) -> AnalyzeResult:
        from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

        out = StructType().add("k", LongType()).add("ko", LongType()).add("t", DoubleType())
        return AnalyzeResult(schema=out if burn_in is None else out.add("counts", BooleanType()))

    def eval(self, last, every, dt, burn_in=None):
        for k in range(1, last + 1):
            row = (k, k // every - 1 if k % every == 0 else None, k * dt)
            yield row if burn_in is None else (*row, k * dt > burn_in)


def register(spark: SparkSession) -> None:
    """The table functions of this module, for SQL."""
    spark.udtf.register("steps", F.udtf(Steps))

"""Online assimilation: a filter's state by key, fed by a stream; windows with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The table as a stream; its time becomes a timestamp, which a watermark needs."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def online_kalman(s: DataFrame, f: float, q: float, r: float) -> DataFrame:
    """(sys, event_id, forecast, mean, var) of a stream (sys, ts, event_id, y): the state is (mean, variance, time).

    Within a micro-batch observations are taken in order of time; one not after the state's time comes too
    late and gives nulls."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m, p, last, seen = state.get if state.exists else (0.0, 0.0, -1, -1)
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        rows = []
        for e, t, y in zip(pdf["event_id"], pdf["ts"].astype("int64"), pdf["y"], strict=True):
            if (t, e) <= (last, seen):
                rows.append((key[0], e, None, None, None))
                continue
            fc, pf = (f * m, f * f * p + q) if last >= 0 else (y, r)
            g = pf / (pf + r) if last >= 0 else 0.0
            m, p, last, seen = fc + g * (y - fc), (1 - g) * pf, int(t), int(e)
            rows.append((key[0], e, fc, m, p))
        state.update((float(m), float(p), last, seen))
        yield pd.DataFrame(rows, columns=["sys", "event_id", "forecast", "mean", "var"])

    return s.groupBy("sys").applyInPandasWithState(step, "sys string, event_id long, forecast double, mean double, var double", "m double, p double, last long, seen long", "append", GroupStateTimeout.NoTimeout)


def windowed(s: DataFrame, width: str, late: str) -> DataFrame:
    """(sys, start, n, mean): tumbling windows, closed ``late`` after their end."""
    w = s.withWatermark("ts", late).groupBy("sys", F.window("ts", width).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean")).select("sys", F.col("w.start").alias("start"), "n", "mean")


def drained(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """All that the stream gives for what is there now, as a table under ``path``."""
    spark = df.sparkSession
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).format("parquet").option("path", f"{path}/rows").start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/rows")

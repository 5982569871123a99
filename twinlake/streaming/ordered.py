"""An online filter that puts late rows in order: pending rows are list state, and an event-time timer takes them in once the
watermark has passed, so results do not depend on how rows are dealt to micro-batches."""

from __future__ import annotations

import contextlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from twinlake.plans.matrix_kalman import Model, T, V, elements, joined, scanned

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "sys string, event_id long, mean array<double>, cov array<double>"


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """Timers and lists as state need the store that lies on disk; the caller's setting comes back."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


#: Rows of a pack that is put back.
PACK = 10_000


def packed(t: np.ndarray, event_id: np.ndarray, y: np.ndarray) -> tuple[bytes, bytes, bytes]:
    return t.astype("<i8").tobytes(), event_id.astype("<i8").tobytes(), y.astype("<f8").tobytes()


def unpacked(packs: Iterable[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of all packs by time, then id."""
    columns = list(zip(*packs, strict=True)) or [(), (), ()]
    t, e, y = (np.frombuffer(b"".join(bytes(x) for x in c), kind) for c, kind in zip(columns, ("<i8", "<i8", "<f8"), strict=True))
    order = np.lexsort((e, t))
    return t[order], e[order], y[order]


class OrderedFilter(StatefulProcessor):
    """State by key: the estimate (mean, covariance), the last row taken in, and rows whose time the watermark has not passed.

    Pending rows are kept in packs, as many as came at once, whose columns are bytes: a row by itself costs a call to the store
    when it comes and another when it goes."""

    def __init__(self, model: Model):
        self.model = model

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("estimate", "m array<double>, p array<double>, last long, seen long")
        self.pending = handle.getListState("pending", "t binary, event_id binary, y binary")

    def _late(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sys": key[0], "event_id": rows["event_id"], "mean": None, "cov": None})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.at.get()[2:] if self.at.exists() else (-(1 << 62), -1)
        for pdf in rows:
            t, e = pdf["ts"].to_numpy().astype("datetime64[us]").astype("i8"), pdf["event_id"].to_numpy()
            late = (t < last[0]) | ((t == last[0]) & (e <= last[1]))
            if late.any():
                yield self._late(key, pdf[late])
            if not late.all():
                self.pending.appendValue(packed(t[~late], e[~late], pdf["y"][~late].to_numpy()))
                self.handle.registerTimer(int(t[~late].max()) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs()
        rows = unpacked(self.pending.get()) if self.pending.exists() else unpacked([])
        closing = rows[0] // 1000 < closed
        if not closing.any():
            return
        (t, ids, y), wait = (x[closing] for x in rows), [x[~closing] for x in rows]
        self.pending.put([packed(*(x[k : k + PACK] for x in wait)) for k in range(0, len(wait[0]), PACK)]) if len(wait[0]) else self.pending.clear()
        d = len(self.model.m0)
        m, p = (np.array(x) for x in self.at.get()[:2]) if self.at.exists() else (self.model.m0, self.model.p0.ravel())
        p = p.reshape(d, d)
        a, b, c, e, j = scanned(elements(self.model, y[:, None]), joined)
        left = a @ np.linalg.inv(np.eye(d) + p @ j)
        mean, cov = V(left, m + V(p[None], e)) + b, left @ p @ T(a) + c
        self.at.update(([float(x) for x in mean[-1]], [float(x) for x in cov[-1].ravel()], int(t[-1]), int(ids[-1])))
        yield pd.DataFrame({"sys": key[0], "event_id": ids, "mean": mean.tolist(), "cov": cov.reshape(-1, d * d).tolist()})

    def close(self) -> None:
        pass


def ordered_kalman(s: DataFrame, model: Model, delay: str = "0 seconds") -> DataFrame:
    """(sys, event_id, mean, cov) of a stream (sys, ts, event_id, y): each row once the watermark (``delay`` behind) has passed it.

    Rows of a system are taken in by time, then id, whatever their order of arrival; one that comes after a later one has
    been taken in gives nulls. What is held in memory are the rows within the delay."""
    d = s.select("sys", "ts", "event_id", "y").withWatermark("ts", delay)
    return d.groupBy("sys").transformWithStateInPandas(OrderedFilter(model), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def slices(spark: SparkSession, rows: DataFrame, path: str, files: int) -> DataFrame:
    """Write ``rows`` in order of time as ``files`` files, one after the other; a stream takes files in order of age."""
    lo, hi = rows.agg(F.min("ts"), F.max("ts")).first()
    wide = (hi - lo) / files
    for k in range(files):
        own = (F.col("ts") >= lo + k * wide) & (F.col("ts") < lo + (k + 1) * wide) if k < files - 1 else F.col("ts") >= lo + k * wide
        rows.where(own).repartition(1).write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def sliced_stream(spark: SparkSession, rows: DataFrame, path: str, files_a_batch: int) -> DataFrame:
    """The files of ``slices`` as a stream of at most ``files_a_batch`` files a micro-batch."""
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)

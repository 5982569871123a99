"""The ordered online filter: the same rows however files are dealt to micro-batches; metrics and warnings on the way."""

import warnings

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from twinlake.functions import checks
from twinlake.plans.matrix_kalman import Model, kalman_matrix
from twinlake.streaming.online import drained
from twinlake.streaming.ordered import STORE, ordered_kalman, sliced_stream, slices, state_store

MODEL = Model(np.array([[1.0, 1.0], [0.0, 0.9]]), np.diag([4.0, 0.25]), np.array([[1.0, 0.0]]), np.array([[50.0]]), np.array([50.0, 0.0]), np.diag([400.0, 4.0]))


def events(spark, n=120):
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("sys"), F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 2) * 60).alias("ts"), F.col("id").alias("event_id"), (50 + 20 * F.sin(F.col("id"))).alias("y"))
    return spark.createDataFrame(rows.collect(), rows.schema)


def run(spark, e, path, files, per_batch, delay="0 seconds"):
    slices(spark, e, f"{path}/in", files)
    before = spark.conf.get(STORE)
    with state_store(spark):
        out = drained(ordered_kalman(sliced_stream(spark, e, f"{path}/in", per_batch), MODEL, delay), f"{path}/out").collect()
    assert spark.conf.get(STORE) == before
    return {r.event_id: (tuple(np.round(r["mean"], 8)), tuple(np.round(r["cov"], 8))) for r in out}


def test_same_rows_for_any_batches(spark, tmp_path):
    e = events(spark)
    got = [run(spark, e, f"{tmp_path}/{k}", files, per) for k, (files, per) in enumerate(((1, 1), (7, 1), (10, 3), (10, 100)))]
    assert all(g == got[0] for g in got[1:])
    k = e.select("sys", F.row_number().over(Window.partitionBy("sys").orderBy("ts", "event_id")).cast("long").alias("k"), "event_id", F.array("y").alias("y"))
    want = {r.event_id: tuple(np.round(r["mean"], 8)) for r in kalman_matrix(k.drop("event_id"), MODEL).join(k.select("sys", "k", "event_id"), ["sys", "k"]).collect()}
    last = e.agg(F.max("ts")).first()[0]
    closed = {r.event_id for r in e.where(F.col("ts") < F.lit(last)).collect()}
    assert set(got[0]) == closed and all(got[0][i][0] == want[i] for i in closed)


def test_rows_out_of_order_within_the_delay(spark, tmp_path):
    """Pairs of files come in the wrong order: with a delay the rows are as if they had come in order."""
    e = events(spark, 80)
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    for k in (1, 0, 3, 2):
        own = (F.col("ts") >= F.lit(lo + k * (hi - lo) / 4)) & (F.col("ts") <= F.lit(lo + (k + 1) * (hi - lo) / 4))
        e.where(own).dropDuplicates().subtract(e.where(F.col("ts") == F.lit(lo + (k + 1) * (hi - lo) / 4)) if k < 3 else e.limit(0)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    with state_store(spark):
        out = drained(ordered_kalman(sliced_stream(spark, e, f"{tmp_path}/in", 1), MODEL, "20 minutes"), f"{tmp_path}/out").collect()
    straight = run(spark, e, f"{tmp_path}/s", 1, 1)
    got = {r.event_id: tuple(np.round(r["mean"], 8)) for r in out}
    assert got and None not in got.values() and all(straight[i][0] == m for i, m in got.items())


def test_metrics_of_the_same_pass_and_warnings_once(spark):
    d = spark.range(10).select(F.lit(2.0).alias("same"), F.when(F.col("id") == 3, float("nan")).otherwise(F.col("id")).alias("some"))
    for again in (False, True):
        df, o = checks.watched(d, f"m{again}", "same", "some")
        assert df.count() == 10
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            m = checks.warn_of(o, "test", "same", "some")
        assert (m["rows"], m["some_finite"], m["some_most"]) == (10, 9, 9.0)
        assert [str(w.message) for w in said] == ([] if again else ["test: same does not vary", "test: some has 1 rows that are null or not finite"])


def test_steps_as_a_table_function(spark):
    checks.register(spark)
    assert spark.sql("SELECT * FROM steps(6, 3, 0.5D)").collect() == [(k, k // 3 - 1 if k % 3 == 0 else None, k * 0.5) for k in range(1, 7)]
    assert spark.sql("SELECT * FROM steps(2, 3, 0.5D, 0.6D)").columns == ["k", "ko", "t", "counts"]
    assert spark.sql("SELECT * FROM steps(0, 3, 0.5D)").collect() == []


@pytest.mark.parametrize("n", [0, 1])
def test_small_streams(spark, tmp_path, n):
    e = events(spark, 1).limit(n) if n == 0 else events(spark, 1)
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    with state_store(spark):
        assert drained(ordered_kalman(sliced_stream(spark, e, f"{tmp_path}/in", 1), MODEL), f"{tmp_path}/out").collect() == []

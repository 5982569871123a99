"""What grew with the square of a group's rows: roots of weights, frames to the end, sums over near points."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlake.operators import assimilation as da
from twinlake.operators import localization as lo
from twinlake.operators import noise as no
from twinlake.streaming import ordered


@pytest.mark.parametrize("sharp", [0.1, 3.0, 40.0])
def test_root_of_weights_without_the_matrix(sharp):
    """As the matrix gives it, also where most weights are nearly nought or nought."""
    rng = np.random.default_rng(1)
    y, a = rng.normal(size=(400, 2)), rng.normal(size=(400, 3))
    got = da.second_order_weights(y, np.array([0.3, -0.1]), 1 / sharp)(a)
    lw = -0.5 * ((np.array([0.3, -0.1]) - y) ** 2).sum(1) * sharp**2
    w = np.exp(lw - lw.max())
    w /= w.sum()
    s, v = np.linalg.eigh(np.diag(w) - np.outer(w, w))
    assert np.allclose(got, np.sqrt(400) * (v * np.sqrt(np.maximum(s, 0))) @ v.T @ a + w @ a, atol=1e-6)


def test_weights_of_many_members():
    rng = np.random.default_rng(2)
    y, a = rng.normal(size=(20_000, 1)), rng.normal(size=(20_000, 2))
    began = time.time()
    new = da.second_order_weights(y, np.array([0.5]))(a)  # a matrix would hold 3.2 GB
    assert time.time() - began < 30
    w = np.exp(-0.5 * (0.5 - y[:, 0]) ** 2)
    w /= w.sum()
    assert np.allclose(new.mean(0), w @ a, atol=1e-9) and np.allclose(np.cov(new.T, bias=True), (a * w[:, None]).T @ a - np.outer(w @ a, w @ a), atol=1e-8)


def test_rank_histogram_of_many_members(spark):
    """No frame reaches to the end: Spark goes through such a one anew for every row."""
    e = spark.range(30_000).select(F.lit(1).cast("long").alias("ens"), F.col("id").alias("n"), F.lit(0).cast("long").alias("i"), F.sin(F.col("id") * 1.7).alias("x"))
    new = da.rank_histogram_update(e, 0, 0.1, 0.5)
    assert "currentrow$(), unboundedfollowing" not in new._jdf.queryExecution().optimizedPlan().toString().lower()
    assert new.where("x is not null").count() == 30_000


@pytest.mark.parametrize("cells", [200, 4000])
def test_sums_over_near_points(spark, cells):
    """On a ring, also across its seam and where points lie just at the reach."""
    points = spark.range(2000).select((F.col("id") % 3).alias("batch"), (F.col("id") * 7.31 % 360).cast("double").alias("pos"))
    sites = spark.range(120).select("id", (F.col("id") * 3.7 % 360).cast("double").alias("pos"))
    got = {(r.batch, r.s): (r.n, r.total) for r in lo.near_sums(points, sites, 9.0, 360.0, cells).collect()}
    p, b = (np.array(points.select(c).toPandas()[c]) for c in ("pos", "batch"))
    for s, pos in enumerate(np.array(sites.orderBy("id").toPandas()["pos"])):
        d = np.abs(p - pos)
        d = np.minimum(d, 360 - d)
        for k in range(3):
            own = d[(d <= 9) & (b == k)]
            n, total = got.get((k, s), (0, 0.0))
            assert n == len(own) and total == pytest.approx(own.sum(), abs=1e-7)


def test_pending_rows_are_kept_in_packs():
    """A pack a batch of rows, whatever its rows; those that wait are put back in packs, in order of time and id."""
    t, ids, y = np.array([5, 3, 5]), np.array([2, 9, 1]), np.array([0.5, np.nan, -1.0])
    packs = [ordered.packed(t, ids, y), ordered.packed(t[:1] - 4, ids[:1], y[:1])]
    assert all(isinstance(x, bytes) for p in packs for x in p)
    got = ordered.unpacked(packs)
    assert got[0].tolist() == [1, 3, 5, 5] and got[1].tolist() == [2, 9, 1, 2] and np.array_equal(got[2], [0.5, np.nan, -1.0, 0.5], equal_nan=True)
    assert [len(x) for x in ordered.unpacked([])] == [0, 0, 0]


def test_jitter_by_blocks_of_members(spark, monkeypatch):
    """Blocks cut anywhere give what the whole products do; an index that the colouring lacks stays, with its repeat's sum of squares."""
    monkeypatch.setattr(no, "BLOCK", 7)
    monkeypatch.setattr(no, "ROWS", 4)
    rng = np.random.default_rng(4)
    c = {ens: rng.normal(size=(m, 3)) for ens, m in ((1, 30), (2, 7), (3, 1))}
    source = spark.createDataFrame([(ens, m, i, float(a[m, i])) for ens, a in c.items() for m in range(len(a)) for i in range(3)], "ens long, m long, i long, c double")
    rows = spark.createDataFrame([(ens, n, k, i, 1.0, k > 0) for ens in c for n in range(11) for k in range(n % 3 + 1) for i in range(4)], "ens long, n long, copy long, i long, x double, again boolean")
    out = no.jittered_rows(rows, source, lambda m: F.sin(m * 1.3 + F.col("n") * 0.7 + F.col("copy"))).collect()
    assert len(out) == rows.count()
    for r in out:
        a = c[r.ens]
        d = np.sin(np.arange(len(a)) * 1.3 + r.n * 0.7 + r.copy)
        assert r.x == pytest.approx(1 + (d @ a[:, r.i] if r.copy and r.i < 3 else 0)) and (r.chi2 == pytest.approx((d**2).sum() * min(1, 3 / len(a))) if r.copy else r.chi2 is None)

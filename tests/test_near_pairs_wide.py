"""Pairs within a reach: cells of sites that touch one another round a ring, and how many rows are made for them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlake.operators import localization as lo


def near(spark, dims=1, n=3000, m=40, reach=9.0, cell=0.9):
    frame = lambda k, step: spark.range(k).select(F.col("id"), F.array(*[(F.col("id") * (step + d) % 360).cast("double") for d in range(dims)]).alias("pos"))
    return frame(n, 7.31), frame(m, 3.7), lo.near_points(frame(n, 7.31), frame(m, 3.7), dims, cell, reach, [360.0] * dims)


def test_sites_go_to_cells_not_points(spark):
    """Points, which are more, are not repeated; and a pair's distance needs no array and no function of higher order."""
    *_, pairs = near(spark)
    plan = lo.local_observations(pairs, 4.0, "GC")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1
    above = plan[: plan.index("Join")]
    assert "lambda" not in above and "array" not in above and ".pos" not in above


@pytest.mark.parametrize("kind", list(lo.FACTORS))
def test_tapers_by_plain_arithmetic(spark, kind):
    """The weights above the cutoff are all there, whether or not pairs are held against it."""
    points, sites, pairs = near(spark, reach=min(9.0, lo.felt(4.0, kind)))
    got = {(r.p, r.s): r.coeff for r in lo.local_observations(pairs, 4.0, kind, reach=min(9.0, lo.felt(4.0, kind))).collect()}
    p, s = (np.array([r.pos[0] for r in d.orderBy("id").collect()]) for d in (points, sites))
    d = np.abs(p[:, None] - s[None])
    d = np.minimum(d, 360 - d)
    r = d / (4.0 * lo.FACTORS[kind])
    with np.errstate(divide="ignore"):
        far = np.where(r <= 2, 4 - 5 * r + 5 / 3 * r**2 + 5 / 8 * r**3 - r**4 / 2 + r**5 / 12 - 2 / (3 * r), 0)
    w = {
        "Gauss": np.exp(-0.5 * r**2), "Exp": np.exp(-0.5 * r**3), "Step": (r <= 1) * 1.0, "Cubic": np.where(r <= 1, (1 - r**3) ** 3, 0), "Quadro": np.where(r <= 1, (1 - r**4) ** 4, 0),
        "GC": np.where(r <= 1, 1 - 5 / 3 * r**2 + 5 / 8 * r**3 + r**4 / 2 - r**5 / 4, far),
    }[kind]
    want = {(int(i), int(j)): w[i, j] for i, j in np.argwhere((d <= 9) & (w > 1e-3))}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_points_of_a_grid_are_not_repeated(spark):
    points = spark.range(400).select(F.col("id").alias("i"))
    got = lo.direct_localization(points, [10, 40], F.col("i") % 4 == 0, 2.0, "Quadro")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    by_side = plan.split("RepartitionByExpression")
    assert len(by_side) == 3 and "Generate" not in by_side[1] and by_side[2].count("Generate explode") == 2
    want = set()
    for p in range(400):
        for s in range(0, 400, 4):
            y, x = abs(p // 40 - s // 40), abs(p % 40 - s % 40)
            r = math.hypot(min(y, 10 - y), min(x, 40 - x)) / 3.28
            if r <= 1 and (1 - r**4) ** 4 > 1e-3:
                want.add((p, s))
    assert {(r.p, r.s) for r in got.collect()} == want

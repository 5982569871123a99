"""The algebra of experiments: places, costs, roles, nests, and runs that survive a broken overwrite."""

import math

import pytest
from pyspark.sql import functions as F

from twinlake.operators import experiments as xp
from twinlake.sources import runs
from twinlake.sources.tables import grids


def table(spark):
    rows = [(k, "ab"[k % 2], k % 3 or None, float("nan") if k == 5 else float((k * 7) % 11)) for k in range(12)]
    return rows, spark.createDataFrame(rows, "seq long, method string, infl long, val double")


@pytest.mark.parametrize("place", [0, 11, -1, -12, slice(2, 5), slice(-3, None), slice(None, -9), slice(-5, -2), slice(None, None, 4), slice(None, None, -5), slice(10, 2, -3), slice(3, 3), slice(-2, 4), [2, 7], [-1, 0, 3], []])
def test_places_as_in_a_list(spark, place):
    rows, x = table(spark)
    seq = [r[0] for r in rows]
    want = [seq[place]] if isinstance(place, int) else seq[place] if isinstance(place, slice) else [seq[p] for p in place]
    assert sorted(r.seq for r in xp.at(x, place).collect()) == sorted(want)


def test_tune_by_cost(spark):
    rows, x = table(spark)
    got = {r.method: (r.infl, r.val) for r in xp.tune(x, ["method"], ["infl"], cost=lambda v: F.abs(v - 4)).collect()}
    for m in "ab":
        best = min((abs(v - 4), -k) for k, n, _, v in rows if n == m and not math.isnan(v))
        assert got[m] == next((i, v) for k, n, i, v in rows if k == -best[1])
    none = xp.tune(x.where("seq = 5"), ["method"], ["infl"]).collect()
    assert len(none) == 1 and none[0].infl is None


def test_roles(spark):
    rows, x = table(spark)
    t = xp.table_tree(x.where("seq <> 5"), {"outer": ["method"], "mean": ["seq"], "optim": ["infl"]})
    got = {r.method: (r.infl, r.val) for r in t.collect()}
    for m in "ab":
        by = {}
        for k, n, i, v in rows:
            if n == m and k != 5:
                by.setdefault(i, []).append(v)
        assert got[m][1] == pytest.approx(min(sum(v) / len(v) for v in by.values())) and got[m][1] == pytest.approx(sum(by[got[m][0]]) / len(by[got[m][0]]))
    with pytest.raises(ValueError, match="one of the roles"):
        xp.table_tree(x, {"outer": ["method"], "optim": ["method"]})
    with pytest.raises(ValueError, match="no dimensions"):
        xp.table_tree(x, {"outer": ["other"]})


def test_nest_is_rows(spark):
    _, x = table(spark)
    n = xp.nest(x, ["method"], ["infl"])
    assert sorted((r.method, r.infl or 0, r.size, r.cells) for r in n.collect()) == [(m, i, 2, 3) for m in "ab" for i in range(3)]
    assert xp.unnested(n, ["method"], ["infl"], method="a").count() == 3


def test_overwrite_survives_a_break(spark, tmp_path):
    root, old, new = f"file://{tmp_path}", spark.range(3).withColumnRenamed("id", "xp_id"), spark.range(5).withColumnRenamed("id", "xp_id")
    runs.save_run(old, root, "sweep", 1)
    (tmp_path / "sweep/run_ts=1").rename(tmp_path / "sweep/_old_1")  # broken off after the old run was put aside
    assert runs.restored(spark, root, "sweep", 1) and runs.load_run(spark, root, "sweep", 1).count() == 3
    runs.overwritten(spark, new.unionByName(runs.load_run(spark, root, "sweep", 1)), root, "sweep", 1)
    assert runs.load_run(spark, root, "sweep", 1).count() == 8 and sorted(p.name for p in (tmp_path / "sweep").iterdir()) == ["run_ts=1"]


def test_grids(spark):
    g = grids(spark.createDataFrame([("a", 7), ("b", 0)], "sys string, last long"), 0.5, 3, size=4).collect()
    assert sorted((r.sys, r.k, r.ko, r.t) for r in g if r.sys == "a") == [("a", k, k // 3 - 1 if k and k % 3 == 0 else None, k * 0.5) for k in range(10)]
    assert [(r.k, r.dt) for r in g if r.sys == "b"] == [(0, None)]

"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from helpers import DATA, folder

from twinlake.llm import ann

KIND = "vec_id long, embedding array<float>, label int, ids string, vec string, grp string"


def brute(ids, x, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
        out[q] = sorted((v, i) for v, i in zip(d.tolist(), ids, strict=True) if i != q)[:k]
    return out


def recall(got, want):
    hit = sum(len({i for _, i in want[q]} & {r.vec_id for r in got if r.query_id == q}) for q in want)
    return hit / sum(map(len, want.values()))


def test_whole_table(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], "f8")
    want = brute(ids, x, [i for i in ids if i % 100 == 0])
    got = ann.op10(spark, DATA).collect()
    assert recall(got, want) >= 0.9
    at = {i: x[k] for k, i in enumerate(ids)}
    for r in got:
        assert r.score == pytest.approx(np.sqrt(((at[r.query_id] - at[r.vec_id]) ** 2).sum()), abs=0) or abs(r.score - np.sqrt(((at[r.query_id] - at[r.vec_id]) ** 2).sum())) < 1e-12
    for q in want:
        own = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q)
        assert [o[0] for o in own] == list(range(1, len(own) + 1)) and [o[1:] for o in own] == sorted(o[1:] for o in own) and len(own) == len(want[q])


def test_ties_bad_vectors_and_few_rows(spark, tmp_path):
    one = [float(i == 3) for i in range(8)]
    rows = [(i, one) for i in range(0, 30)] + [(100, [0.5] * 8), (200, None), (300, [0.0] * 8), (400, [1.0, None] + [0.0] * 6), (500, [float("nan")] * 8), (600, [float("inf")] + [0.0] * 7), (None, one), (700, [1.0, 2.0]), (5, one)]
    d = spark.createDataFrame([(i, v, 0, "a", "b", "c") for i, v in rows], KIND)
    got = ann.op10(spark, folder(spark, tmp_path, embeddings=d)).collect()
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in {r.query_id for r in got}}
    assert by == {0: list(range(1, 11)), 100: list(range(0, 10))}
    few = spark.createDataFrame([(0, one, 0, "a", "b", "c"), (1, [2.0] * 8, 0, "a", "b", "c"), (2, [-1.0] * 8, 0, "a", "b", "c")], KIND)
    got = ann.op10(spark, folder(spark, tmp_path, embeddings=few)).collect()
    assert [(r.query_id, r.rank) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1), (0, 2)]
    assert ann.op10(spark, folder(spark, tmp_path, embeddings=d.limit(0))).collect() == []


def test_close_rows_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16)) * 0.05 + np.eye(16)[0]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(d, d.where("vec_id % 100 = 0")).collect()
    assert recall(got, brute(list(range(600)), x, range(0, 600, 100))) >= 0.9


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1"])
def test_recall_and_candidates(spark, name):
    """A recall of 0.9 on random directions; of two thousand rows under a tenth are candidates."""
    e = spark.read.parquet(f"{DATA.replace('sf0.001', name)}/embeddings.parquet")
    rows = e.collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], "f8")
    want = brute(ids, x, [i for i in ids if i % 20 == 0])
    got = ann.nearest(e, e.where("vec_id % 20 = 0")).collect()
    assert recall(got, want) >= 0.9
    if name == "sf0.1":
        v, dim = ann.usable(e, "vec_id", "embedding")
        held = v.select(v.id.alias("node"), "vec")
        met = ann.candidates(held, v.where("id % 20 = 0"), ann.Tables(dim, ann.TABLES, ann.SEED), ann.PROBES, ann.HITS, ann.ENOUGH, 3)
        n = sum(len(r.nodes) for r in met.collect())
        assert n <= 0.1 * len(ids) * len(want)


def test_nearest_axis():
    for size in (6, 300):
        t = ann.Tables(size, 2, 0)
        unit = t.unit(np.random.default_rng(0).normal(size=(50, size)))
        assert np.allclose(np.linalg.norm(t.rotated(unit, 0, 0), axis=1), 1, atol=1e-5)
        a, p = t.cells(unit, 0), t.probes(unit, 0, 5)
        assert p.shape == (50, 5) and all(a[i] in p[i] for i in range(50))

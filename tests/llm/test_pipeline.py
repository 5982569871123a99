"""The corpus pipeline, stage by stage and whole."""

from collections import Counter

import corpus_pipeline as cp
from helpers import DATA, documents

from twinlake.llm import components


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {"start": docs.count()}
    for name, stage in cp.STAGES[:-1]:
        out = cp.materialise(stage(spark, docs, DATA), "test")
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        assert out.count() <= docs.count()
        seen[name] = out.count()
        docs = out
    assert seen["near copies"] < seen["line dedup"] <= seen["start"]
    assert docs.where("text like '%<EMAIL>%'").count() > 0
    last = cp.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_run(spark):
    rows = cp.run(spark, DATA).collect()
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert rows and max(used.values()) <= 1024
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)


def test_clean_documents_stay(spark):
    clean = [(i, f"the {i} and of a thing with number {i * 31} in it and {' '.join(f'word{i}x{k}' for k in range(30))}") for i in range(40)]
    d = documents(spark, clean)
    for _, stage in cp.STAGES[:-1]:
        d = cp.materialise(stage(spark, d, DATA), "test")
    assert {r.doc_id: r.text for r in d.collect()} == dict(clean)


def test_hard_rows(spark):
    rows = [(1, None), (2, ""), (None, "the and of a thing"), (3, "the and of a thing"), (3, "the and of a thing"), (4, "the and of a thing " * 20000)]
    d = documents(spark, rows)
    for _, stage in cp.STAGES:
        d = cp.materialise(stage(spark, d, DATA), "test")
    assert d.columns[:2] == ["doc_id", "piece"]
    d = documents(spark, [])
    for _, stage in cp.STAGES:
        d = cp.materialise(stage(spark, d, DATA), "test")
    assert d.count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_clashing_columns_go_through(spark):
    rows = [(i, f"the {i} and of a thing with number {i * 31} in it and {' '.join(f'word{i}x{k}' for k in range(30))}") for i in range(20)]
    d = documents(spark, rows, more=True)
    for _, stage in cp.STAGES[:-1]:
        out = cp.materialise(stage(spark, d, DATA), "test")
        assert out.columns == d.columns
        d = out
    assert d.count() == 20 and all(d.where(f"`{c}` <> '{c}'").count() == 0 for c in ("node", "row", "_spans"))

"""Runs whose intermediate tables go with them."""

from pathlib import Path

from helpers import documents

from twinlake.llm import common, linededup


def test_scratch_is_dropped(spark, tmp_path):
    docs = documents(spark, [(1, "a line of more than eight words that stands here"), (2, "a line of more than eight words that stands here")])
    before = common.materialise(docs, "kept")
    with common.scratch(spark) as run:
        where = Path(run.removeprefix("file://"))
        linededup.line_dedup(docs).write.parquet(f"{tmp_path}/out")
        assert {p.name.split("-")[0] for p in where.iterdir()} == {"line"}
        with common.scratch(spark) as inner:
            common.materialise(docs, "inner")
            assert inner.startswith(run)
        assert not Path(inner.removeprefix("file://")).exists() and where.exists()
    assert not where.exists() and before.count() == 2
    assert {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()}[2] == ""
    assert not common.fresh_path(spark, "x").startswith(run)

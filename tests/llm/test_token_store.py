"""Token files against the tokenizers library, by round trip."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import DATA, documents, texts
from tokenizers import Tokenizer

from twinlake.llm import token_store as ts


def want(rows):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_whole_table(spark):
    got = ts.op2(spark, DATA).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want(texts())


@pytest.mark.parametrize("mode", ["bit", "byte"])
def test_edges(spark, tmp_path, mode):
    rows = [(3, None), (1, ""), (2, "Hello  WORLD\n\tthis is it"), (None, "no id"), (5, "<|endoftext|> x"), (9, "x <|endoftext|>\ny a<|startoftext|>b  <|endoftext|>"), (5, "b"), (5, "b"), (6, "word and more " * 30000), (7, "é 😀  x " * 20), (8, "a" * 3000)]
    path = f"{tmp_path}/store"
    ts.write_store(documents(spark, rows, more=True), path, public_tokenizers.path("word_bpe_49k.json"), 1, mode=mode, block=1000)
    got = ts.read_store(spark, path).collect()
    key = lambda r: (r[1],)
    assert sorted([(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got], key=key) == want(rows)
    index = spark.read.parquet(f"{path}/index").collect()
    assert sum(r.n_ids for r in index) == sum(r.n_tokens for r in got) and all(r.plane_bytes for r in index)
    some = ts.read_store(spark, path, first=2, last=5).collect()
    assert sorted(map(str, some)) == sorted(str(r) for r in got if r.doc_id is not None and 2 <= r.doc_id <= 5)


def test_planes_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 7, 8, 1000):
        for top in (1, 2, 255, 49407, 2**32 - 1):
            ids = rng.integers(0, top, n, endpoint=True).astype("<u4")
            for mode in ("bit", "byte"):
                planes = ts.to_planes(ids, max(1, int(ids.max()).bit_length()), mode, bytes)
                assert (ts.from_planes(planes, n, mode, bytes) == ids).all()


def test_empty_table(spark, tmp_path):
    path = f"{tmp_path}/none"
    ts.write_store(documents(spark, []), path, public_tokenizers.path("word_bpe_49k.json"), 1)
    assert ts.read_store(spark, path).collect() == []


def test_reading_whole_stores_shuffles_no_planes(spark, tmp_path):
    """Also where the index is too large to be sent about, the planes of a store are not."""
    path = f"{tmp_path}/store"
    ts.write_store(documents(spark, [(k, f"text {k}") for k in range(40)]), path, public_tokenizers.path("word_bpe_49k.json"), 1)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        d = ts.read_store(spark, path)
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert d.count() == 40
    finally:
        spark.conf.set(key, before)

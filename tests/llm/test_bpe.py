"""Byte-level BPE against the tiktoken library."""

import hashlib

import public_tokenizers
import tiktoken
from helpers import DATA, documents, folder, texts

from twinlake.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def want(rows):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    out = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, *r))


def got(spark, sf_dir):
    rows = bpe.op5(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, *r))


def test_whole_table(spark):
    assert got(spark, DATA) == want(texts())


def test_edges(spark, tmp_path):
    odd = ["a  b", " a", "a ", "\n a", "a\n\nb", "a \n b", "a\tb\r\nc", "x y   z", "it's we'LL 123456 ..!?", "a\n b\nc", "😀 é <|endoftext|>", " x  ", "a\n", "\n", " ", "a  b", "\x0bq \x0c\x85w"]
    rows = [(1, None), (2, ""), (None, "no id"), (3, "twice"), (3, "twice"), (4, "word and more " * 40000), (5, "z" * 4000), *[(100 + i, t) for i, t in enumerate(odd)]]
    d = folder(spark, tmp_path, documents=documents(spark, rows, more=True))
    assert got(spark, d) == want(rows)


def test_many_batches(spark, tmp_path, monkeypatch):
    rows = [(i, f"some words {i % 50} and  more {i}") for i in range(500)]
    d = folder(spark, tmp_path, documents=documents(spark, rows).repartition(3))
    monkeypatch.setattr(bpe, "BATCH_CHARS", 500)
    assert got(spark, d) == want(rows)


def test_decode_keeps_columns(spark):
    d = spark.createDataFrame([(1, bytearray(b""), "a")], "doc_id long, ids binary, decoded string")
    r = bpe.decode(d, RANKS).collect()[0]
    assert bytes(r.decoded) == b""


def test_empty_table(spark, tmp_path):
    assert got(spark, folder(spark, tmp_path, documents=documents(spark, []))) == []

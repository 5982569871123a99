"""Packing: validity, tokens, counts against bounds and exact search."""

import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from helpers import CLASH, DATA, documents, folder, texts
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from twinlake.llm import packing as p


def want_pieces(rows):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        n, at, k = len(ids), 0, 0
        while at < n:
            step = n if n <= 1024 else (n % 1024 or 1024) if at == 0 else 1024
            out.append((i, k, at, step, zlib.crc32(ids[at : at + step].tobytes())))
            at, k = at + step, k + 1
    return sorted(out, key=str)


def check(spark, sf_dir, rows):
    got = p.op4(spark, sf_dir).collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=str) == want_pieces(rows)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    return bins, sum(r.length for r in got)


def test_whole_table(spark):
    bins, total = check(spark, DATA, texts())
    assert len(bins) <= 1.02 * -(-total // 1024) + 1


def test_edges(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "twice"), (3, "twice"), (4, "word and more " * 20000), (5, "a" * 5000), (6, "  x \n\n y "), (7, "x <|endoftext|> y\nz<|endoftext|>")]
    check(spark, folder(spark, tmp_path, documents=documents(spark, rows, more=True)), rows)


def test_empty_table(spark, tmp_path):
    assert p.op4(spark, folder(spark, tmp_path, documents=documents(spark, []))).collect() == []


def test_pack_keeps_other_columns(spark):
    d = spark.createDataFrame([(1, 5, "a", "b", "c"), (2, None, "a", "b", "c"), (3, 0, "a", "b", "c"), (4, 5, "a", "b", "c")], "id long, length int, _size string, _rank string, sequence_id string")
    got = {r.id: r for r in p.pack(d, capacity=10).collect()}
    assert got[2].sequence_id is None and got[3].offset is None and got[1].sequence_id == got[4].sequence_id and {got[1].offset, got[4].offset} == {0, 5}
    assert got[1]._size == "a" and got[1]._rank == "b"
    with pytest.raises(ValueError):
        p.pack(d, capacity=4)


def fewest(sizes, capacity):
    """Exact number of bins of a small instance, by search over sets."""

    @cache
    def left(mask):
        if not mask:
            return 0
        first = mask & -mask
        best, sub = 99, mask
        while sub:
            if sub & first and sum(s for i, s in enumerate(sizes) if sub >> i & 1) <= capacity:
                best = min(best, 1 + left(mask & ~sub))
            sub = (sub - 1) & mask
        return best

    return left((1 << len(sizes)) - 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_keeps_the_optimum(sizes):
    count = {s: sizes.count(s) for s in set(sizes)}
    fixed, rest = p.dominance(count, 20)
    assert all(sum(s * n for s, n in pattern.items()) <= 20 for _, pattern in fixed)
    remain = [s for s, n in rest.items() for _ in range(n)]
    assert sum(t for t, _ in fixed) + (fewest(tuple(remain), 20) if remain else 0) == fewest(tuple(sizes), 20)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=12))
def test_plan_places_every_rank_once(count):
    plan = p.plan(count, 50)
    seen = defaultdict(list)
    for s, n in count.items():
        for r in range(n):
            at = np.searchsorted(plan["key"], s << 40 | r, "right") - 1
            local = r - plan["rank"][at]
            assert plan["key"][at] >> 40 == s
            seen[plan["first"][at] + local // plan["per"][at]].append((plan["offset"][at] + local % plan["per"][at] * s, s))
    for b in seen.values():
        at = 0
        for offset, s in sorted(b):
            assert offset == at
            at += s
        assert at <= 50

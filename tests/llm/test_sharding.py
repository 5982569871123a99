"""Sharding: one shard a text, sizes near equal, capacities as small as can be."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import CLASH, documents, folder, texts
from hypothesis import given, settings
from hypothesis import strategies as st

from twinlake.llm import sharding as sh


def check(spark, sf_dir, rows, count=8):
    got = sh.op12(spark, sf_dir).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < count for r in got)
    slots, by_text, sums = defaultdict(list), defaultdict(set), np.zeros(count, "i8")
    for r in got:
        slots[r.shard].append(r.slot)
        by_text[r.size, r.text_crc32].add(r.shard)
        sums[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in by_text.values())
    return sums


def test_whole_table_is_near_equal(spark, tmp_path):
    rows = texts()
    sums = check(spark, folder(spark, tmp_path, documents=documents(spark, rows)), rows)
    assert sums.max() <= 1.02 * sums.mean() and sums.min() >= 0.9 * sums.mean()


def test_a_text_of_which_there_are_very_many(spark, tmp_path):
    rows = [(k, "the same text again and again") for k in range(900)] + [(k, f"text number {k} " * (k % 7 + 1)) for k in range(900, 2700)]
    sums = check(spark, folder(spark, tmp_path, documents=documents(spark, rows)), rows)
    own, rest = sums.max(), np.sort(sums)[:-1]  # the text has more than an even share, and so a shard for itself
    assert own == 900 * 30 and rest.max() <= 1.01 * rest.min()


def test_edges(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, "no id"), (None, "no id"), (3, "twice"), (3, "twice"), (4, "long " * 100_000), (5, "é" * 5000), (6, "x\x00")]
    check(spark, folder(spark, tmp_path, documents=documents(spark, rows, more=True)), rows)


def test_few_groups_each_have_a_shard(spark, tmp_path):
    rows = [(k, f"{k:08d}") for k in range(10)]
    assert sorted(check(spark, folder(spark, tmp_path, documents=documents(spark, rows)), rows).tolist()) == [9] * 6 + [18] * 2


def test_empty_table(spark, tmp_path):
    assert sh.op12(spark, folder(spark, tmp_path, documents=documents(spark, []))).collect() == []


def test_other_columns_stay(spark):
    r = sh.shards(documents(spark, [(1, "a"), (2, "b")], more=True), 3).collect()
    assert len(r) == 2 and all(x[c] == c for x in r for c in CLASH) and {x.slot for x in r} == {0}


class Sums:
    """A written table's stand-in: sums of small groups by bucket, looked up in memory."""

    def __init__(self, buckets):
        self.ends = np.cumsum([sum(b) for b in buckets])
        self.bucket, self.count = np.arange(len(buckets)), np.array([len(b) for b in buckets])
        self.every = np.concatenate([[0], np.cumsum([x for b in buckets for x in b])])

    roughly = sh.Order.roughly

    def reach(self, bounds):
        return self.every[np.searchsorted(self.every, bounds, "right") - 1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 50), min_size=1, max_size=5), min_size=1, max_size=20), st.integers(1, 8))
def test_smallest_capacity(buckets, shards):
    order = Sums(buckets)
    sizes = [x for b in buckets for x in b]

    def holds(c):
        used, room = 0, 0
        for x in sizes:
            if x > c:
                return False
            if x > room:
                used, room = used + 1, c
            room -= x
        return used <= shards

    got = sh.smallest(order, 0, shards, -(-sum(sizes) // shards) + max(sizes))
    assert holds(got) and not holds(got - 1)


@pytest.mark.parametrize("tried", [2, 4096])
def test_search_in_several_rounds(monkeypatch, tried):
    monkeypatch.setattr(sh, "TRIED", tried)
    order = Sums([list(range(1, 40))])
    assert sh.smallest(order, 0, 4, 400) == min(c for c in range(1, 400) if _steps(order, c, 4))


def _steps(order, c, shards):
    at = np.array([0])
    for _ in range(shards):
        at = order.reach(at + c)
    return at[0] >= order.ends[-1]

"""Near-duplicates against all pairs by weighted Jaccard."""

from collections import Counter

import numpy as np
from helpers import DATA, documents, folder, texts

from twinlake.llm import bagminhash as b


def bag(text):
    w = (text or "").lower().split()
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def classes(rows, threshold=0.8):
    """Smallest id of each document's class, by union of all pairs at the threshold and equal texts."""
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    bags = {i: bag(t) for i, t in rows if t is not None}
    text = dict(rows)
    size = {i: sum(x.values()) for i, x in bags.items()}
    holders = {}
    for i, x in bags.items():
        for s in x:
            holders.setdefault(s, []).append(i)
    near = {(i, j) for h in holders.values() for i in h for j in h if i < j} | {(i, j) for i in bags for j in bags if i < j and text[i] == text[j]}
    for i, j in near:
        same = sum((bags[i] & bags[j]).values())
        if text[i] == text[j] or same >= threshold * (size[i] + size[j] - same) > 0:
            p, q = sorted((root(i), root(j)))
            up[q] = p
    return {i: root(i) for i, _ in rows}


def test_whole_table(spark):
    rows = texts()
    got = {r.doc_id: r for r in b.op9(spark, DATA).collect()}
    want = classes(rows)
    assert {i: r.class_id for i, r in got.items()} == want
    n = Counter(want.values())
    assert all(r.class_size == n[r.class_id] and r.is_first == (i == r.class_id) for i, r in got.items())


def test_signature_is_unbiased():
    rng = np.random.default_rng(1)
    elem = rng.integers(1, 2**62, 60).astype("u8")
    x, y = rng.integers(0, 6, 60), rng.integers(0, 6, 60)
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    got = []
    for k in range(40):
        e = elem + np.uint64(k * 1000003)
        s = b.signatures([(e[x > 0], x[x > 0]), (e[y > 0], y[y > 0])], 128)
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - want) < 4 * np.sqrt(want * (1 - want) / (128 * 40))


def test_repeats_count(spark):
    once = " ".join(f"w{i}" for i in range(60))
    twice = f"{once} {once}"
    got = {r.doc_id: r.class_id for r in b.near_duplicates(documents(spark, [(1, once), (2, twice), (3, twice + " end")])).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_edges(spark):
    long = " ".join(f"w{i % 997}" for i in range(60000))
    rows = [(1, None), (2, None), (3, ""), (4, ""), (5, "  \n"), (None, "same text here"), (6, "same text here"), (7, "same text here"), (7, "same text here"), (8, long), (9, long + " end"), (10, "Same TEXT here")]
    got = b.near_duplicates(documents(spark, rows, more=True)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].class_id == 1 and by[2].class_id == 2 and by[3].class_id == by[4].class_id == 3 and by[5].class_id == 5
    assert by[6].class_id == by[7].class_id == by[None].class_id == by[10].class_id == 6 and by[6].class_size == 5
    assert by[9].class_id == 8 and sum(r.is_first for r in got) == 6
    assert b.near_duplicates(documents(spark, [])).collect() == []


def test_chain_is_one_class_and_mixed_buckets_are_checked(spark):
    """Each text shares most with the next, little with the last."""
    rows = [(i, " ".join(f"w{k}" for k in range(i * 4, i * 4 + 120))) for i in range(12)]
    got = {r.doc_id: r.class_id for r in b.near_duplicates(documents(spark, rows)).collect()}
    assert got == classes(rows) and set(got.values()) == {0}


def test_many_copies(spark, tmp_path):
    base = [" ".join(f"{c}{k}" for k in range(80)) for c in "abc"]
    rows = [(i, base[i % 3] + (f" x{i}" if i % 2 else "")) for i in range(900)]
    d = folder(spark, tmp_path, documents=documents(spark, rows))
    got = b.op9(spark, d).groupBy("class_id").count().collect()
    assert sorted((r.class_id, r["count"]) for r in got) == [(0, 300), (1, 300), (2, 300)]

"""The filter audit against plain Python, order by order."""

import re
from itertools import permutations

import pytest
from helpers import CLASH, DATA, documents, folder, texts

from twinlake.llm import bytescan
from twinlake.llm import filter_audit as fa

FLAGS = "doc_id long, quality int, toxic int"


def fails(text):
    words = [w for w in re.split("[ \t-\r]+", text) if w]
    return [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text))]


def want(rows, labels):
    rows = [(i, t or "", (lang or "")) for i, t, lang in rows]
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    masks = [(lang, i, dict(zip("ABCDE", [*fails(t), i is not None and i > first[t]], strict=True))) for i, t, lang in rows]
    out, removed = {}, {}
    for part in {lang for lang, _, _ in masks}:
        own = [(i, m) for lang, i, m in masks if lang == part]
        for o in map("".join, permutations("ABCDE")):
            left = own
            for k, c in enumerate(o):
                here = [(i, m) for i, m in left if m[c]]
                left = [(i, m) for i, m in left if not m[c]]
                out[part, o, k + 1] = (len(left), len(here), sum(m[c] for _, m in own) - len(here), sum(m[c] and sum(m.values()) == 1 for _, m in own), sum(i in good for i, _ in here), sum(i in toxic for i, _ in here))
                removed[part, c] = removed.get((part, c), 0) + len(here)
    return {key: (*v, removed[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def audited(spark, rows, labels, tmp_path, more=False):
    d = folder(spark, tmp_path, documents=documents(spark, rows, more), labels=spark.createDataFrame(labels, FLAGS))
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in fa.op13(spark, d).collect()}


LONG = " ".join(f"word{k}" for k in range(150))


def test_edges(spark, tmp_path):
    rows = [
        (1, None, "en"), (2, "", "en"), (None, "no id", "en"), (None, "no id", "en"), (3, "twice", "de"), (3, "twice", "de"), (9, "twice", "en"), (4, LONG, None), (5, LONG, ""), (6, LONG + " A$", "fr"),
        (7, "A" * 3000, "en"), (8, "ab " * 500_000, "en"), (10, "é ü " * 400, "xx"), (11, LONG.replace(" ", "\x0b\r\n\t "), "xx"), (12, "x\x00y #", "xx"),
    ]
    labels = [(4, 1, 0), (4, 0, 1), (5, 0, 1), (None, 1, 1), (2, 1, None), (77, 1, 1)]
    got = audited(spark, rows, labels, tmp_path, more=True)
    assert got == want(rows, labels)
    assert {p for p, _, _ in got} == {"en", "de", "", "fr", "xx"} and len(got) == 5 * 600


def test_whole_table(spark):
    import pyarrow.parquet as pq

    rows = [(r["doc_id"], r["text"], r["lang"]) for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist()]
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in fa.op13(spark, DATA).collect()}
    assert got == want(rows, labels)


def test_empty_table(spark, tmp_path):
    assert audited(spark, [], [], tmp_path) == {}


def test_measures_of_long_texts_and_shared_hashes(spark, monkeypatch):
    """Strips of a few bytes, words over several strips, and a hash that all words share: counts stay exact."""
    monkeypatch.setattr(fa, "STRIP", 16)
    for t in ("one two  one\tthree " * 9, "x" * 300, "ab " + "y" * 200 + " ab", " \n ", "ÄÖ ü" * 40):
        raw = bytescan.np.frombuffer(t.encode(), bytescan.np.uint8)
        words = [w for w in re.split("[ \t-\r]+", t) if w]
        assert fa.counted_long(raw).tolist() == [len(words), len(set(words)), len(re.findall("[A-Z]", t)), 0, len(t)]
    monkeypatch.setattr(fa, "hashes", lambda data, first, end, base: bytescan.np.zeros(len(first), bytescan.np.uint64))
    data = bytescan.np.frombuffer(b"a b a b c" + b"c c", bytescan.np.uint8)
    assert fa.counted(data, bytescan.np.array([0, 9, 12]))[:2].tolist() == [[5, 2], [3, 1]]


def test_extra_columns_pass_through(spark):
    m = fa.measured(documents(spark, [(1, "a b a")], more=True)).first()
    assert (m.n_words, m.n_distinct, m.n_points) == (3, 2, 5) and all(m[c] == c for c in CLASH)


@pytest.mark.parametrize("kind", ["string", "large"])
def test_words_agree_with_a_pattern(kind):
    import pyarrow as pa

    rows = [t or "" for _, t in texts()][:40] + ["", " ", "a"]
    data, off = bytescan.buffers(pa.array(rows, pa.large_string() if kind == "large" else pa.string())[1:])
    for k, t in enumerate(rows[1:]):
        first, end = bytescan.words(fa.GAP[data[off[k] : off[k + 1]]], bytescan.np.zeros(1, "i8"))
        assert [data[off[k] + a : off[k] + z].tobytes().decode() for a, z in zip(first, end, strict=True)] == [w for w in re.split("[ \t-\r]+", t) if w]

"""Language: accuracy on held-out documents, rejection, edges."""

import zlib

import pyarrow.parquet as pq
from helpers import documents, folder

from twinlake.llm import langid

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}
    got = langid.op3(spark, SMALL).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    told = [r for r in got if r.held_out and r.lang_pred != "und" and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in told) >= 0.95 * len(told)


def rows():
    words = {"en": "the and of thing with", "de": "der und das mit sich", "fr": "le et de la avec"}
    out, k = [], 0
    for lang, w in words.items():
        for i in range(40):
            w_ = w.split()
            out.append((k, " ".join(w_[(i + j * j) % 5] for j in range(60)), lang))
            k += 1
    return out


def test_edges_and_columns(spark, tmp_path):
    more = [(500, None, "en"), (501, "", "en"), (502, "1234 -- 99", "de"), (503, "the and of", None), (None, "le et de la avec", "fr"), (504, "der und das " * 50000, "de"), (504, "der und das " * 50000, "de")]
    d = documents(spark, rows() + more, more=True)
    got = langid.op3(spark, folder(spark, tmp_path, documents=d)).collect()
    assert len(got) == len(rows()) + len(more)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (500, 501, 502))
    assert by[503].lang_pred == "en" and by[None].lang_pred == "fr" and not by[None].held_out and by[504].lang_pred == "de"
    kept = langid.accepted(d)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()}.isdisjoint({500, 501, 502})


def test_far_text_is_rejected(spark):
    noise = " ".join(f"qzx{chr(97 + i % 26)}vkj{chr(98 + i % 24)}w" for i in range(300))
    got = {r.doc_id for r in langid.accepted(documents(spark, [*rows(), (900, noise, "en")][:-1])).collect()}
    assert len(got) == len(rows())
    model = langid.fit(documents(spark, rows()).selectExpr("doc_id id", "text", "lang"))
    p = {r.id: r for r in langid.predict(documents(spark, [*rows(), (900, noise)]).selectExpr("doc_id id", "text"), model).collect()}
    assert not p[900].accepted and p[900].score < min(p[i].score for i, *_ in rows())


def test_empty_and_unlabelled(spark, tmp_path):
    assert langid.op3(spark, folder(spark, tmp_path, documents=documents(spark, []))).collect() == []
    d = documents(spark, [(1, "some text", None)])
    assert [r.lang_pred for r in langid.op3(spark, folder(spark, tmp_path, documents=d)).collect()] == ["und"]


def brute_counts(text):
    raw = [b if chr(b).isalpha() or b >= 128 else 32 for b in text.lower().encode()] + [32, 32, 32]
    b = [x for i, x in enumerate(raw) if x != 32 or i == 0 or raw[i - 1] != 32]
    out = {}
    for k in (1, 2, 3):
        for i in range(len(b) - k + 1):
            code = k
            for x in b[i : i + k]:
                code = ((code << 8) % 2**32) ^ x ^ (code >> 24)
            code = code * 2654435769 % 2**32 >> 19
            out[code] = out.get(code, 0) + 1
    return out


def test_counts_against_brute_force(monkeypatch):
    texts = ["The and of", "", "éa -- B  b", "der und das " * 40, "x"]
    for slab in (1 << 19, 7):
        monkeypatch.setattr(langid, "SLAB", slab)
        counts, _ = langid.grams(texts)
        for row, t in zip(counts, texts, strict=True):
            assert {int(i): int(row[i]) for i in row.nonzero()[0]} == brute_counts(t)


def test_predictions_against_brute_force(spark):
    import math

    d = documents(spark, rows()).selectExpr("doc_id id", "text", "lang")
    model = langid.fit(d)
    got = {r.id: r for r in langid.predict(d, model).collect()}
    for i, t, _ in rows()[::9]:
        v = {g: math.sqrt(n) * model["idf"][g] for g, n in brute_counts(t).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        cos = [(sum(x * c[g] for g, x in v.items()) / size, lang) for c, lang in zip(model["centroids"], model["langs"], strict=True)]
        best = max(cos)
        assert got[i].lang_pred == best[1] and abs(got[i].score - min(1, best[0])) < 1e-4


def test_every_language_is_learnt(spark):
    many = [(k, f"{chr(97 + k % 26) * 3}{chr(97 + k // 26) * 2} " * 12, f"l{k}") for k in range(230)]
    assert len(set(langid.fit(documents(spark, many).selectExpr("doc_id id", "text", "lang"))["langs"])) == 230


def test_repeated_documents_tie(spark):
    d = documents(spark, [*rows(), *[(1000 + i, t, lang) for i, t, lang in rows()]])
    model = langid.fit(d.selectExpr("doc_id id", "text", "lang"))
    p = {r.id: (r.lang_pred, r.score) for r in langid.predict(d.selectExpr("doc_id id", "text"), model).collect()}
    assert all(p[i] == p[1000 + i] for i, *_ in rows())

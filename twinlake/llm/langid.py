"""Language by nearest centroid: hashed TF-IDF byte n-grams, several clustered centroids a language, cosine.

Inverse document frequencies come from all documents to learn from, and every language that they have is learnt.
Centroids are fitted on at most ``SAMPLE`` documents a language, taken by a hash of their text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.llm.common import small_batches, tidy
from twinlake.llm.tokens import binary

DIM, ORDERS = 8192, (1, 2, 3)
SAMPLE, CENTROIDS, STEPS = 1500, 4, 8
#: Rows and bytes of text of which vectors are made at once, and places of which n-grams are.
BATCH_ROWS, BATCH_BYTES, SLAB = 128, 1 << 19, 1 << 19
#: Lengths (bytes, powers of two) at which slices of the sample give the least usual cosine, and how far below it a text is rejected.
SLICES, QUANTILE, MARGIN = (32, 64, 128, 256, 512, 1024), 0.005, 0.15
UNKNOWN = "und"

_SPACE = np.array([b if chr(b).isalpha() or b >= 128 else 32 for b in range(256)], np.uint8)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams, a row a text, of lower-cased UTF-8 in which runs of other signs are one blank; and their lengths.

    N-grams are counted a slab of places at a time, so a very long text takes a few bytes a byte."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    b = _SPACE[np.frombuffer(b"".join(x + b"\n\n\n" for x in raw), np.uint8)]
    doc = np.repeat(np.arange(len(raw), dtype=np.int32), [len(x) + 3 for x in raw])
    keep = (b != 32) | np.concatenate([[True], (b[1:] != b[:-1]) | (doc[1:] != doc[:-1])])
    b, doc = b[keep], doc[keep]
    out = np.zeros(len(raw) * DIM, np.int32)
    for start in range(0, len(b), SLAB):
        for k in ORDERS:
            n = min(SLAB, len(b) - k + 1 - start)
            if n <= 0:
                continue
            code = np.full(n, k, np.uint32)
            for i in range(k):
                code = (code << np.uint32(8)) ^ b[start + i : start + i + n] ^ (code >> np.uint32(24))
            code = (code * np.uint32(2654435769)) >> np.uint32(32 - 13)
            at = doc[start + k - 1 : start + k - 1 + n]
            same = doc[start : start + n] == at
            out += np.bincount((at.astype(np.int64) * DIM + code)[same], minlength=len(out))
    return out.reshape(len(raw), DIM), np.bincount(doc, minlength=len(raw))


def slices(b: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of bounded rows and bytes; ``text`` is the place of the column that is measured."""
    size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
    at = total = 0
    for i, n in enumerate(size.tolist()):
        if i > at and (total + n > BATCH_BYTES or i - at >= BATCH_ROWS):
            yield b.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < b.num_rows:
        yield b.slice(at)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts, dtype="f4") * idf.astype("f4")
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def frequencies(d: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each hashed n-gram stands; the table is DIM rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM + 1, np.int64), 0
        for b in it:
            for part in slices(b, 0):
                c, _ = grams([t or "" for t in part.column("text").to_pylist()])
                df[:DIM] += (c > 0).sum(0)
                df[DIM] += len(c)
        yield pa.RecordBatch.from_arrays([pa.array(range(DIM + 1), pa.int32()), pa.array(df, pa.int64())], names=["gram", "df"])

    out = np.zeros(DIM + 1, np.int64)
    for r in d.select("text").mapInArrow(tidy(run), "gram int, df long").groupBy("gram").agg(F.sum("df").alias("df")).collect():
        out[r.gram] = r.df
    return out[:DIM], int(out[DIM])


def _clusters(x: np.ndarray, k: int, steps: int) -> np.ndarray:
    """Spherical k-means from far apart starts."""
    at = [0]
    best = x @ x[0]
    while len(at) < min(k, len(x)):
        at.append(int(best.argmin()))
        best = np.maximum(best, x @ x[at[-1]])
    c = x[at]
    for _ in range(steps):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(train: DataFrame, sample: int = SAMPLE) -> dict:
    """Centroids, their languages and their least usual cosines, from (text, lang) rows.

    What comes to the driver is a count, and at most ``CENTROIDS`` vectors, a language."""
    train = train.where("text is not null and lang is not null")
    langs = {r.lang: r["count"] for r in train.groupBy("lang").count().collect()}
    if not langs:
        return {"langs": [], "centroids": np.zeros((0, DIM), "f4"), "idf": np.ones(DIM), "least": np.zeros((0, len(SLICES)))}
    df, n = frequencies(train)
    idf = np.log((1 + n) / (1 + df)) + 1

    share = F.element_at(F.create_map(*[F.lit(x) for lang, k in langs.items() for x in (lang, min(1.0, 1.1 * sample / k))]), F.col("lang"))
    picked = train.withColumn("h", F.xxhash64("text")).where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))

    def sparse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The whole text's vector, and that of a slice of each length, as (places, values)."""
        for b in it:
            for part in slices(b, 0):
                rows = []
                texts, names, hs = (part.column(c).to_pylist() for c in ("text", "lang", "h"))
                kinds = [-1] * len(texts)
                for i in range(len(texts)):
                    t = texts[i]
                    for k, size in enumerate(SLICES):
                        if len(t) >= 2 * size and has_letter(s := t[(a := hs[i] % (len(t) - size)) : a + size]):
                            texts.append(s)
                            names.append(names[i])
                            hs.append(hs[i])
                            kinds.append(k)
                v = vectors(grams(texts)[0], idf)
                for row, lang, h, kind in zip(v, names, hs, kinds, strict=True):
                    nz = np.flatnonzero(row)
                    rows.append((lang, h, kind, nz.astype("<u2").tobytes(), row[nz].astype("<f2").tobytes()))
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), binary(list(c[3])), binary(list(c[4]))], names=["lang", "h", "kind", "at", "val"])

    def cluster(key, t):
        kinds, hs = t.column("kind").to_numpy(), t.column("h").to_numpy()

        def parts(kind: int) -> Iterator[np.ndarray]:
            """The vectors of one kind, by hash, some at a time."""
            own = np.flatnonzero(kinds == kind)
            own = own[np.argsort(hs[own], kind="stable")][:sample]
            for k in range(0, len(own), 256):
                x = np.zeros((len(own[k : k + 256]), DIM), "f4")
                for i, r in enumerate(own[k : k + 256].tolist()):
                    x[i, np.frombuffer(t.column("at")[r].as_py(), "<u2")] = np.frombuffer(t.column("val")[r].as_py(), "<f2")
                yield x

        whole = np.concatenate([np.zeros((0, DIM), "f4"), *parts(-1)])
        _, first = np.unique(np.round(whole @ np.random.default_rng(0).normal(size=DIM).astype("f4"), 4), return_index=True)  # copies count once
        c = _clusters(whole[np.sort(first)], CENTROIDS, STEPS)
        del whole
        least = []
        for k in range(len(SLICES)):
            near = np.concatenate([np.zeros(0, "f4"), *[(x @ c.T).max(1) for x in parts(k)]])
            least.append(float(np.quantile(near, QUANTILE)) - MARGIN if len(near) else least[-1] if least else 0.0)  # longer texts lie nearer
        return pa.table({"lang": pa.array([key[0].as_py()] * len(c), pa.string()), "centroid": binary([r.astype("f4").tobytes() for r in c]), "least": pa.array([least] * len(c), pa.list_(pa.float64()))})

    got = picked.select("text", "lang", "h").mapInArrow(tidy(sparse), "lang string, h long, kind int, at binary, val binary").groupBy("lang").applyInArrow(cluster, "lang string, centroid binary, least array<double>")
    rows = sorted(got.collect(), key=lambda r: (r.lang, bytes(r.centroid)))
    return {"langs": [r.lang for r in rows], "centroids": np.stack([np.frombuffer(bytes(r.centroid), "f4") for r in rows]), "idf": idf, "least": np.array([r.least for r in rows])}


def predict(d: DataFrame, model: dict) -> DataFrame:
    """(id, lang_pred, score, accepted) of (id, text) rows.

    A text that is null or has no letter is ``und`` with score 0, and rejected. Any other gets the language
    of the nearest centroid and its cosine; it is rejected if that is below what texts of its length give.
    A text shorter than the shortest slice is never rejected for its distance."""
    langs, least = np.array(model["langs"], object), model["least"]
    centroids, idf = model["centroids"], model["idf"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part in slices(b, 1):
                texts = part.column(1).to_pylist()
                ok = np.array([has_letter(t) for t in texts]) & (len(langs) > 0)
                lang, score, accept = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts), bool)
                if ok.any():
                    c, n = grams([t for t, k in zip(texts, ok, strict=True) if k])
                    cos = vectors(c, idf) @ centroids.T
                    best = cos.argmax(1)
                    s = np.clip(cos[np.arange(len(best)), best].astype("f8"), 0, 1)
                    rung = np.searchsorted(SLICES, n, "right") - 1
                    lang[ok], score[ok] = langs[best], s
                    accept[ok] = (rung < 0) | (s >= least[best, np.maximum(rung, 0)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(accept, pa.bool_())], names=["id", "lang_pred", "score", "accepted"])

    return d.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(tidy(run), "id long, lang_pred string, score double, accepted boolean")


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``folds``, is ``fold``; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def accepted(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose text the classifier, fitted on its labelled rows, accepts; all columns, as they are.

    Null texts and texts without a letter go. Rows are taken one by one: repeated rows and null ids are of no matter."""
    small_batches(df.sparkSession)
    model = fit(df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")))
    langs, least, centroids, idf = model["langs"], model["least"], model["centroids"], model["idf"]
    place = df.columns.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part in slices(b, place):
                texts = part.column(place).to_pylist()
                keep = np.array([has_letter(t) for t in texts])
                if keep.any() and len(langs):
                    c, n = grams([t for t, k in zip(texts, keep, strict=True) if k])
                    cos = vectors(c, idf) @ centroids.T
                    best = cos.argmax(1)
                    rung = np.searchsorted(SLICES, n, "right") - 1
                    keep[keep] = (rung < 0) | (cos[np.arange(len(best)), best] >= least[best, np.maximum(rung, 0)])
                yield part.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(tidy(run), df.schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learnt from four of five folds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text", "lang")
    model = fit(docs.where(F.col("id").isNotNull() & ~held_out(F.col("id"), 5, 0)))
    p = predict(docs.select("id", "text"), model)
    return p.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 5, 0).alias("held_out"), "lang_pred", "score", "accepted")

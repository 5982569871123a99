"""Near-duplicates by weighted Jaccard: BagMinHash signatures, banding, exact check of multiset overlap.

A shingle of count w owns the slab [0, w) of a weight axis cut into unit cells. Points fall on axis and time
as a Poisson process; a signature component is the earliest point with its label on the document's slabs, so
two documents agree on a component with probability sum(min) / sum(max), their weighted Jaccard similarity.
The process is laid out in octaves [0,1), [1,2), [2,4), [4,8), ... and split by halves only around points that
come before the signature's latest component; all else is never generated."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.llm.common import materialise, small_batches, tidy
from twinlake.llm.components import components
from twinlake.llm.tokens import binary

WORDS, THRESHOLD = 5, 0.8
#: Bands of components that must all agree: a pair at 0.8 is missed with probability 5e-6, one at 0.3 is a candidate with 0.03.
BANDS, ROWS = 40, 6

#: Hashes of words, and keys of texts, that a worker remembers at once.
REMEMBERED_WORDS, REMEMBERED_TEXTS = 100_000, 5_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_words: dict[str, int] = {}


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """A hash of every run of ``size`` lower-cased words; a shorter text is one shingle, one without words has none."""
    parts = (text or "").lower().split()
    if not parts:
        return np.zeros(0, _U)
    if len(_words) > REMEMBERED_WORDS:
        _words.clear()
    for w in set(parts):
        if w not in _words:
            _words[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, parts), _U, len(parts))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, _U)
    for k in range(n):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[k : k + len(out)])
    return out


def multiset(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(hashes, return_counts=True)


def _uniform(elem, start, size, count, salt: int) -> np.ndarray:
    seed = mix(elem + _U(salt)) ^ mix(start.astype(_U) * _U(0x9E3779B97F4A7C15) + size.astype(_U) * _U(0xC2B2AE3D27D4EB4F) + count.astype(_U) * _U(0x165667B19E3779F9))
    return (mix(seed) >> _U(11)).astype("f8") * 2.0**-53


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """BagMinHash: a row of m point times for each bag of (hashes, counts); infinite for an empty bag."""
    low = np.full((len(bags), m), np.inf)
    flat = low.reshape(-1)
    n = np.array([len(b[0]) for b in bags])
    doc = np.repeat(np.arange(len(bags)), n)
    if not len(doc):
        return low
    elem = np.concatenate([b[0] for b in bags])
    weight = np.concatenate([b[1] for b in bags]).astype("i8")
    items = [(doc, elem, weight, np.zeros(len(doc), "i8"), np.ones(len(doc), "i8"))]
    start = 1
    while (more := weight > start).any():
        items.append((doc[more], elem[more], weight[more], np.full(more.sum(), start), np.full(more.sum(), start)))
        start *= 2
    doc, elem, weight, start, size = (np.concatenate(c) for c in zip(*items, strict=True))
    x, count = np.zeros(len(doc)), np.zeros(len(doc), "i8")
    while len(doc):
        last = low.max(1)
        per = np.bincount(doc, minlength=len(bags))
        nxt = []
        # inner nodes give one point; the halves beside its path go on from there
        inner = size > 1
        if inner.any():
            d, e, w, a, s, c = (v[inner] for v in (doc, elem, weight, start, size, count))
            t = x[inner] - np.log1p(-_uniform(e, a, s, c, 1)) / s
            ok = t <= last[d]
            d, e, w, a, s, c, t = (v[ok] for v in (d, e, w, a, s, c, t))
            at = a + (_uniform(e, a, s, c, 3) * s).astype("i8")
            label = (_uniform(e, a, s, c, 2) * m).astype("i8")
            hit = at < w
            np.minimum.at(flat, (d * m + label)[hit], t[hit])
            while len(d):
                s = s // 2
                right = at >= a + s
                beside = np.where(right, a, a + s)
                a = np.where(right, a + s, a)
                go = beside < w
                nxt.append((d[go], e[go], w[go], beside[go], s[go], t[go], np.zeros(go.sum(), "i8")))
                leaf = s == 1
                end = leaf & (a < w)
                nxt.append((d[end], e[end], w[end], a[end], s[end], t[end], np.zeros(end.sum(), "i8")))
                d, e, w, a, s, t, at = (v[~leaf] for v in (d, e, w, a, s, t, at))
        # cells give points one after another; short documents draw many at once
        draws = 1 << np.clip(np.ceil(np.log2(np.maximum(1, 3 * m / np.maximum(per, 1)))), 0, 9).astype("i8")
        cell = ~inner
        for k in np.unique(draws[doc[cell]]) if cell.any() else ():
            pick = cell & (draws[doc] == k)
            d, e, w, a, s, c = (v[pick] for v in (doc, elem, weight, start, size, count))
            rows = np.repeat(np.arange(len(d)), k)
            cc = c[rows] + np.tile(np.arange(k), len(d))
            gap = -np.log1p(-_uniform(e[rows], a[rows], s[rows], cc, 1))
            t = np.add.accumulate(np.concatenate([x[pick][:, None], gap.reshape(-1, k)], 1), axis=1)[:, 1:]
            ok = (t <= last[d][:, None]).reshape(-1)
            label = (_uniform(e[rows[ok]], a[rows[ok]], s[rows[ok]], cc[ok], 2) * m).astype("i8")
            np.minimum.at(flat, d[rows[ok]] * m + label, t.reshape(-1)[ok])
            on = t[:, -1] <= last[d]
            nxt.append((d[on], e[on], w[on], a[on], s[on], t[on, -1], c[on] + k))
        doc, elem, weight, start, size, x, count = (np.concatenate(c) for c in zip(*nxt, strict=True)) if nxt else (np.zeros(0, "i8"),) * 7
        now = low.max(1)
        on = x <= now[doc]
        doc, elem, weight, start, size, x, count = (v[on] for v in (doc, elem, weight, start, size, x, count))
    return low


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(sig).view(_U).reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=_U), (len(sig), bands)).copy()
    for k in range(rows):
        key = mix(key * _U(0x9E3779B97F4A7C15) + bits[:, :, k])
    return key.view("i8")


def banded(d: DataFrame, bands: int, rows: int) -> DataFrame:
    """(h, size, keys) of (h, text), ``h`` being a digest of the text: its shingles, and band keys unless it has no words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[bytes, tuple[int, list[int]]] = {}
        for b in it:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(0).to_pylist()
                if len(done) > REMEMBERED_TEXTS:
                    done.clear()
                new = {n: i for i, n in enumerate(texts) if n not in done}
                first = list(dict.fromkeys(texts))
                bags = [multiset(shingles(t)) for t in part.column(1).take(pa.array(list(new.values()), pa.int32())).to_pylist()]
                keys = band_keys(signatures(bags, bands * rows), bands, rows).tolist()
                done |= {n: (int(bag[1].sum()), k if len(bag[0]) else []) for n, k, bag in zip(new, keys, bags, strict=True)}
                yield pa.RecordBatch.from_arrays([binary(first), pa.array([done[n][0] for n in first], pa.int64()), pa.array([done[n][1] for n in first], pa.list_(pa.int64()))], names=["h", "size", "keys"])

    return d.mapInArrow(tidy(run), "h binary, size long, keys array<long>")


def to_bag(hashes: np.ndarray) -> bytes:
    """The low 48 bits of each hash, sorted, repeats included."""
    x = np.sort(hashes & _U((1 << 48) - 1))
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_bag(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def bags_of(d: DataFrame) -> DataFrame:
    """(node, bag): the shingles of each text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), binary([to_bag(shingles(t)) for t in part.column(1).to_pylist()])], names=["node", "bag"])

    return d.mapInArrow(tidy(run), "node long, bag binary")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Multiset Jaccard of two sorted arrays."""
    (u, n), (v, k) = multiset(a), multiset(b)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], k[j]).sum())
    return both / max(1, len(a) + len(b) - both)


def linked(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough, with their ``similarity``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in it:
            for at in range(0, p.num_rows, 256):
                part = p.slice(at, 256)
                s = [similarity(from_bag(x), from_bag(y)) for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True)]
                keep = pa.array([v >= threshold for v in s], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(s, pa.float64())], names=["a", "b", "similarity"]).filter(keep)

    j = pairs.join(bags.select(F.col("node").alias("a"), F.col("bag").alias("x")), "a").join(bags.select(F.col("node").alias("b"), F.col("bag").alias("y")), "b")
    return j.select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long, similarity double")


def occurrences(sorted_bag: np.ndarray) -> np.ndarray:
    """Repeats made different: each hash mixed with its number among its equals, so that multisets become sets."""
    if not len(sorted_bag):
        return sorted_bag
    first = np.flatnonzero(np.concatenate([[True], sorted_bag[1:] != sorted_bag[:-1]]))
    nth = np.arange(len(sorted_bag)) - np.repeat(first, np.diff(np.concatenate([first, [len(sorted_bag)]])))
    return np.where(nth == 0, sorted_bag, mix(sorted_bag + nth.astype(_U) * _U(0x9E3779B97F4A7C15)))


def _block(threshold: float):
    """Of one block of others and one of members: the pairs of components that a link joins, each once.

    One other at a time is marked in the table of all others' shingles and counted along some members' at once."""

    def run(key, others: pa.Table, members: pa.Table) -> pa.Table:
        found: set[tuple[int, int]] = set()
        if others.num_rows and members.num_rows:
            asked = [occurrences(from_bag(x)) for x in others.column("bag").to_pylist()]
            words = np.unique(np.concatenate(asked))
            mine = [np.searchsorted(words, x).astype("i4") for x in asked]
            mark = np.zeros(len(words), bool)
            for start in range(0, members.num_rows if len(words) else 0, MEMBERS_AT_ONCE):
                part = members.slice(start, MEMBERS_AT_ONCE)
                bags = [occurrences(from_bag(x)) for x in part.column("bag").to_pylist()]
                size = np.array([len(x) for x in bags])
                flat = np.concatenate(bags)
                at = np.minimum(np.searchsorted(words, flat), len(words) - 1).astype("i4")
                hit = words[at] == flat
                row, at = np.repeat(np.arange(len(size), dtype="i4"), size)[hit], at[hit]
                comp = part.column("comp").to_numpy()
                for c, x in zip(others.column("comp").to_pylist(), mine, strict=True):
                    mark[x] = True
                    both = np.bincount(row[mark[at]], minlength=len(size))
                    mark[x] = False
                    near = (both >= threshold * np.maximum(1, len(x) + size - both)) & (comp != c)
                    found |= {(min(c, m), max(c, m)) for m in np.unique(comp[near]).tolist()}
        a, b = list(zip(*sorted(found), strict=True)) or [[], []]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


#: Bytes of shingles of the others and of the members that one task gets, and members whose shingles are laid out at once.
OTHERS_BYTES, MEMBERS_BYTES, MEMBERS_AT_ONCE = 4 << 20, 32 << 20, 512


def remaining_links(first: DataFrame, label: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """(a, b): components between which nodes of one pivot have a link that the first round did not see.

    ``first`` is (a = pivot, b = node). Of a pivot's nodes those outside its largest component are a query set,
    held against all its nodes in blocks of bounded size; a row is a pair of components, never one of nodes."""
    own = first.select(F.col("a").alias("pivot"), F.col("b").alias("node")).join(label, "node", "left").select("pivot", "node", F.coalesce("comp", "node").alias("comp"))
    per = own.groupBy("pivot", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = per.groupBy("pivot").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("pivot", "main")
    rest = own.join(mixed, "pivot").select("pivot", "node", "comp", (F.col("comp") != F.col("main")).alias("other"))
    rest = materialise(rest.join(bags.select("node", F.octet_length("bag").alias("bytes")), "node"), "bag-rest")
    split = rest.groupBy("pivot").agg(F.ceil(F.sum(F.when(F.col("other"), F.col("bytes")).otherwise(0)) / OTHERS_BYTES).alias("obs"), F.ceil(F.sum("bytes") / MEMBERS_BYTES).alias("mbs"))
    rest = rest.join(split.select("pivot", F.greatest("obs", F.lit(1)).alias("obs"), F.greatest("mbs", F.lit(1)).alias("mbs")), "pivot").join(bags, "node")
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    others = rest.where("other").select("pivot", "node", "comp", "bag", dealt("obs").alias("ob"), every("mbs").alias("mb"))
    members = rest.select(*[F.col(c).alias(c) for c in ("pivot", "node", "comp", "bag")], dealt("mbs").alias("mb"), every("obs").alias("ob"))
    keys = ["pivot", "ob", "mb"]
    return others.groupBy(keys).cogroup(members.groupBy(keys)).applyInArrow(_block(threshold), "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: its id column, ``class_id`` (smallest id of its class), ``class_size``, ``is_first``.

    Documents of equal text (by a digest of 128 bits) are one node, numbered when the table of distinct texts
    is written. Nodes that share a band key are candidates; every link is checked on the whole multisets of
    five-word shingles. In a bucket all are first held against its smallest node, the pivot, but for those
    whose length alone rules a link out; then, where a pivot's nodes still lie in several
    components, those outside the largest of them are a query set that is held, in blocks, against all its
    nodes. So every pair that shares a key is checked or already joined. Null texts are each
    a class of their own, with their id as class; texts without words are linked to equal texts only.
    A null id stays null and counts in its class; rows that repeat the first's id and text are all
    first, being one document."""
    small_batches(df.sparkSession)
    d = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    full = d.where("text is not null").select("id", F.unhex(F.md5("text")).alias("h"), "text")
    distinct = full.groupBy("h").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    distinct = materialise(distinct.withColumn("node", F.monotonically_increasing_id()), "bag-texts")
    banded_once = banded(full.select("h", "text"), bands, rows).groupBy("h").agg(F.first("size").alias("size"), F.first("keys").alias("keys"))
    keys = materialise(banded_once.join(distinct.select("h", "node"), "h").select("h", "node", "size", "keys"), "bag-keys")
    key = keys.select("node", F.explode("keys").alias("key"))
    pivot = key.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialise(key.join(pivot, "key").where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "bag-pairs")
    needed = first.select(F.col("a").alias("node")).union(first.select(F.col("b").alias("node"))).distinct().join(keys.select("h", "node"), "node")
    texts = full.groupBy("h").agg(F.first("text").alias("text")).join(needed, "h").select("node", "text")
    bags = materialise(bags_of(texts), "bags")
    size = keys.select("node", "size")
    near = first.join(size.select(F.col("node").alias("a"), F.col("size").alias("n")), "a").join(size.select(F.col("node").alias("b"), F.col("size").alias("m")), "b")
    near = near.where(F.least("n", "m") >= F.lit(threshold) * F.greatest("n", "m")).select("a", "b")
    edges = materialise(linked(near, bags, threshold), "bag-links")
    label = components(edges)
    extra = materialise(remaining_links(first, label, bags, threshold), "bag-links")
    if extra.limit(1).count():
        top = components(extra).select(F.col("node").alias("part"), F.col("comp").alias("top"))
        joined = label.join(top, label.comp == top.part, "full_outer")  # a part without a label is a node by itself
        label = materialise(joined.select(F.coalesce("node", "part").alias("node"), F.coalesce("top", "comp").alias("comp")), "bag-label")
    node = distinct.join(label, "node", "left").select("h", "node", "least", "n", F.coalesce("comp", "node").alias("comp"))
    group = node.groupBy("comp").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"), F.min_by("node", F.struct(F.col("least").isNull(), "least", "node")).alias("first_node"))
    known = node.join(group, "comp").select("h", "class_id", "class_size", (F.col("node") == F.col("first_node")).alias("_kept"))
    out = full.select("id", "h").join(known, "h").select("id", "class_id", "class_size", "_kept")
    alone = d.where("text is null").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("_kept"))
    out = out.withColumn("_kept", F.col("_kept") & F.col("id").eqNullSafe(F.col("class_id"))).unionByName(alone)
    return out.select(F.col("id").alias(id_col), "class_id", "class_size", F.col("_kept").alias("is_first"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its exact and near copies."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

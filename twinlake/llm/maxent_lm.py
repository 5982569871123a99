"""Hashed maximum-entropy language model with class-factored softmax.

Events are the words seen in training, the end, and one event for all unseen words. A word's probability is a product
of softmaxes along its path of classes, ``SLOTS`` to a class: the most frequent words have short paths of their own;
all others that training has twice or more are dealt over ``BUCKETS`` buckets by a hash of the whole word, and share a
bucket by their counts; words seen once, and unseen ones, are one class, which its counts of counts divide. Each
softmax adds a fixed log frequency and the weights of three hashed features of the history at that class: the word
before, both words before, and at the root the last but one alone (a skip). Words enter features by a hash of the whole word, so no word is
without n-gram and skip features, whatever its frequency.

Counts cover all training documents, and gradients are taken at every position of every one of them: tasks take local
AdaGrad steps from shared weights, and what they changed is averaged row by row, by how much each task saw of a row. Equal events of a batch are one, with their count."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinlake.llm.bpe import pack_places, unpack_places
from twinlake.llm.common import materialise, tidy
from twinlake.llm.tokens import binary

SLOTS = 16
#: Slots of the root: five of one word, one of 16 words, three of 256, six of 4,096 buckets, one for words seen once or never.
DIRECT, TOP, MID, BUCKETS, RARE_SLOT = 5, 16, 3 * 256, 6 * 4096, 15
HEAD = DIRECT + TOP + MID
#: Codes of words: rank among the frequent ones, the rare class, then buckets.
RARE, CODES = HEAD, HEAD + 1 + BUCKETS
#: Classes: the root, its slots, theirs, and theirs.
NODES = 1 + 16 + 256 + 4096
ROW_BITS, START = 18, np.uint32(0xFFFFFFFF)
ROUNDS, RATE, MINIBATCH, FIRST_SEEN = 1, 0.3, 4096, 0.05
#: Positions that one task learns from, blocks that weights travel in, and characters of a batch of documents.
TASK_POSITIONS, BLOCKS, BATCH_CHARS = 8_000_000, 64, 20_000_000
#: Positions of a batch that are put in random order, and equal events among them put together, at once.
TOGETHER = 1 << 19

_U = np.uint32
#: A row of weights as one item, which is moved whole.
ROW = np.dtype(("V", 4 * SLOTS))


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A to Z lower-cased, then the end, which is the empty word."""
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(b"")
    return out


class Words:
    """A batch: documents as places in the list of their distinct words, in order of first use."""

    def __init__(self, number: int):
        self.number, self.words = number, defaultdict(count().__next__)  # a new word's place is the number of those before it
        self.docs, self.train, self.places, self.chars = [], [], [], 0

    def add(self, doc, train: bool, text: str | None) -> None:
        got = tokens(text)
        self.docs.append(doc)
        self.train.append(train)
        self.places.append(np.fromiter(map(self.words.__getitem__, got), "<u4", len(got)))
        self.chars += len(text or "")


def _batches(it: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    first, k = TaskContext.get().partitionId() << 32, 0
    held = Words(first)
    for b in it:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            for row in zip(*(part.column(c).to_pylist() for c in ("id", "train", "text")), strict=True):
                held.add(*row)
                if held.chars >= BATCH_CHARS:
                    yield held
                    k += 1
                    held = Words(first + k)
    if held.docs:
        yield held


HELD = "batch long, docs array<long>, train array<boolean>, lens array<long>, places binary"


def batches(d: DataFrame) -> DataFrame:
    """A row a batch of (id, train, text): its distinct words, and its documents as places in them."""

    def run(it):
        for b in _batches(it):
            yield pa.RecordBatch.from_arrays([
                pa.array([b.number], pa.int64()), pa.array([b.docs], pa.list_(pa.int64())), pa.array([b.train], pa.list_(pa.bool_())), pa.array([[len(p) for p in b.places]], pa.list_(pa.int64())),
                binary([pack_places(np.concatenate(b.places))]), pa.array([list(b.words)], pa.list_(pa.binary())),
            ], names=[x.split()[0] for x in HELD.split(", ")] + ["words"])

    return d.mapInArrow(tidy(run), HELD + ", words array<binary>")


def _rows(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in it:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def word_counts(t: DataFrame) -> DataFrame:
    """(batch, idx, word, c, nth): each batch's distinct words with their count in all training documents.

    One shuffle by word, of one row a word and batch, and one sort; ``nth`` is 1 in one row of each word."""

    def run(it):
        for r in _rows(it):
            used = unpack_places(r["places"])[np.repeat(np.array(r["train"], bool), r["lens"])]
            n = np.bincount(used, minlength=len(r["words"]))
            for at in range(0, len(n), 50_000):
                w = r["words"][at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([r["batch"]] * len(w), pa.int64()), pa.array(range(at, at + len(w)), pa.int32()), binary(w), pa.array(n[at : at + len(w)], pa.int64())], names=["batch", "idx", "word", "n"])

    own = Window.partitionBy("word").orderBy("batch")
    every = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = t.drop("docs").mapInArrow(tidy(run), "batch long, idx int, word binary, n long")
    return d.select("batch", "idx", "word", F.sum("n").over(every).alias("c"), F.row_number().over(own).alias("nth"))


def coded(t: DataFrame, words: DataFrame, head: dict[bytes, int]) -> DataFrame:
    """The batches with each distinct word's training count, hash and code in place of the words."""
    rank = t.sparkSession.createDataFrame([(bytearray(w), i) for w, i in head.items()], "word binary, rank int")
    known = words.join(rank, "word", "left") if head else words.withColumn("rank", F.lit(None).cast("int"))
    code = F.when(F.col("rank").isNotNull(), F.col("rank")).when(F.col("c") <= 1, RARE).otherwise(RARE + 1 + F.crc32("word") % BUCKETS).cast("int")
    known = known.select("batch", "idx", "c", F.crc32("word").alias("crc"), code.alias("code"))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({n: [] for n in names}, schema=schema)
        at, more = right.column("idx").to_numpy(), []
        for name, kind in (("c", "<i8"), ("crc", "<u4"), ("code", "<i4")):
            x = np.zeros(len(at), kind)
            x[at] = right.column(name).to_numpy()
            more.append(binary([x.tobytes()]))
        return pa.table([*[left.column(k) for k in names[:-3]], *more], schema=schema)

    names = [x.split()[0] for x in HELD.split(", ")] + ["c", "crc", "code"]
    schema = pa.schema([("batch", pa.int64()), ("docs", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("lens", pa.list_(pa.int64())), ("places", pa.binary()), ("c", pa.binary()), ("crc", pa.binary()), ("code", pa.binary())])
    return t.drop("words").groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(run, HELD + ", c binary, crc binary, code binary")


def paths(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes and slots of each code's path, four columns, and how many of them count."""
    t, q, b = code - DIRECT, code - DIRECT - TOP, code - RARE - 1
    direct, rare = code < DIRECT, code == RARE
    top, mid = (code >= DIRECT) & (t < TOP), (q >= 0) & (q < MID)
    slot = np.where(direct, code, np.where(top, DIRECT, np.where(mid, 1 + DIRECT + q // 256, np.where(rare, RARE_SLOT, 4 + DIRECT + b // 4096))))
    one = np.where(top, t, np.where(mid, q // 16 % 16, b // 256 % 16))
    two = np.where(mid, q % 16, b // 16 % 16)
    depth = np.where(direct | rare, 1, np.where(top, 2, np.where(mid, 3, 4)))
    node = np.stack([np.zeros_like(slot), 1 + slot, 17 + slot * 16 + one, 273 + slot * 256 + one * 16 + two], 1)
    return node.astype("i4"), np.stack([slot, one, two, b % 16], 1).astype("i4"), depth


def log_frequencies(mass: np.ndarray) -> np.ndarray:
    """The fixed part of each class's softmax: the log of how often its slots are taken; ``mass`` is by code."""
    node, slot, depth = paths(np.arange(CODES))
    out = np.zeros(NODES * SLOTS)
    for k in range(4):
        on = depth > k
        out += np.bincount(node[on, k] * SLOTS + slot[on, k], weights=mass[on], minlength=len(out))
    with np.errstate(divide="ignore"):
        return np.log(out).astype("f4").reshape(NODES, SLOTS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(16))) * _U(0x85EBCA6B)
    return (x ^ (x >> _U(13))) * _U(0xC2B2AE35)


def features(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Hashes of the three features of each position's history: the word before, the pair, the skip."""
    a, b = _mix(h1 * _U(0x9E3779B1) + _U(1)), _mix(h2 * _U(0x85EBCA77) + _U(2))
    return np.stack([a, _mix(a * _U(0x27D4EB2F) ^ b), b], 1)


_NODE, _SLOT, _DEPTH = paths(np.arange(CODES))
#: The same without what does not count, the steps of a code from ``_FIRST`` on.
_NODE, _SLOT = (x[np.arange(4) < _DEPTH[:, None]] for x in (_NODE, _SLOT))
_FIRST = np.cumsum(_DEPTH) - _DEPTH


class Examples:
    """One softmax a row: position, class, slot taken, rows of weights.

    The word before and the pair count at every class, the skip at the root, where most is decided, alone."""

    def __init__(self, code: np.ndarray, f: np.ndarray):
        depth = _DEPTH.take(code)
        self.of = np.repeat(np.arange(len(code)), depth)
        self.top = np.cumsum(depth) - depth
        step = np.repeat(_FIRST.take(code) - self.top, depth)
        step += np.arange(len(step))
        self.node, self.slot = _NODE.take(step), _SLOT.take(step)
        salt = self.node.astype(_U) * _U(0x165667B1)
        mixed = lambda x: (_mix(x) >> _U(32 - ROW_BITS)).astype("i4")
        self.rows = [mixed(np.repeat(f[:, 0], depth) + salt), mixed(np.repeat(f[:, 1], depth) + salt), mixed(f[:, 2] + salt.take(self.top))]


def _sums(bias: np.ndarray, w: np.ndarray, e: Examples) -> np.ndarray:
    """What each softmax is taken of."""
    z = bias.take(e.node, 0)
    z += w.take(e.rows[0], 0)
    z += w.take(e.rows[1], 0)
    z[e.top] += w.take(e.rows[2], 0)
    return z


def _exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``z``, its exponentials and their sums by row; less each row's largest, where any sum would leave a float's range."""
    with np.errstate(over="ignore"):
        x = np.exp(z)
    s = np.einsum("ij->i", x)
    if len(s) and not (1e-30 < s.min() and s.max() < 1e30):
        z = z - z.max(1, keepdims=True)
        x = np.exp(z)
        s = np.einsum("ij->i", x)
    return z, x, s


def _log_taken(bias: np.ndarray, w: np.ndarray, e: Examples) -> np.ndarray:
    """Log probability of the slot that each example takes."""
    z, _, s = _exponentials(_sums(bias, w, e))
    own = z.reshape(-1).take(np.arange(0, z.size, SLOTS) + e.slot)
    return own.astype("f8") - np.log(s.astype("f8"))


def _step(bias: np.ndarray, w: np.ndarray, seen: np.ndarray, e: Examples, times: np.ndarray | None = None) -> None:
    """One AdaGrad step, with one accumulator a row of weights; an example's position counts ``times``.

    Most rows are met by one example of a batch; only those met by more are summed."""
    _, g, s = _exponentials(_sums(bias, w, e))
    much = np.float32(1) if times is None else times.take(e.of)
    g *= (much / s)[:, None]
    g.reshape(-1)[np.arange(0, g.size, SLOTS) + e.slot] -= much
    flat, every = np.concatenate(e.rows), np.arange(len(g))
    order = np.argsort(flat)
    own, of = flat.take(order), np.concatenate([every, every, e.top]).take(order)
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    at, size = own.take(starts), np.diff(starts, append=len(own))
    total = g.take(of.take(starts), 0)
    shared = size > 1
    if shared.any():
        size_of = size[shared]
        total[shared] = np.add.reduceat(g.take(of[np.repeat(shared, size)], 0), np.cumsum(size_of) - size_of, axis=0)
    much = seen.take(at) + np.einsum("ij,ij->i", total, total) / SLOTS
    seen[at] = much
    total *= (-RATE / np.sqrt(much))[:, None]
    total += w.take(at, 0)
    np.put(w.reshape(-1).view(ROW), at, total.reshape(-1).view(ROW))


class Coded:
    """A coded batch: places in its words by position; what a position has is made for some positions at a time."""

    def __init__(self, r: dict):
        self.place, self.lens, self.train = unpack_places(r["places"]), np.array(r["lens"], "i8"), np.array(r["train"], bool)
        self.ends = np.cumsum(self.lens)
        self.starts = self.ends - self.lens
        self.c, self.crc, self.code = (np.frombuffer(r[k], kind) for k, kind in (("c", "<i8"), ("crc", "<u4"), ("code", "<i4")))

    def parts(self) -> Iterator[tuple[int, dict]]:
        """The first of ``TOGETHER`` positions, and for each its code, the two words before, and whether to learn from it."""
        for a in range(0, len(self.place), TOGETHER):
            at = np.arange(a, min(a + TOGETHER, len(self.place)))
            doc = np.searchsorted(self.ends, at, "right")
            nth, first = at - self.starts[doc], max(0, a - 2)
            crc = np.concatenate([np.full(2 - (a - first), START), self.crc[self.place[first : at[-1] + 1]]])
            h1, h2 = np.where(nth < 1, START, crc[1 : 1 + len(at)]), np.where(nth < 2, START, crc[: len(at)])
            yield a, {"code": self.code[self.place[a : at[-1] + 1]], "h1": h1, "h2": h2, "train": self.train[doc]}


def _events(p: dict, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of the positions ``used`` for each event (word and history) among them, and how often it occurs."""
    key = (p["h1"][used].astype("u8") << np.uint64(32) | p["h2"][used]) * np.uint64(0x9E3779B97F4A7C15) + p["code"][used].astype("u8") * np.uint64(0xC2B2AE3D27D4EB4F)
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    return used[first], times.astype("f4")


def train(t: DataFrame, bias: np.ndarray, total: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after ``rounds`` of local steps in every task; ``t`` are coded batches that hold ``total`` positions to learn from.

    Weights are of fixed size. What a task changed travels in blocks with each row's sum of squared gradients,
    by which the changes are averaged: a row that one task alone has seen keeps all of its change."""
    w = np.zeros((1 << ROW_BITS, SLOTS), "f4")
    if not total:
        return w
    t = t.coalesce(int(-(-total // TASK_POSITIONS)))
    kind = "block int, part int, change binary, seen binary"
    for r in range(rounds):

        def run(it, w=w.astype("<f2"), r=r):
            w = w.astype("f4")
            v, seen, n = w.copy(), np.full(len(w), FIRST_SEEN, "f4"), 0
            for row in _rows(it):
                for _, p in Coded(row).parts():
                    used = np.flatnonzero(p["train"])
                    n += len(used)
                    some, times = _events(p, used)
                    order = np.random.default_rng(r).permutation(len(some))
                    for at in range(0, len(some), MINIBATCH):
                        i, k = some[order[at : at + MINIBATCH]], times[order[at : at + MINIBATCH]]
                        _step(bias, v, seen, Examples(p["code"][i], features(p["h1"][i], p["h2"][i])), k)
            if n:
                seen -= np.float32(FIRST_SEEN)
                cut = [[x.tobytes() for x in np.split(y, BLOCKS)] for y in ((v - w).astype("<f2"), seen)]
                yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([TaskContext.get().partitionId() % 16] * BLOCKS, pa.int32()), binary(cut[0]), binary(cut[1])], names=["block", "part", "change", "seen"])

        def add(key, rows):
            change, seen = np.zeros((len(w) // BLOCKS, SLOTS)), np.full(len(w) // BLOCKS, 1e-30)
            for x, y in zip(rows.column("change").to_pylist(), rows.column("seen").to_pylist(), strict=True):
                much = np.frombuffer(y, "<f4").astype("f8")
                change += np.frombuffer(x, "<f2").reshape(-1, SLOTS) * much[:, None]
                seen += much
            out = [binary([(change / seen[:, None]).astype("<f2").tobytes()]), binary([seen.astype("<f4").tobytes()])]
            return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "change": out[0], "seen": out[1]})

        got = t.mapInArrow(tidy(run), kind).groupBy("block", "part").applyInArrow(add, kind).groupBy("block").applyInArrow(add, kind).collect()
        w = w + np.concatenate([np.frombuffer(bytes(g.change), "<f2").astype("f4") for g in sorted(got, key=lambda g: g.block)]).reshape(w.shape)
    return w


class Model:
    """All that scoring needs, of fixed size: log frequencies, weights, and the counts that divide buckets and rare words."""

    def __init__(self, total: DataFrame):
        """From (word, c), a row for each training word."""
        top = total.where("c > 1").orderBy(F.desc("c"), "word").limit(HEAD).collect()
        self.head = {bytes(r.word): i for i, r in enumerate(top)}
        s = total.agg(*[F.coalesce(x, F.lit(0)) for x in (F.sum("c"), F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2))]).first()
        self.n, self.v, self.once, twice = s
        tail = total.where("c > 1")
        if len(top) == HEAD:
            least = top[-1]
            tail = tail.where((F.col("c") < least.c) | ((F.col("c") == least.c) & (F.col("word") > F.lit(bytearray(least.word)))))
        else:
            tail = tail.where(F.lit(False))
        self.bucket = np.zeros(BUCKETS)
        for r in tail.groupBy((F.crc32("word") % BUCKETS).alias("b")).agg(F.sum("c").alias("n")).collect():
            self.bucket[int(r.b)] = r.n
        self.mass = np.concatenate([np.pad(np.array([r.c for r in top], "f8"), (0, HEAD - len(top))), [self.once + 1], self.bucket])
        self.bias = log_frequencies(self.mass)
        #: Of the rare class, the share of unseen words: by what words seen once and twice say of each other.
        self.unseen = (self.once + 1) / (self.once + 2 * twice + 2) if self.once else 1.0
        self.weights = np.zeros((1 << ROW_BITS, SLOTS), "f4")

    def inside(self, code: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Log share of a word in what its path leads to."""
        out = np.zeros(len(code))
        tail, rare = code > RARE, code == RARE
        out[tail] = np.log(c[tail] / self.bucket[code[tail] - RARE - 1])
        out[rare] = np.where(c[rare] == 0, np.log(self.unseen), np.log(max(1 - self.unseen, 1e-300) / max(self.once, 1)))
        return out


def fitted(t: DataFrame) -> tuple[DataFrame, Model]:
    """The coded batches of ``t``, and the model learnt from their training documents."""
    words = materialise(word_counts(t), "lm-words")
    model = Model(words.where("nth = 1 and c > 0").select("word", "c"))
    t = materialise(coded(t, words, model.head), "lm-coded")
    model.weights = train(t, model.bias, model.n)
    return t, model


def scored(t: DataFrame, model: Model) -> DataFrame:
    """Per document of the coded batches: ``doc_id``, ``n_tokens``, ``n_known``, ``base_score``, ``score``."""

    def run(it):
        for r in _rows(it):
            t = Coded(r)
            known = np.add.reduceat((t.c > 0).astype("i8")[t.place], t.starts)
            base = np.add.reduceat(np.log10((t.c + 1) / (model.n + model.v + 1))[t.place], t.starts)
            logp = model.inside(t.code, t.c)[t.place]
            for start, p in t.parts():
                for at in range(0, len(p["code"]), MINIBATCH):
                    i = slice(at, at + MINIBATCH)
                    e = Examples(p["code"][i], features(p["h1"][i], p["h2"][i]))
                    n = len(p["code"][i])
                    logp[start + at : start + at + n] += np.bincount(e.of, weights=_log_taken(model.bias, model.weights, e), minlength=n)
            per = [known, base, np.add.reduceat(logp, t.starts) / np.log(10)]
            yield pa.RecordBatch.from_arrays([pa.array(r["docs"], pa.int64()), pa.array(t.lens), pa.array(per[0]), pa.array(per[1]), pa.array(per[2])], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return t.mapInArrow(tidy(run), "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score(df: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``n_tokens``, ``n_known``, ``base_score``, ``score``, ``train_tokens``.

    ``learn`` is a column that says from which rows to learn. Scores are log10 probabilities of the whole
    text; null and empty texts are the end alone; null ids and repeated rows are scored like any other.
    Texts are cut into words once: batches of documents, as places in the batch's distinct words, are written.
    Those words are counted over all training documents, and their counts meet each batch again by a join on the word."""
    d = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(learn, F.lit(False)).alias("train"), F.col(f"`{text_col}`").alias("text"))
    t, model = fitted(materialise(batches(d), "lm-batches"))
    return scored(t, model).withColumn("train_tokens", F.lit(model.n).cast("long"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document by a model learnt from six of seven folds."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    s = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold != 2)
    return s.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

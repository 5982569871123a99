"""Byte-level BPE over distinct words: encode each word once for all documents, reassemble by position.

Documents are read in batches. One pass gives each batch's distinct words, dealt out by word and sorted, so
that each word of the corpus is cut into pre-tokens and encoded once, by the task that holds it; another gives
each batch's documents as positions in its list of words. Both meet again by batch. A word is what stands
between blanks or line feeds, with the blank before it, which no pre-token crosses. Only distinct words of a
batch are shuffled, never occurrences, and a hot word is one row a batch."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.llm.common import others, tidy
from twinlake.llm.tokens import binary, spaced, spaced_text

#: Characters of text after which a batch is closed; a longer document is a batch of its own or ends one.
BATCH_CHARS = 24_000_000


class Batch:
    """Documents as places in the list of their distinct words, the most frequent first."""

    def __init__(self, number: int, cut=spaced):
        self.number, self.cut = number, cut
        self.seen: dict = {}
        self.docs, self.raw, self.lens, self.chars = [], [], [], 0

    def add(self, doc, text: str) -> None:
        got, seen = self.cut(text) if text else [], self.seen
        for w in dict.fromkeys(got):  # in order: workers differ in how they order sets
            if w not in seen:
                seen[w] = len(seen)
        self.docs.append(doc)
        self.raw.append(np.fromiter(map(seen.__getitem__, got), "<u4", len(got)))
        self.lens.append(len(got))
        self.chars += len(text)

    def close(self) -> Batch:
        """Number words by how often they come: small numbers compress well."""
        flat = np.concatenate(self.raw)
        self.raw = []
        order = np.argsort(-np.bincount(flat, minlength=len(self.seen)), kind="stable")
        place = np.empty(len(order), "<u4")
        place[order] = np.arange(len(order), dtype="<u4")
        words = list(self.seen)
        self.seen = {}
        self.words, self.places = [words[i] for i in order.tolist()], place[flat]
        return self


def batches_of(it: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
    """Batches of the (id, text) rows of one task, numbered by task; the same rows give the same batches."""
    first, k = TaskContext.get().partitionId() << 12, 0
    held = Batch(first)
    for b in it:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                held.add(doc, text or "")
                if held.chars >= BATCH_CHARS:
                    yield held.close()
                    k += 1
                    held = Batch(first + k)
    if held.docs:
        yield held.close()


def pack_places(places: np.ndarray) -> bytes:
    """Whole numbers under 2^32 as four byte planes, compressed."""
    raw = places.astype("<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(raw.T).tobytes())


def unpack_places(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view("<u4")


_held: dict = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoding(path: str):
    if path not in _held:
        import tiktoken

        _held[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    return _held[path]


def distinct_words(d: DataFrame) -> DataFrame:
    """(at, word): the distinct words of each batch of (id, text); ``at`` is batch and place in one number."""

    def run(it):
        for b in batches_of(it):
            for at in range(0, len(b.words), 50_000):
                w = b.words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(w), dtype="i8") + (b.number << 24)), pa.array(w, pa.string())], names=["at", "word"])

    return d.mapInArrow(tidy(run), "at long, word string")


def encode_words(words: DataFrame, ranks: str) -> DataFrame:
    """(batch, at, lens, ids): each distinct word is encoded once, where all its rows meet in order.

    A word's matches of the pattern are encoded one by one. A task's results go back in one row a batch,
    by place, compressed."""

    def run(it):
        enc, last, ids = _encoding(ranks), None, b""
        held_at, held = [], []

        def flush():
            at = np.concatenate(held_at)
            order = np.argsort(at)
            at = at[order]
            cuts = np.flatnonzero(np.diff(at >> 24)) + 1
            for part in np.split(np.arange(len(at)), cuts):
                got = [held[i] for i in order[part].tolist()]
                place = at[part] & 0xFFFFFF
                blobs = [pack_places(np.diff(place, prepend=0)), pack_places(np.array([len(x) // 4 for x in got])), pack_places(np.frombuffer(b"".join(got), "<u4"))]
                yield pa.RecordBatch.from_arrays([pa.array([int(at[part[0]] >> 24)], pa.int64()), *[binary([x]) for x in blobs]], names=["batch", "at", "lens", "ids"])

        for b in it:
            held_at.append(b.column("at").to_numpy())
            for w in b.column("word").to_pylist():
                if w != last:
                    last, ids = w, array("I", enc.encode_ordinary(spaced_text(w))).tobytes()
                held.append(ids)
            if len(held) > 1_000_000:
                yield from flush()
                held_at, held = [], []
        if held:
            yield from flush()

    return words.repartition("word").sortWithinPartitions("word").mapInArrow(tidy(run), "batch long, at binary, lens binary, ids binary")


def positions(d: DataFrame) -> DataFrame:
    """(batch, n_words, docs, lens, places): each batch's documents as places in its words."""

    def run(it):
        for b in batches_of(it):
            yield pa.RecordBatch.from_arrays([pa.array([b.number], pa.int64()), pa.array([len(b.words)], pa.int64()), pa.array([b.docs], pa.list_(pa.int64())), pa.array([b.lens], pa.list_(pa.int64())), binary([pack_places(b.places)])], names=["batch", "n_words", "docs", "lens", "places"])

    return d.mapInArrow(tidy(run), "batch long, n_words long, docs array<long>, lens array<long>, places binary")


def ragged(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs values[start : start + len], one after another."""
    ends = np.cumsum(lens)
    return values[np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]


def _reassemble(key, left: pa.Table, right: pa.Table) -> pa.Table:
    doc_ids, n_tokens, ids = [], [], []
    for r in left.to_pylist():
        length = np.full(r["n_words"], -1, "i8")
        start = np.zeros(r["n_words"], "i8")
        flat, at = [], 0
        for x in right.to_pylist():
            place, lens, got = np.cumsum(unpack_places(x["at"]), dtype="i8"), unpack_places(x["lens"]).astype("i8"), unpack_places(x["ids"])
            length[place], start[place] = lens, at + np.cumsum(lens) - lens
            flat.append(got)
            at += len(got)
        if (length < 0).any():
            raise RuntimeError("the two reads of the input gave different batches")
        flat = np.concatenate(flat) if flat else np.zeros(0, "<u4")
        place, at = unpack_places(r["places"]), 0
        for doc, n in zip(r["docs"], r["lens"], strict=True):
            p = place[at : at + n]
            at += n
            out = ragged(flat, start[p], length[p])
            doc_ids.append(doc)
            n_tokens.append(len(out))
            ids.append(out.tobytes())
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64()), "ids": binary(ids)})


def encode(df: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``doc_id``, ``n_tokens``, ``ids`` (little-endian 32-bit), as tiktoken's encode_ordinary.

    Null texts are empty and have no ids; null ids and repeated rows stay, each with its own ids. The
    input is read twice and must give the same rows in the same tasks both times (a table does); a
    difference is found and raised."""
    d = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    ids = encode_words(distinct_words(d), ranks)
    return positions(d).groupBy("batch").cogroup(ids.groupBy("batch")).applyInArrow(_reassemble, "doc_id long, n_tokens long, ids binary")


def _byte_table(ranks: str) -> list[bytes]:
    key = ("bytes", ranks)
    if key not in _held:
        table = {i: w for w, i in load_ranks(ranks).items()}
        _held[key] = [table.get(i, b"") for i in range(max(table) + 1)]
    return _held[key]


def decode(df: DataFrame, ranks: str, listed: bool = False) -> DataFrame:
    """Adds ``decoded`` (the bytes of ``ids``) by a lookup in the token-byte table, which has a row a token.

    ``listed`` adds the ids in decimal, joined by commas, as ``listed``. Columns of these names are replaced."""
    df = df.select(*[F.col(f"`{c}`") for c in others(df, "decoded", *["listed"] * listed)])

    def run(it):
        table = _byte_table(ranks)
        get, say = table.__getitem__, [str(i) for i in range(len(table))].__getitem__
        for b in it:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                ids = [np.frombuffer(x, "<u4").tolist() for x in part.column("ids").to_pylist()]
                more = [binary([b"".join(map(get, x)) for x in ids])]
                if listed:
                    more.append(pa.array([",".join(map(say, x)) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "decoded", "listed"][: len(part.columns) + len(more)])

    return df.mapInArrow(tidy(run), f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, decoded binary{', listed string' * listed}")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes that they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    d = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks), ranks, listed=True)
    return d.select("doc_id", "n_tokens", F.sha2("listed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

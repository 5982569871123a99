"""Token-id files: bit or byte planes of fixed-size id blocks, each compressed with zstandard.

A store is a folder of two Parquet tables, so that Spark commits, lists and reads it on any file system:
``chunks`` (shard, chunk, start in the shard, ids, block size, width, planes, ids and lengths of whole
documents) and ``index`` (shard, chunk, global start, ids, first and last document, bytes of each plane).
A chunk is a run of blocks that ends with a document, so each can be read alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.llm.common import fresh_path
from twinlake.llm.tokens import ENCODED, Encoder, binary, words_only

BLOCK, BLOCKS = 32768, 4
CHUNK = "shard int, chunk int, start long, n_ids long, block int, width int, mode string, planes array<binary>, doc_ids array<long>, doc_lens array<long>"


def to_planes(ids: np.ndarray, width: int, mode: str, press) -> list[bytes]:
    """The planes of one block, lowest first; the last bit plane's tail bits are zero."""
    if mode == "byte":
        raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [press(np.ascontiguousarray(raw[:, k]).tobytes()) for k in range((width + 7) // 8)]
    return [press(np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1).tobytes()) for k in range(width)]


def from_planes(planes: list[bytes], n: int, mode: str, unpress) -> np.ndarray:
    out = np.zeros(n, "<u4")
    for k, p in enumerate(planes):
        raw = np.frombuffer(unpress(p), np.uint8)
        if mode == "byte":
            out |= raw.astype("<u4") << np.uint32(8 * k)
        else:
            out |= np.unpackbits(raw, count=n).astype("<u4") << np.uint32(k)
    return out


def _writer(path: str, end_id: int, cut, block: int, mode: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, press = Encoder.of(path, cut), zstandard.ZstdCompressor(level=level).compress
        end = np.array([end_id], "<u4").tobytes()
        shard, chunk, start = TaskContext.get().partitionId(), 0, 0
        held, docs, lens, n = [], [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(held), "<u4")
            width = max(1, int(ids.max()).bit_length())
            planes = [p for at in range(0, len(ids), block) for p in to_planes(ids[at : at + block], width, mode, press)]
            row = [[shard], [chunk], [start], [len(ids)], [block], [width], [mode], [planes], [docs], [lens]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = [x.split()[0] for x in CHUNK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=names)

        for b in batches:
            for at in range(0, b.num_rows, ENCODED):
                part = b.slice(at, ENCODED)
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                    held.append(ids + end)
                    docs.append(doc)
                    lens.append(len(ids) // 4 + 1)
                    n += lens[-1]
                    if n >= block * BLOCKS:
                        yield flush()
                        chunk, start = chunk + 1, start + n
                        held, docs, lens, n = [], [], [], 0
        if n:
            yield flush()

    return run


def write_store(df: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", cut=words_only, block: int = BLOCK, mode: str = "bit", level: int = 3) -> None:
    """Encode every text and write a store, documents in ascending id order.

    Null texts are empty: they hold ``end_id`` alone. A null id sorts first; rows of one id are all
    kept, ordered by text. Only (id, text) is dealt out by range of id, so a task holds a chunk at a time."""
    d = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    d = d.repartitionByRange("id").sortWithinPartitions("id", "text")
    d.mapInArrow(_writer(tokenizer, end_id, cut, block, mode, level), CHUNK).write.option("compression", "none").parquet(f"{path}/chunks")
    c = df.sparkSession.read.schema(CHUNK).parquet(f"{path}/chunks")
    base = _bases(df.sparkSession, path)
    ordered = sorted(base)
    shift = F.coalesce(F.get(F.lit([base[s] for s in ordered]) if ordered else F.array().cast("array<long>"), F.array_position(F.lit(ordered) if ordered else F.array().cast("array<int>"), F.col("shard")).cast("int") - 1), F.lit(0).cast("long"))
    c.select("shard", "chunk", (F.col("start") + shift).alias("start"), "n_ids", F.get("doc_ids", 0).alias("first_doc"), F.element_at("doc_ids", -1).alias("last_doc"), F.transform("planes", F.length).alias("plane_bytes")).write.parquet(f"{path}/index")


def _bases(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each shard: one number a shard, and there are as many shards as tasks wrote."""
    out, total = {}, 0
    for r in spark.read.schema(CHUNK).parquet(f"{path}/chunks").groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect():
        out[r.shard] = total
        total += r.n
    return out


def read_store(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Per document: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (little-endian 32-bit).

    The chunk index gives each shard, or chunk, its start, and says which chunks hold ids from ``first`` to ``last``: only
    these are unpacked. Without bounds all documents are read; with a bound, those with a null id are not."""
    index = spark.read.parquet(f"{path}/index")
    chunks = spark.read.schema(CHUNK).parquet(f"{path}/chunks")
    if first is None and last is None:
        # a row a shard, so as many as tasks wrote: the planes stay where they are read
        base = index.groupBy("shard").agg(F.min("start").alias("base"))
        chunks = chunks.join(F.broadcast(base), "shard").withColumn("start", F.col("start") + F.col("base"))
    if first is not None:
        index = index.where(F.col("last_doc") >= first)
    if last is not None:
        index = index.where(F.col("first_doc").isNull() | (F.col("first_doc") <= last))
    if first is not None or last is not None:
        chunks = chunks.drop("start").join(index.select("shard", "chunk", "start"), ["shard", "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for r in (row for k in range(b.num_rows) for row in b.slice(k, 1).to_pylist()):
                per = r["width"] if r["mode"] == "bit" else (r["width"] + 7) // 8
                parts = []
                for k, at in enumerate(range(0, r["n_ids"], r["block"])):
                    parts.append(from_planes(r["planes"][k * per : (k + 1) * per], min(r["block"], r["n_ids"] - at), r["mode"], unpress))
                ids = np.concatenate(parts).tobytes()
                ends = np.cumsum(np.array(r["doc_lens"], "i8"))
                starts = ends - np.array(r["doc_lens"], "i8")
                cut = [ids[4 * a : 4 * z] for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["start"], pa.int64()), pa.array(r["doc_lens"], pa.int64()), binary(cut)], names=["doc_id", "start", "n_tokens", "ids"])

    out = chunks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
    for bound, ok in ((first, F.col("doc_id") >= F.lit(first)), (last, F.col("doc_id") <= F.lit(last))):
        out = out if bound is None else out.where(ok)
    return out


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as read back from its store."""
    path = fresh_path(spark, "token-store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

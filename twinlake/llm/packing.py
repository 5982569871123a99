"""Best-fit packing of documents into sequences after Martello-Toth dominance reduction.

Sizes are whole numbers up to the capacity, so an instance is a histogram of at most ``capacity`` counts,
whatever the number of documents. Reduction and best fit run on the histogram with multiplicities and give
a plan of bin patterns; documents then find their place in the plan by their rank among those of one size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinlake.llm.common import materialise, others, small_batches, tidy
from twinlake.llm.tokens import ENCODED, Encoder, binary, spaced

CAPACITY = 1024
PIECE = "doc_id long, piece int, start long, length long, ids binary"


def dominance(count: dict[int, int], capacity: int) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """Fix bins that dominate every other bin of their largest item; what is left is a smaller instance.

    For the largest item j, with room for r more: (1) nothing fits: {j}; (2) an item of just r: {j, r};
    (3) no two others fit together: {j, largest that fits}; (4) no three others fit, and {j, k, l} with k
    the largest that fits and l the largest beside it beats any other pair item by item."""
    count, fixed, changed = {s: n for s, n in count.items() if n}, [], True

    def fix(parts: list[int], times: int):
        pattern = {s: parts.count(s) for s in parts}
        for s, n in pattern.items():
            count[s] -= n * times
            if not count[s]:
                del count[s]
        fixed.append((times, pattern))

    while changed:
        changed = False
        for j in sorted(count, reverse=True):
            while j in count:
                room, own = capacity - j, sorted(count)
                # what is there besides one j, up to three of a size
                rest = [s for s in own for _ in range(min(3, count[s] - (s == j)))]
                fit = [s for s in rest if s <= room]
                if not fit:
                    fix([j], count[j])
                elif room in fit:
                    fix([j, room], count[j] // 2 if j == room else min(count[j], count[room]))
                elif len(rest) < 2 or rest[0] + rest[1] > room:
                    if fit[-1] == j:
                        break
                    fix([j, fit[-1]], min(count[j], count[fit[-1]]))
                elif len(rest) < 3 or sum(rest[:3]) > room:
                    k = fit[-1]
                    beside = [s for s in fit[:-1] if s <= room - k]
                    smaller = [q for i, q in enumerate(fit) if i + 1 < len(fit) and q + fit[i + 1] <= room]
                    if j in (k, *beside[-1:]) or not beside or (smaller and smaller[-1] > beside[-1]):
                        break
                    fix([j, k, beside[-1]], min(count[j], count[k] // 2 if k == beside[-1] else min(count[k], count[beside[-1]])))
                else:
                    break
                changed = True
    return fixed, count


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best fit, largest first, with multiplicities: equal bins are one entry."""
    open_bins: dict[int, list[tuple[int, dict[int, int]]]] = {}
    for s in sorted(count, reverse=True):
        left = count[s]
        while left:
            room = min((r for r, g in open_bins.items() if r >= s and g), default=None)
            if room is None:
                each = capacity // s
                if full := left // each:
                    open_bins.setdefault(capacity - each * s, []).append((full, {s: each}))
                if part := left % each:
                    open_bins.setdefault(capacity - part * s, []).append((1, {s: part}))
                break
            times, pattern = open_bins[room].pop()
            each = room // s
            used = min(times, left // each)
            if used:
                open_bins.setdefault(room - each * s, []).append((used, pattern | {s: each}))
                left, times = left - used * each, times - used
            if left and times and left < each:
                open_bins.setdefault(room - left * s, []).append((1, pattern | {s: left}))
                left, times = 0, times - 1
            if times:
                open_bins.setdefault(room, []).append((times, pattern))
    return [g for groups in open_bins.values() for g in groups]


def plan(count: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Arrays by (size, first rank): which bins the next ranks of a size go to, and where in them."""
    fixed, rest = dominance(count, capacity)
    rows, ranks, base = [], dict.fromkeys(count, 0), 0
    for times, pattern in fixed + best_fit(rest, capacity):
        at = 0
        for s, n in sorted(pattern.items(), reverse=True):
            rows.append((s, ranks[s], n, base, at))
            ranks[s] += times * n
            at += s * n
        base += times
    rows.sort()
    size, rank, per, first, offset = (np.array(c, "i8") for c in (zip(*rows, strict=True) if rows else ([],) * 5))
    return {"key": size << 40 | rank, "rank": rank, "per": per, "first": first, "offset": offset}


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task to (row, size), and the rank in it among rows of one size."""
    shard, seen = TaskContext.get().partitionId(), {}
    for b in batches:
        rank = []
        for s in b.column(1).to_pylist():
            rank.append(seen.get(s, 0))
            seen[s] = rank[-1] + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([shard] * b.num_rows, pa.int32()), pa.array(rank, pa.int64())], names=["row", "size", "shard", "rank"])


def pack(df: DataFrame, size_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """All columns and ``sequence_id``, ``offset``: each row's place in as few sequences as best fit finds.

    Rows are ranked within (task, size) in one pass and the result is written, so ranks stay as they are if
    a task runs again; counts by (task, size) make them global. A size of which there are very many is so
    split over all tasks. A null size or one under 1 gets null places; one over ``capacity`` is an error.
    Columns named like the two that are added are replaced."""
    names = others(df, "sequence_id", "offset")
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    size = F.col(f"`{size_col}`").cast("long")
    d = df.select(row.alias("row"), F.when(size >= 1, size).alias("size"))
    kind = d.schema["row"].dataType.simpleString()
    d = materialise(d.mapInArrow(_ranked, f"row {kind}, size long, shard int, rank long"), "pack")
    count = d.where("size is not null").groupBy("shard", "size").agg(F.count(F.lit(1)).alias("n"))
    base = count.select("shard", "size", (F.sum("n").over(Window.partitionBy("size").orderBy("shard")) - F.col("n")).alias("base"))
    hist = {r["size"]: r["n"] for r in count.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    if any(s > capacity for s in hist):
        raise ValueError(f"a size is over the capacity of {capacity}")
    p = plan(hist, capacity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = b.column("size").is_valid().to_numpy(zero_copy_only=False)
            s, r = (b.column(c).fill_null(0).to_numpy() for c in ("size", "rank"))
            seq, off = np.zeros(len(s), "i8"), np.zeros(len(s), "i8")
            if known.any():
                at = np.searchsorted(p["key"], s[known] << 40 | r[known], "right") - 1
                local = r[known] - p["rank"][at]
                seq[known] = p["first"][at] + local // p["per"][at]
                off[known] = p["offset"][at] + local % p["per"][at] * s[known]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(seq, pa.int64(), mask=~known), pa.array(off, pa.int64(), mask=~known)], names=["row", "sequence_id", "offset"])

    ranked = d.join(base, ["shard", "size"], "left").select("row", "size", (F.col("rank") + F.coalesce("base", F.lit(0).cast("long"))).alias("rank"))
    out = ranked.mapInArrow(place, f"row {kind}, sequence_id long, offset long")
    return out.select(*[F.col(f"row.`{c}`") for c in names], "sequence_id", "offset")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else a first one that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(at, capacity) for at in range(first, n, capacity)]


def pieces(df: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece of a document of at most ``capacity`` ids: ``doc_id``, ``piece``, ``start``, ``length``, ``ids``.

    Null texts are empty and hold ``end_id`` alone; null ids and repeated rows give pieces like any other."""
    small_batches(df.sparkSession)
    d = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = Encoder.of(tokenizer, spaced), np.array([end_id], "<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, ENCODED):
                part, rows = b.slice(at, ENCODED), []
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    rows += [(doc, k, a, n, ids[4 * a : 4 * (a + n)]) for k, (a, n) in enumerate(cut(len(ids) // 4, capacity))]
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), binary(list(c[4]))], names=["doc_id", "piece", "start", "length", "ids"])

    return d.mapInArrow(tidy(run), PIECE)


def packed_documents(docs: DataFrame) -> DataFrame:
    """Pieces of all documents by the byte-level tokeniser, end id 2, with digests and places."""
    p = pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return pack(p.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, each with its sequence and its place in it."""
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

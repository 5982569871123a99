"""Approximate nearest neighbours by cross-polytope hashing with multiprobe and exact reranking.

A pseudo-rotation is three rounds of random signs and a Walsh-Hadamard transform; a vector's hash is the
signed axis nearest to its rotated direction. A table's cell is a pair of such hashes. A query visits its cheapest
cells in each table; rows that it meets in at least ``HITS`` tables are candidates, whose distances are exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from twinlake.llm.common import materialise

#: Measured on random directions in 64 dimensions, the hardest case: README.
TABLES, PROBES, HITS, SEED = 80, 56, 2, 7
#: Best axes of each hash that probed pairs are made of.
AXES = 32
#: A query with fewer candidates of ``HITS`` hits takes those of one hit too.
ENOUGH = 100
#: Rows whose vectors a task holds at once for reranking.
BLOCK_ROWS = 4000
#: Rows of a part, within which a query's hits are counted at once.
PART_ROWS = 1_000_000
#: Dimensions up to which a pseudo-rotation is kept as one matrix.
DENSE = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, by butterflies; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(len(x), n)
        h *= 2
    return x / np.float32(np.sqrt(n))


class Tables:
    def __init__(self, dim: int, tables: int, seed: int):
        self.dim, self.tables = dim, tables
        self.size = max(2, 1 << (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 2, 3, self.size)).astype("f4")
        self.dense = None
        if self.size <= DENSE:
            unit = np.eye(self.size, dtype="f4")
            self.dense = [[self._rotated(unit, t, w) for w in (0, 1)] for t in range(tables)]

    def _rotated(self, y: np.ndarray, table: int, which: int) -> np.ndarray:
        for s in self.signs[table, which]:
            y = hadamard(y * s)
        return y

    def unit(self, x: np.ndarray) -> np.ndarray:
        """Directions, filled up with noughts to the size of the transform; scaled by the largest part first."""
        y = np.zeros((len(x), self.size), "f4")
        x = x / np.abs(x).max(1, keepdims=True)
        y[:, : self.dim] = x / np.linalg.norm(x, axis=1, keepdims=True)
        return y

    def rotated(self, unit: np.ndarray, table: int, which: int) -> np.ndarray:
        return unit @ self.dense[table][which] if self.dense else self._rotated(unit, table, which)

    def axis(self, unit: np.ndarray, table: int, which: int) -> np.ndarray:
        y = self.rotated(unit, table, which)
        at = np.abs(y).argmax(1)
        return np.where(y[np.arange(len(y)), at] >= 0, at, at + self.size)

    def cells(self, unit: np.ndarray, table: int) -> np.ndarray:
        """The cell of each row: a number for table and both axes."""
        return (table * 2 * self.size + self.axis(unit, table, 0)) * 2 * self.size + self.axis(unit, table, 1)

    def probes(self, unit: np.ndarray, table: int, n: int) -> np.ndarray:
        """The n cheapest cells of each row: by squared loss against its best axes."""
        cost, axes = [], []
        for which in (0, 1):
            y = self.rotated(unit, table, which)
            z = np.concatenate([y, -y], 1)
            m = min(AXES, z.shape[1])
            best = np.argpartition(-z, m - 1, axis=1)[:, :m]
            top = np.take_along_axis(z, best, 1)
            cost.append((top.max(1, keepdims=True) - top) ** 2)
            axes.append(best)
        both = (cost[0][:, :, None] + cost[1][:, None, :]).reshape(len(unit), -1)
        n, m = min(n, both.shape[1]), axes[1].shape[1]
        best = np.argpartition(both, n - 1, axis=1)[:, :n]
        first, second = np.take_along_axis(axes[0], best // m, 1), np.take_along_axis(axes[1], best % m, 1)
        return (table * 2 * self.size + first) * 2 * self.size + second


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int | None = None) -> tuple[DataFrame, int]:
    """(id, vec) of vectors that take part: not null, of the common length, all components finite, not zero.

    Components stay floats where they are floats."""
    kind = df.schema[vec_col].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<float>" if single else "array<double>").alias("vec")).where("id is not null and vec is not null")
    v = v.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    if dim is None:
        top = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = top.n if top else 1
    return v.where(F.size("vec") == dim), dim


def _closest(k: int, dim: int):
    """Of one block of rows: each query's k best among its candidates there; an empty list is all rows.

    ``vectors`` are the block's rows (with their ids) and the queries that have candidates in it (with none)."""

    def run(key, pairs: pa.Table, vectors: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if pairs.num_rows and vectors.num_rows:
            every = _matrix(vectors.column("vec").combine_chunks(), dim)
            node, query = (vectors.column(c).fill_null(0).to_numpy() for c in ("node", "query_id"))
            ids = vectors.column("ids").to_pylist()
            rows = np.array([i for i, x in enumerate(ids) if x is not None], "i8")
            of_query = {int(query[i]): i for i, x in enumerate(ids) if x is None}
            order = rows[np.argsort(node[rows])]
            lists = pairs.column("nodes").combine_chunks()
            for i, qid in enumerate(pairs.column("query_id").to_pylist()):
                own = lists[i].values.to_numpy() if len(lists[i]) else None
                at = order if own is None else order[np.searchsorted(node[order], own)]
                d = np.sqrt(((every[at] - every[of_query[qid]]) ** 2).sum(1))
                if len(d) > k + 1:  # one more, for the query's own row
                    near = d <= np.partition(d, k)[k]
                    d, at = d[near], at[near]
                each = sorted((s, v) for s, r in zip(d.tolist(), at.tolist(), strict=True) for v in ids[r] if v != qid)[:k]
                found += [(qid, v, s) for s, v in each]
        c = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table({"query_id": pa.array(c[0], pa.int64()), "vec_id": pa.array(c[1], pa.int64()), "score": pa.array(c[2], pa.float64())})

    return run


def candidates(held: DataFrame, asked: DataFrame, t: Tables, probes: int, hits: int, enough: int, blocks: int) -> DataFrame:
    """(block, query_id, nodes): rows that a query meets in ``hits`` tables, or in one where it has fewer than ``enough`` such rows.

    A cell is one row a part of all rows, with its rows as a list, so what meets is a row a cell that a query visits;
    hits are counted a query and part at a time. Rows of a block, ``node`` modulo ``blocks``, are one list."""
    dim = t.dim

    def index(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                u = t.unit(_matrix(part.column("vec"), dim))
                cell = np.stack([t.cells(u, n) for n in range(t.tables)], 1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.reshape(-1), pa.int64()), pa.array(np.repeat(part.column("node").to_numpy(), t.tables), pa.int64())], names=["cell", "node"])

    def probe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                u = t.unit(_matrix(part.column("vec"), dim))
                cell = np.concatenate([t.probes(u, n, probes) for n in range(t.tables)], 1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.reshape(-1), pa.int64()), pa.array(np.repeat(part.column("id").to_numpy(), cell.shape[1]), pa.int64())], names=["cell", "query_id"])

    def count(key, rows):
        """Of one query and part: its candidates, a row a block of rows."""
        node, n = np.unique(rows.column("nodes").combine_chunks().flatten().to_numpy(), return_counts=True)
        some = node[n >= hits]
        some = node if len(some) < -(-enough // parts) else some
        block = some % blocks
        order = np.argsort(block, kind="stable")
        block, some = block[order], some[order]
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(some) else np.zeros(0, "i8")
        nodes = pa.ListArray.from_arrays(pa.array([*starts, len(some)], pa.int32()), pa.array(some, pa.int64()))
        return pa.table({"block": pa.array(block[starts], pa.int64()), "query_id": pa.array([key[0].as_py()] * len(starts), pa.int64()), "nodes": nodes})

    parts = max(1, -(-blocks * BLOCK_ROWS // PART_ROWS))
    rows = held.select("node", "vec").mapInArrow(index, "cell long, node long")
    cells = rows.groupBy("cell", F.pmod(F.xxhash64("node"), F.lit(parts)).alias("part")).agg(F.collect_list("node").alias("nodes"))
    # a query is thousands of probes, which the planner does not know: without the hint it takes them for a small side
    probed = asked.mapInArrow(probe, "cell long, query_id long").hint("merge")
    met = cells.join(probed, "cell").select("query_id", "part", "nodes")
    return materialise(met.groupBy("query_id", "part").applyInArrow(count, "block long, query_id long, nodes array<long>"), "ann-met")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, probes: int = PROBES, hits: int = HITS, enough: int = ENOUGH, seed: int = SEED) -> DataFrame:
    """Per query its ``k`` nearest rows found: ``query_id``, ``rank``, ``vec_id``, ``score`` (Euclidean distance).

    A query's own id is no candidate; ties go to the smaller id. Vectors that are null, zero, of another
    length than most, or hold null or non-finite components take no part, nor do null ids. Equal vectors
    are one row of the index that carries their k + 1 smallest ids, which are all that can be asked for;
    an id that comes twice counts once. The index is (cell, row); vectors are joined once, for the candidates, by
    blocks of rows. A query that finds under ``k`` is held against all rows, which is exact."""
    v, dim = usable(rows, id_col, vec_col)
    q, _ = usable(queries, id_col, vec_col, dim)
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    held = v.dropDuplicates(["id", "vec"]).withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    held = materialise(held.withColumn("node", F.monotonically_increasing_id()), "ann-rows")
    asked = materialise(q.dropDuplicates(["id"]), "ann-queries")
    blocks = max(1, -(-held.count() // BLOCK_ROWS))
    block = F.pmod(F.col("node"), F.lit(blocks))
    vectors = held.select(block.alias("block"), "node", F.lit(None).cast("long").alias("query_id"), "ids", "vec")

    def reranked(pairs: DataFrame) -> DataFrame:
        """The k nearest of (block, query_id, nodes); no nodes are all rows of the block."""
        own = pairs.select("block", "query_id").distinct().join(asked.select(F.col("id").alias("query_id"), "vec"), "query_id")
        own = own.select("block", F.lit(None).cast("long").alias("node"), "query_id", F.lit(None).cast("array<long>").alias("ids"), "vec")
        both = vectors.unionByName(own)
        got = pairs.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(_closest(k, dim), "query_id long, vec_id long, score double")
        got = got.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return got.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)

    cols = ["query_id", "rank", "vec_id", "score"]
    met = candidates(held, asked, Tables(dim, tables, seed), probes, hits, enough, blocks)
    found = materialise(reranked(met).select(cols), "ann-found")
    full = found.groupBy("query_id").count().where(F.col("count") >= k)
    short = materialise(asked.join(full, asked.id == full.query_id, "left_anti").select(F.col("id").alias("query_id")), "ann-short")
    if not short.limit(1).count():
        return found
    again = reranked(short.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "query_id", F.array().cast("array<long>").alias("nodes")))
    return found.join(short, "query_id", "left_anti").select(cols).unionByName(again.select(cols))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every row whose id is divisible by 100."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(e, e.where("vec_id % 100 = 0"))

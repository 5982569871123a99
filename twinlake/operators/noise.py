"""Model noise put into ensembles, and rotations of ensembles, as jobs on the long table (ens, n, i, x).

What acts between members is a table (ens, n, m, w) of one ensemble, made from sums over the state and applied by a join.
Draws are keyed by row, so they are the same in any task, order or retry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlake.functions.ensemble import KEY, anomalies
from twinlake.operators.ensemble_space import MAPS, centred, combined, grams, mapped, sides, state_grams, states, symmetric, together

#: Share of a member's directions under which a truncated inverse leaves them out.
RANK = 1e-10


def products(a: DataFrame, b: DataFrame, scale: Column | None = None) -> DataFrame:
    """(ens, n, m, g): sums over the state of products of ``a`` (ens, n, i, a) and ``b`` (ens, m, i, b), each times ``scale`` (over i)."""
    p = F.col("a") * F.col("b")
    return a.join(b, KEY).groupBy("ens", "n", "m").agg(F.sum(p if scale is None else p * scale).alias("g"))


def small(g: DataFrame, run: Callable[[dict[str, np.ndarray]], np.ndarray], *names: str) -> DataFrame:
    """(ens, n, m, w): ``run`` of an ensemble's matrices ``names`` (columns of ``g`` by n and m), a group of members squared."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        own = {c: pdf.pivot(index="n", columns="m", values=c) for c in names}
        one = own[names[0]]
        w = pd.DataFrame(run({c: x.to_numpy() for c, x in own.items()}), index=one.index, columns=one.columns)
        return w.stack().rename("w").reset_index().assign(ens=pdf["ens"].iat[0])[["ens", "n", "m", "w"]]

    return g.groupBy("ens").applyInPandas(each, "ens long, n long, m long, w double")


def applied(w: DataFrame, a: DataFrame, name: str) -> DataFrame:
    """(ens, n, i, name): a table between members times anomalies (ens, m, i, b)."""
    return w.join(a, ["ens", "m"]).groupBy("ens", "n", "i").agg(F.sum(F.col("w") * F.col("b")).alias(name))


def pseudo_inverse(g: np.ndarray) -> np.ndarray:
    s, v = np.linalg.eigh((g + g.T) / 2)
    keep = s > RANK * max(s.max(), 1e-300)
    return v * np.where(keep, 1 / np.where(keep, s, 1.0), 0.0) @ v.T


def _root(dt: float):
    def run(of: dict[str, np.ndarray]) -> np.ndarray:
        inv = pseudo_inverse(of["g"])
        s, v = np.linalg.eigh(np.eye(len(inv)) + dt * (len(inv) - 1) * inv @ of["q"] @ inv)
        return v * np.sqrt(np.maximum(s, 0)) @ v.T

    return run


def square_root_noise(e: DataFrame, q: Column, dt: float = 1.0) -> DataFrame:
    """(ens, n, i, x, mu, t, ratio): anomalies ``t`` transformed so that the covariance grows by the part of the noise (variance ``q``
    over i, times ``dt``) that lies in the ensemble's span; ``ratio`` is the total variance wanted over that reached.

    By members, or by variables where members are more."""
    tall, wide = sides(e)
    parts = []
    if tall is not None:
        v = states(tall)
        g = state_grams(v).withColumn("q", q.cast("double"))
        r = g.groupBy("ens").applyInPandas(lambda pdf: _root_by_state(pdf, dt), MAPS + ", ratio double")
        parts.append(mapped(v, r, "ratio").select("ens", "n", "i", (F.col("mu") + F.col("t")).alias("x"), "mu", "t", "ratio"))
    if wide is not None:
        parts.append(_root_by_members(wide, q, dt))
    return together(parts)


def _root_by_state(pdf: pd.DataFrame, dt: float) -> pd.DataFrame:
    """With A = U S V', anomalies go to A (I + V S^-1 (M - I) S V'), M being the root of I + dt N1 S^-1 V' q V S^-1."""
    at, g = symmetric(pdf)
    q = pdf.drop_duplicates("i").set_index("i")["q"].reindex(at).to_numpy()
    n1 = int(pdf["n"].max()) - 1
    s2, v = np.linalg.eigh(g)
    keep = s2 > RANK * max(s2.max(), 1e-300)
    s, v = np.sqrt(s2[keep]), v[:, keep]
    lam, u = np.linalg.eigh(np.eye(len(s)) + dt * n1 * (v.T * q @ v) / np.outer(s, s))
    root = u * np.sqrt(np.maximum(lam, 0)) @ u.T
    m = np.eye(len(at)) + v / s @ (root - np.eye(len(s))) * s @ v.T
    reached = np.trace(m.T @ g @ m)
    ratio = (np.trace(g) + dt * n1 * q.sum()) / reached if reached > 0 else np.nan
    return pd.DataFrame({"ens": [pdf["ens"].iat[0]], "at": [at.tolist()], "rt": [m.T.tolist()], "more": [[0.0] * len(at)], "ratio": [ratio]})


def _root_by_members(a: DataFrame, q: Column, dt: float) -> DataFrame:
    a = a.select("ens", "n", "i", "x", "a", "mu")
    b = a.select("ens", F.col("n").alias("m"), "i", F.col("a").alias("b"))
    g = a.join(b, KEY).groupBy("ens", "n", "m").agg(F.sum(F.col("a") * F.col("b")).alias("g"), F.sum(F.col("a") * F.col("b") * q).alias("q"))
    moved = applied(small(g, _root(dt), "g", "q"), b, "t")
    out = a.join(moved, ["ens", "n", "i"])
    size = F.count_distinct("n") - 1
    total = out.groupBy("ens").agg((F.sum(F.col("a") ** 2) / size).alias("v0"), (F.sum(F.col("t") ** 2) / size).alias("v1"), (dt * F.sum(q) / F.count_distinct("n")).alias("vq"))
    return out.join(total, "ens").select("ens", "n", "i", (F.col("mu") + F.col("t")).alias("x"), "mu", "t", ((F.col("v0") + F.col("vq")) / F.col("v1")).alias("ratio"))


def complement(e: DataFrame, q: Column, draw: Column) -> DataFrame:
    """(ens, n, i, z): draws (``draw`` over ens, n and i) of variance ``q`` without their part in the ensemble's span."""
    a = anomalies(e).withColumn("z", F.sqrt(q) * draw)
    b = a.select("ens", F.col("n").alias("m"), "i", F.col("a").alias("b"))
    g = a.join(b, KEY).groupBy("ens", "n", "m").agg(F.sum(F.col("a") * F.col("b")).alias("g"), F.sum(F.col("z") * F.col("b")).alias("c"))
    w = small(g, lambda of: of["c"] @ pseudo_inverse(of["g"]), "g", "c")
    return a.join(applied(w, b, "in"), ["ens", "n", "i"]).select("ens", "n", "i", (F.col("z") - F.col("in")).alias("z"))


def add_noise(e: DataFrame, q: Column, method: str, dt: float = 1.0, draw: Column | None = None) -> DataFrame:
    """(ens, n, i, x): noise of variance ``q`` (over i) times ``dt``, by a named treatment.

    ``none``; ``Stoch`` (a draw a row); ``Mult-1`` and ``Mult-M`` (anomalies stretched to the total variance, or each variable to
    its own); ``Sqrt-Core`` (the ensemble's span gets its part of the noise by a symmetric transform); ``Sqrt-Mult-1`` (then
    stretched to the total variance); ``Sqrt-Add-Z`` (then draws outside the span). ``draw`` is a standard draw over ens, n, i."""
    if method == "none":
        return e.select("ens", "n", "i", "x")
    if method in ("Stoch", "Sqrt-Add-Z") and draw is None:
        raise ValueError(f"{method} needs draws")
    if method == "Stoch":
        return e.select("ens", "n", "i", (F.col("x") + F.sqrt(dt * q) * draw).alias("x"))
    if method in ("Mult-1", "Mult-M"):
        a = anomalies(e)
        v = a.groupBy(*KEY).agg((F.sum(F.col("a") ** 2) / (F.count(F.lit(1)) - 1)).alias("v"))
        one = v.groupBy("ens").agg(F.sqrt(1 + dt * F.sum(q) / F.sum("v")).alias("f"))
        f = one if method == "Mult-1" else v.select(*KEY, F.sqrt(1 + dt * q / F.col("v")).alias("f"))
        return a.join(f, "ens" if method == "Mult-1" else KEY).select("ens", "n", "i", (F.col("mu") + F.col("f") * F.col("a")).alias("x"))
    if method not in ("Sqrt-Core", "Sqrt-Mult-1", "Sqrt-Add-Z"):
        raise ValueError(f"no such treatment: {method}")
    out = square_root_noise(e, q, dt)
    if method == "Sqrt-Mult-1":
        return out.select("ens", "n", "i", (F.col("mu") + F.sqrt("ratio") * F.col("t")).alias("x"))
    if method == "Sqrt-Add-Z":
        return out.join(complement(e, q, draw), ["ens", "n", "i"]).select("ens", "n", "i", (F.col("x") + np.sqrt(dt) * F.col("z")).alias("x"))
    return out.select("ens", "n", "i", "x")


def rotated(e: DataFrame, draws: list[Column]) -> DataFrame:
    """(ens, n, i, x): the ensemble turned at random in its own space; mean and covariance stay.

    Each of ``draws`` (a number a member, over ens and n) gives one mirror: its centred, scaled draws v, I - 2 v v'. All mirrors
    act through one table of sums. As many draws as members less one reach every rotation or mirror image."""
    u = e.select("ens", "n").distinct().select("ens", "n", F.array(*[d.cast("double") for d in draws], F.lit(1.0)).alias("u"), F.array().cast("array<double>").alias("d"))
    size = len(draws) + 1

    def solve(g: np.ndarray, d: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
        k = np.zeros(g.shape)
        for j in range(size - 1):
            v = centred(g, j)
            length = v @ g @ v
            if length > 0:
                k += np.outer(v + k @ (g @ v), -2 / length * v)
        return np.zeros(size), k

    return combined(e, u, grams(u, size), size, solve)


#: Members, and repeats, of a block of ``jittered_rows``.
BLOCK, ROWS = 1024, 256


def jittered_rows(drawn: DataFrame, source: DataFrame, draw: Callable[[Column], Column], rank_scale: bool = True) -> DataFrame:
    """(ens, n, copy, i, x, chi2): resampled rows in several dimensions (``drawn``: ens, n, copy, again) with jitter on repeats.

    ``source`` (ens, m, i, c) is a colouring whose products summed over m are the covariance; a repeat moves by the sum over m of a
    standard draw (``draw`` of the member m, keyed by ens, n, copy) times ``c``. ``chi2`` is the draws' squares summed, brought to
    the state's dimensions where members are more (``rank_scale``); null where nothing moves.

    There is a draw a repeat and member, so the draws grow with the square of an ensemble; they are made where they are summed,
    a block of members at a time, and only a row of sums a repeat and block is sent on."""
    key = ["ens", "n", "copy"]

    def blocks(d: DataFrame, order: list[str], size: int, name: str) -> DataFrame:
        return d.withColumn(name, F.floor((F.row_number().over(Window.partitionBy("ens").orderBy(*order)) - 1) / size))

    c = source.groupBy("ens", "m").agg(F.collect_list(F.struct("i", "c")).alias("v"))
    c = blocks(c, ["m"], BLOCK, "mb").groupBy("ens", "mb").agg(F.collect_list(F.struct("m", "v")).alias("block"))
    many = source.groupBy("ens").agg(F.count_distinct("m").alias("members"), F.count_distinct("i").alias("dims"))
    again = blocks(drawn.where("again").select(*key).distinct(), ["n", "copy"], ROWS, "nb")
    again = again.groupBy("ens", "nb").agg(F.collect_list(F.struct("n", "copy")).alias("rows")).join(many, "ens")
    again = again.select("ens", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("members") - 1) / BLOCK))).alias("mb"))
    j = again.join(c, ["ens", "mb"])
    # the block's colouring goes ahead of its repeats, once
    none = F.lit(None).cast("long")
    head = F.array(F.struct(none.alias("n"), none.alias("copy"), F.col("block").getField("v").alias("v")))
    tail = F.transform("rows", lambda r: F.struct(r["n"].cast("long").alias("n"), r["copy"].cast("long").alias("copy"), F.lit(None).cast(source_type(source)).alias("v")))
    j = j.select("ens", F.col("block").getField("m").alias("ms"), F.explode(F.concat(head, tail)).alias("r")).select("ens", "ms", "r.n", "r.copy", "r.v")
    j = j.select("ens", "n", "copy", "v", F.when(F.col("n").isNotNull(), F.transform("ms", lambda m: draw(m).cast("double"))).alias("d"))
    part = j.mapInArrow(_block_sums, "ens long, n long, copy long, i array<long>, move array<double>, chi2 double")
    part = part.repartition(*key)
    chi = part.select(*key, "chi2", F.explode(F.arrays_zip("i", "move")).alias("p")).groupBy(*key, F.col("p.i").alias("i")).agg(F.sum("p.move").alias("move"), F.sum("chi2").alias("chi2"))
    moves = chi.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("i", "move"))).alias("move"), F.first("chi2").alias("chi2")).join(many, "ens")
    share = F.least(F.col("dims") / F.col("members"), F.lit(1.0)) if rank_scale else F.lit(1.0)
    moves = moves.select(*key, "move", (F.col("chi2") * share).alias("chi2"))
    return drawn.join(moves, key, "left").select(*key, "i", (F.col("x") + F.coalesce(F.try_element_at("move", F.col("i")), F.lit(0.0))).alias("x"), "chi2")


def source_type(source: DataFrame) -> str:
    kinds = dict(source.dtypes)
    return f"array<array<struct<i:{kinds['i']},c:{kinds['c']}>>>"


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Draws of repeats times the colouring (rows v) that came ahead of them."""
    at = c = None
    for b in batches:
        heads = np.flatnonzero(b["n"].is_null().to_numpy(zero_copy_only=False))
        starts = np.union1d([0], heads).astype(int)
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(b)], strict=True):
            if hi > lo and b["v"][lo].is_valid:
                at, c = _matrix(b["v"].slice(lo, 1).flatten())
                lo += 1
            if hi == lo:
                continue
            d = b["d"].slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
            move = d @ c
            offsets = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * len(at))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (np.tile(at, hi - lo), move.ravel())]
            yield pa.RecordBatch.from_arrays([*[b[k].slice(lo, hi - lo) for k in ("ens", "n", "copy")], *lists, pa.array((d * d).sum(1))], ["ens", "n", "copy", "i", "move", "chi2"])


def _matrix(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The indices and the colouring (members, indices) of a list a member."""
    rows, flat = np.repeat(np.arange(len(v)), np.asarray(v.value_lengths())), v.flatten()
    at, where = np.unique(flat.field("i").to_numpy(zero_copy_only=False), return_inverse=True)
    c = np.zeros((len(v), len(at)))
    c[rows, where] = flat.field("c").to_numpy(zero_copy_only=False)
    return at, c

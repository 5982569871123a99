"""Localization: distances, tapers, batches, local observations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Radius factors of the tapers.
FACTORS = {"Gauss": 1.0, "Exp": 1.0, "Cubic": 1.87, "Quadro": 1.64, "GC": 1.82, "Step": 1.0}
CUTOFF = 1e-3
#: Partitions to a core that pairs are made in, at least.
PARTS = 4


def distance(a: list[Column], b: list[Column], period: list[float] | None = None) -> Column:
    """Euclidean distance; in a periodic dimension the shorter way round."""
    total = F.lit(0.0)
    for k, (p, q) in enumerate(zip(a, b, strict=True)):
        d = F.abs(p - q)
        if period:
            d = F.least(d, period[k] - d)
        if len(a) == 1:
            return d
        total = total + d * d
    return F.sqrt(total)


def taper(d: Column, radius: float, kind: str = "GC") -> Column:
    """Weight of an observation at distance ``d``. Plain arithmetic: it is worked out for every pair, in generated code."""
    return _TAPERS[kind](d / (radius * FACTORS[kind]))


def _bell(p: int):
    def power(x: Column) -> Column:
        return x * x * x if p == 3 else (x * x) * (x * x)

    return lambda r: F.when(r <= 1, power(1 - power(r))).otherwise(0.0)


def _quintic(r: Column) -> Column:
    """Gaspari and Cohn's piecewise quintic, by Horner's rule."""
    near = 1 + r * r * (-5 / 3 + r * (5 / 8 + r * (0.5 - 0.25 * r)))
    far = 4 - 2 / (3 * r) + r * (-5 + r * (5 / 3 + r * (5 / 8 + r * (r / 12 - 0.5))))
    return F.when(r <= 1, near).when(r <= 2, far).otherwise(0.0)


_TAPERS = {
    "Gauss": lambda r: F.exp(-0.5 * r * r),
    "Exp": lambda r: F.exp(-0.5 * r * r * r),
    "Step": lambda r: F.when(r <= 1, 1.0).otherwise(0.0),
    "Cubic": _bell(3),
    "Quadro": _bell(4),
    "GC": _quintic,
}


def _shifted(at, k: int):
    return lambda x: at(k, x)


def near_points(points: DataFrame, sites: DataFrame, dims: int, cell: float, reach: float, period: list[float] | None = None) -> DataFrame:
    """(p, s, dist): points and sites (id, pos) within ``reach``, ``pos`` being an array of ``dims`` numbers; never all by all.

    Both sides are dealt to grid cells at least ``cell`` wide, and each site, of which there should be fewer, goes to the cells
    that ``reach`` touches. A cell's pairs are many more than its rows, so cells are dealt to more partitions than the size of
    the rows asks for. With ``period``, a length a dimension, space is periodic and positions lie in [0, period)."""
    count = [max(1, int(w // cell)) for w in period] if period else [None] * dims
    width = [w / n for w, n in zip(period, count, strict=True)] if period else [cell] * dims
    every, cells = range(dims), [f"c{k}" for k in range(dims)]

    def at(k: int, shift: Column) -> Column:
        c = (F.floor(F.get("pos", F.lit(k)) / width[k]) + shift).cast("long")
        return F.pmod(c, F.lit(count[k])) if period else c

    spread = max(PARTS * points.sparkSession.sparkContext.defaultParallelism, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    p = points.select(F.col("id").alias("p"), *[F.get("pos", F.lit(k)).alias(f"p{k}") for k in every], *[at(k, F.lit(0)).alias(f"c{k}") for k in every])
    s = sites.select(F.col("id").alias("s"), "pos")
    for k in every:
        steps = int(-(-reach // width[k]))
        steps = min(steps, count[k]) if period else steps
        s = s.withColumn(f"c{k}", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(-steps), F.lit(steps)), _shifted(at, k)))))
    s = s.select("s", *[F.get("pos", F.lit(k)).alias(f"s{k}") for k in every], *cells)
    j = p.repartition(spread, *cells).join(s.repartition(spread, *cells), cells)
    d = distance([F.col(f"p{k}") for k in every], [F.col(f"s{k}") for k in every], period)
    near = j.select("p", "s", d.alias("dist")).where(F.col("dist") <= reach)
    # an array of one keeps Spark from putting the root and squares in the place of every mention of a distance further on
    return near if dims == 1 else near.select("p", "s", F.explode(F.array("dist")).alias("dist"))


def near_pairs(points: DataFrame, sites: DataFrame, cell: float, reach: float, period: float) -> DataFrame:
    """``near_points`` on a ring: positions are plain numbers in [0, period)."""
    one = lambda d: d.select("id", F.array("pos").alias("pos"))
    return near_points(one(points), one(sites), 1, cell, reach, [period])


#: Cells of a ring for ``near_sums``.
CELLS = 40_000


def near_sums(points: DataFrame, sites: DataFrame, reach: float, period: float, cells: int = CELLS) -> DataFrame:
    """(batch, s, n, total): for each site (id, pos) of a ring the points (batch, pos) within ``reach`` by batch: how many, and
    their distances' sum. Positions are numbers in [0, period).

    Points are summed by batch and cell. Of cells that lie wholly on one side of a site and within its reach only running sums
    are taken; the points of the seven cells about the site and the ends of its reach are met one by one."""
    w = period / cells
    far = int(reach // w)
    if far < 4 or 2 * far + 4 > cells:
        raise ValueError("reach is too small or too large for so many cells")
    at = lambda c: F.least(F.floor(c / w), F.lit(cells - 1)).cast("long")
    p = points.select("batch", "pos", at(F.col("pos")).alias("cell"))
    s = sites.select(F.col("id").alias("s"), F.col("pos").alias("to"), at(F.col("pos")).alias("cell"))
    own = p.groupBy("batch", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("sum"))
    round_ = own.select("batch", "n", "sum", "cell", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)])).alias("turn"))
    round_ = round_.select("batch", (F.col("cell") + F.col("turn") * cells).alias("cell"), "n", (F.col("sum") + F.col("turn") * period * F.col("n")).alias("sum"))
    grid = own.select("batch").distinct().withColumn("cell", F.explode(F.sequence(F.lit(-far).cast("long"), F.lit(cells + far).cast("long"))))
    line = Window.partitionBy("batch").orderBy("cell")
    d = grid.join(round_, ["batch", "cell"], "left")
    upto = {c: F.sum(F.coalesce(c, F.lit(0))).over(line.rowsBetween(Window.unboundedPreceding, 0)) for c in ("n", "sum")}
    d = d.select("batch", "cell", *[c.alias(n) for n, c in upto.items()])
    ahead = {f"a{c}": F.lead(c, far - 2).over(line) - F.col(c) for c in ("n", "sum")}
    behind = {f"b{c}": F.lag(c, 1).over(line) - F.lag(c, far - 1).over(line) for c in ("n", "sum")}
    d = d.select("batch", "cell", *[c.alias(n) for n, c in (ahead | behind).items()]).where(F.col("cell").between(0, cells - 1) & (F.col("an") + F.col("bn") > 0))
    inner = s.join(d, "cell").select("batch", "s", (F.col("an") + F.col("bn")).alias("n"), (F.col("asum") - F.col("bsum") + (F.col("bn") - F.col("an")) * F.col("to")).alias("total"))
    edges = F.array(*[F.lit(k) for k in (-far - 1, -far, 1 - far, 0, far - 1, far, far + 1)])
    e = s.select("s", "to", F.explode(edges).alias("k"), "cell").select("s", "to", F.pmod(F.col("cell") + F.col("k"), F.lit(cells)).alias("cell"))
    dist = distance([F.col("pos")], [F.col("to")], [period])
    edge = p.join(e, "cell").select("batch", "s", dist.alias("dist")).where(F.col("dist") <= reach)
    edge = edge.groupBy("batch", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("dist").alias("total"))
    return inner.unionByName(edge).groupBy("batch", "s").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def no_localization(sites: DataFrame) -> DataFrame:
    """(batch, s, coeff): the whole state is one batch, which every site informs with weight one."""
    return sites.select(F.lit(0).cast("long").alias("batch"), "s", F.lit(1.0).alias("coeff"))


def local_observations(pairs: DataFrame, radius: float, kind: str = "GC", cutoff: float = CUTOFF, reach: float | None = None) -> DataFrame:
    """(p, s, coeff) above the cutoff. Weights fall with distance: where those of pairs within ``reach`` (if told) cannot come
    down to the cutoff, they are not held against it."""
    d = pairs.select("p", "s", taper(F.col("dist"), radius, kind).alias("coeff"))
    power = {"Gauss": 2, "Exp": 3}.get(kind)
    if reach is not None and power and 0 < cutoff < 1 and reach < 0.999 * radius * FACTORS[kind] * (-2 * math.log(cutoff)) ** (1 / power):
        return d
    return d.where(F.col("coeff") > cutoff)


def felt(radius: float, kind: str) -> float:
    """The distance beyond which a taper is nought, if there is one."""
    return {"GC": 2.0, "Gauss": math.inf, "Exp": math.inf}.get(kind, 1.0) * radius * FACTORS[kind]


def batches(df: DataFrame, index: str, size: int, parts: int) -> DataFrame:
    """Adds ``batch``: the range [0, size) cut in ``parts``, the first size mod parts one longer."""
    big, base = size % parts, size // parts
    i = F.col(index)
    return df.withColumn("batch", F.when(i < big * (base + 1), F.floor(i / (base + 1))).otherwise(F.lit(big) + F.floor((i - big * (base + 1)) / base)).cast("long"))


def direct_localization(points: DataFrame, shape: list[int], seen: Column, radius: float, kind: str = "GC") -> DataFrame:
    """(p, s, coeff) of ``points`` (i) of a periodic grid numbered row by row, of which those are observed for which ``seen`` (over ``i``) holds."""
    place, rest = [], F.col("i")
    for n in reversed(shape):
        place.insert(0, (rest % n).cast("double"))
        rest = F.floor(rest / n)
    g = points.select("i").select("i", F.col("i").alias("id"), F.array(*place).alias("pos"))
    reach = 2 * radius * FACTORS[kind] if kind == "GC" else radius * FACTORS[kind] * (4 if kind in ("Gauss", "Exp") else 1)
    return local_observations(near_points(g.select("id", "pos"), g.where(seen).select("id", "pos"), len(shape), max(1.0, reach), reach, [float(n) for n in shape]), radius, kind)

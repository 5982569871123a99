"""Algebra of experiment tables: grids, classification of columns, select, nest, mean, tune, pivot.

A coordinate may be null and nulls compare equal; a missing statistic is NaN and goes through means."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def grid(spark: SparkSession, method: str, accepts: dict[str, list], fixed: dict | None = None) -> DataFrame:
    """Every combination of the parameters' values, with ``da_method`` and fixed columns; the lists are the caller's."""
    d = spark.range(1).select(F.lit(method).alias("da_method"))
    for name, values in accepts.items():
        d = d.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    for name, value in (fixed or {}).items():
        d = d.withColumn(name, F.lit(value))
    return d


def combined(xps: DataFrame, by: list[str], params: list[str], fixed: dict | None = None) -> DataFrame:
    """For each coordinate of ``by`` every combination of the values that ``params`` have there (nulls left out), and fixed columns.

    Parameters have few values each; their combinations are spelled out where the lists are, without a join."""
    d = xps.groupBy(by).agg(*[F.collect_set(c).alias(c) for c in params])
    for c in params:
        d = d.withColumn(c, F.explode(c))
    return d.withColumns({k: F.lit(v) for k, v in (fixed or {}).items()})


def union_unique(*tables: DataFrame) -> DataFrame:
    """All rows once, columns matched by name and null where a table lacks them."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).dropDuplicates()


def classify(xps: DataFrame, columns: list[str], nomerge: tuple[str, ...] = ()) -> DataFrame:
    """(column, kind): common (one value in all rows), redundant (one value or null), distinct. One pass."""
    seen = xps.agg(F.count(F.lit(1)).alias("_all"), *[x for c in columns for x in (F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(f"{c}_one"), F.count(c).alias(f"{c}_n"))])
    kind = lambda c: F.when(F.lit(c in nomerge), "distinct").when(~F.col(f"{c}_one"), "distinct").when(F.col(f"{c}_n") == F.col("_all"), "common").otherwise("redundant")
    return seen.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), kind(c).alias("kind")) for c in columns])).alias("x")).select("x.*")


def matching(xps: DataFrame, strict: bool = True, **values) -> DataFrame:
    """Rows at the given coordinates; a missing one matches only if not ``strict``."""
    for name, v in values.items():
        same = F.col(name).eqNullSafe(F.lit(v))
        xps = xps.where(same if strict else same | F.col(name).isNull())
    return xps


def subspace(xps: DataFrame, **values) -> DataFrame:
    """Rows at the coordinates, without their columns."""
    return matching(xps, **values).drop(*values)


def nest(xps: DataFrame, outer: list[str], inner: list[str]) -> DataFrame:
    """(outer coordinates, inner coordinates, size, cells): a row an inner coordinate of each outer one, how many experiments
    are there, and how many coordinates the outer one has.

    A nested space is these rows: none is held as one value, so an outer coordinate may have any number of inner ones."""
    cells = xps.groupBy(*outer, *inner).agg(F.count(F.lit(1)).alias("size"))
    many = cells.groupBy(outer).agg(F.count(F.lit(1)).alias("cells"))
    same = reduce(lambda a, b: a & b, [F.col(f"c.{c}").eqNullSafe(F.col(f"m.{c}")) for c in outer], F.lit(True))
    return cells.alias("c").join(many.alias("m"), same).select(*[f"c.{c}" for c in (*outer, *inner)], "size", "cells")


def unnested(nested: DataFrame, outer: list[str], inner: list[str], **at) -> DataFrame:
    """The inner space at one outer coordinate."""
    return matching(nested, **{c: at[c] for c in outer}).select(*inner, "size")


def mean_over(xps: DataFrame, keep: list[str], value: str = "val") -> DataFrame:
    """Mean over all other dimensions: ``val``, its standard error ``prec``, runs, failures and successes."""
    v = F.col(value)
    ok = F.sum((~F.isnan(v)).cast("long"))
    n = F.count(F.lit(1))
    return xps.groupBy(keep).agg(F.avg(v).alias("val"), F.sqrt(F.var_samp(v) / n).alias("prec"), n.alias("n_total"), (n - ok).alias("n_fail"), ok.alias("n_success"))


def tune(xps: DataFrame, keep: list[str], over: list[str], value: str = "val", decreasing: bool = True, order: str = "seq", cost: Callable[[Column], Column] | None = None) -> DataFrame:
    """The best row per kept coordinate; of equals the last, NaN never, and nulls if there is no other.

    Best is the least value (the greatest if not ``decreasing``), or that of the least ``cost``, a function of the value's
    column. An aggregate: no more than one row a coordinate moves from a task."""
    c = cost(F.col(value)) if cost else F.col(value) if decreasing else -F.col(value)
    none = F.isnan(value) | F.col(value).isNull() | F.isnan(c) | c.isNull()
    place = F.struct((~none).alias("some"), F.when(~none, -c).alias("gain"), F.col(order).alias("last"))
    best = xps.groupBy(keep).agg(F.max_by(F.struct(*over, value, none.alias("_none")), place).alias("b"))
    return best.select(*keep, *[F.when(~F.col("b._none"), F.col(f"b.{c}")).alias(c) for c in over], F.col(f"b.{value}").alias(value))


def table(xps: DataFrame, rows: list[str], across: str, labels: list, value: str = "val") -> DataFrame:
    """One row per coordinate of ``rows``, a column per label of ``across``; the labels are given, so no extra pass."""
    return xps.groupBy(rows).pivot(across, labels).agg(F.first(value))


def with_section(xps: DataFrame, label: str, where: Column, null: list[str]) -> DataFrame:
    """The rows, and those of a cross-section once more under ``label`` with some coordinates nulled."""
    base = xps.withColumn("section", F.lit(None).cast("string"))
    more = xps.where(where).withColumn("section", F.lit(label))
    for c in null:
        more = more.withColumn(c, F.lit(None).cast(xps.schema[c].dataType))
    return base.unionByName(more)


def ticks(xps: DataFrame, dim: str) -> DataFrame:
    """The dimension's values in order, null last, with their place."""
    d = xps.select(F.col(dim).alias("tick")).distinct()
    return d.withColumn("place", F.row_number().over(Window.orderBy(F.col("tick").asc_nulls_last())).cast("long"))


def names(xps: DataFrame, distinct: list[str]) -> DataFrame:
    """Adds ``name``: the method and each distinct parameter that is set, shortened to six letters."""
    part = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c[:6]}:"), F.col(c).cast("string")))
    return xps.withColumn("name", F.concat_ws(" ", "da_method", *[part(c) for c in distinct]))


def squeezed(xps: DataFrame, dims: list[str]) -> DataFrame:
    """Without the dimensions that have one value only."""
    kinds = {r["column"]: r["kind"] for r in classify(xps, dims).collect()}  # a row a dimension
    return xps.drop(*[c for c in dims if kinds[c] != "distinct"])


def last_at(xps: DataFrame, dims: list[str], order: str = "seq") -> DataFrame:
    """One row per coordinate, the last by ``order``: an aggregate, so no row moves that cannot win."""
    rest = [c for c in xps.columns if c not in dims]
    return xps.groupBy(dims).agg(F.max_by(F.struct(*rest), F.col(order)).alias("last")).select(*dims, "last.*")


#: Short names of statistics.
ALIASES = {"rmse": "err.rms", "rmss": "spread.rms", "rmv": "spread.rms"}


def stat(avrgs: DataFrame, key: str) -> DataFrame:
    """The rows of one statistic under the name asked for."""
    head, _, rest = key.partition(".")
    full = ".".join(filter(None, (ALIASES.get(head, head), rest)))
    return avrgs.where(F.col("statkey").isin(key, full)).withColumn("statkey", F.lit(key))


def stat_or_raise(avrgs: DataFrame, key: str, experiments: DataFrame) -> DataFrame:
    """``stat``, and a null value for each experiment (``seq``) that lacks it: a warning if some do, an error if all do."""
    got = stat(avrgs, key)
    n = experiments.join(got.select("seq"), "seq", "left_semi").count()
    if not n:
        raise AttributeError(f"no experiment has the statistic {key}")
    all_ = experiments.select("seq").join(got, "seq", "left").withColumn("statkey", F.lit(key))
    if n < experiments.count():
        warnings.warn(f"some experiments lack the statistic {key}", stacklevel=2)
    return all_


def at(xps: DataFrame, place: int | slice | list[int], order: str = "seq") -> DataFrame:
    """The experiments at places of the list in order, as a list has them: one, a slice, or several places.

    Negative places count from the end: they are found by the reverse order, or by the number of rows (one count). Only rows
    up to the place that is farthest from its end are put in order and numbered."""
    if isinstance(place, slice):
        parts = (place.start, place.stop, place.step)
        if place.step is None and place.stop is None and (place.start or 0) < 0:  # the last rows
            return xps.orderBy(F.desc(order)).limit(-place.start)
        if any(p is not None and p < 0 for p in parts) or (place.step not in (None, 1) and place.stop is None):
            r = range(xps.count())[place]
            if not len(r):
                return xps.limit(0)
            low, high = min(r[0], r[-1]), max(r[0], r[-1])
            d = xps.orderBy(order).offset(low).limit(high - low + 1)
            n = F.row_number().over(Window.orderBy(order)) - 1
            return d if abs(r.step) == 1 else d.withColumn("_at", n).where((F.col("_at") % abs(r.step)) == 0).drop("_at")
        first, step = place.start or 0, place.step or 1
        d = xps.orderBy(order).offset(first)
        d = d if place.stop is None else d.limit(max(0, place.stop - first))
        if step == 1:
            return d
        n = F.row_number().over(Window.orderBy(order)) - 1
        return d.withColumn("_at", n).where(F.col("_at") % step == 0).drop("_at")
    asked = [place] if isinstance(place, int) else list(place)
    out = xps.limit(0) if not asked else None
    for some, by in (([p for p in asked if p >= 0], F.col(order)), ([-1 - p for p in asked if p < 0], F.desc(order))):
        if some:
            top = xps.orderBy(by).limit(max(some) + 1).withColumn("_at", F.row_number().over(Window.orderBy(by)) - 1)
            top = top.where(F.col("_at").isin(*some)).drop("_at")
            out = top if out is None else out.unionByName(top)
    return out.dropDuplicates([order]) if isinstance(place, list) and len(asked) > 1 else out


def is_like(name: str, pattern: str | re.Pattern | Callable | Iterable) -> bool:
    """Whether a column's name is a value, matches an expression, suits a test, or is among some of these."""
    if isinstance(pattern, str):
        return name == pattern
    if isinstance(pattern, re.Pattern):
        return pattern.search(name) is not None
    return pattern(name) if callable(pattern) else any(is_like(name, p) for p in pattern)


def intersect(xps: DataFrame, *patterns) -> DataFrame:
    """Only the columns that are like one of the patterns."""
    return xps.select(*[c for c in xps.columns if is_like(c, patterns)])


def complement(xps: DataFrame, *patterns) -> DataFrame:
    """Only the columns that are like none of the patterns."""
    return xps.select(*[c for c in xps.columns if not is_like(c, patterns)])


def known_dims(xps: DataFrame, dims: list[str]) -> list[str]:
    """Those of ``dims`` that are columns; the others are warned of."""
    for c in dims:
        if c not in xps.columns:
            warnings.warn(f"there is no dimension {c}", stacklevel=2)
    return [c for c in dims if c in xps.columns]


def put(space: DataFrame, rows: DataFrame, dims: list[str]) -> DataFrame:
    """``space`` with ``rows`` set at their coordinates; rows of other columns or types are an error."""
    want, have = ({f.name: f.dataType for f in d.schema} for d in (space, rows))
    if want != have:
        raise TypeError(f"rows do not conform: {sorted(set(want.items()) ^ set(have.items()), key=str)}")
    same = reduce(lambda a, b: a & b, [F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")) for c in dims])
    kept = space.alias("s").join(rows.alias("r"), same, "left_anti")
    return kept.unionByName(rows)


def guarded(xps: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds ``crashed`` and ``error``, the first check that a row fails; the job goes on with the others.

    A check that is null counts as failed."""
    error = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    return xps.withColumn("error", error).withColumn("crashed", F.col("error").isNotNull())


def printed(xps: DataFrame, outer: list[str], inner: list[str], mean: list[str], optimise: list[str], value: str = "val") -> DataFrame:
    """The data of a printed table: a row per ``outer`` and ``inner`` coordinate, averaged over ``mean``, best over ``optimise``.

    Columns: the coordinates, the optimum's coordinates, ``val``, ``prec``, ``n_fail`` and ``n_success`` there."""
    keep = [*outer, *inner]
    m = mean_over(xps, [*keep, *optimise], value)
    best = Window.partitionBy(keep).orderBy(F.isnan("val"), "val", *optimise)
    b = m.withColumn("_r", F.row_number().over(best)).where("_r = 1") if optimise else m
    return b.select(*keep, *optimise, "val", "prec", "n_fail", "n_success")


def plotted(xps: DataFrame, panel: list[str], line: list[str], axis: str, mean: list[str], value: str = "val") -> DataFrame:
    """The data of a plot: per panel and line a point for each tick of ``axis``, with the tick's place (null last)."""
    m = mean_over(xps, [*panel, *line, axis], value)
    return m.join(ticks(xps, axis), F.col(axis).eqNullSafe(F.col("tick"))).select(*panel, *line, axis, "place", "val", "prec")


def table_tree(xps: DataFrame, roles: dict[str, list[str]], value: str = "val", cost: Callable[[Column], Column] | None = None) -> DataFrame:
    """The data of a nested table by the role of each dimension: ``outer`` and ``inner`` coordinates stay, ``mean`` ones are averaged
    over, ``optim`` ones are set where the mean's value (or ``cost`` of it) is least; others are ``inner``.

    A row an outer and inner coordinate: the optimum's coordinates, ``val``, ``prec``, ``n_fail``, ``n_success``. A dimension with two
    roles, or in none of the columns, is an error."""
    named = [c for cs in roles.values() for c in cs]
    if len(named) != len(set(named)) or not set(roles) <= {"outer", "inner", "mean", "optim"}:
        raise ValueError("each dimension has one of the roles outer, inner, mean and optim")
    if missing := [c for c in named if c not in xps.columns]:
        raise ValueError(f"there are no dimensions {missing}")
    keep, optim = [*roles.get("outer", []), *roles.get("inner", [])], roles.get("optim", [])
    m = mean_over(xps, [*keep, *optim], value)
    if not optim:
        return m.select(*keep, "val", "prec", "n_fail", "n_success")
    c = cost(F.col("val")) if cost else F.col("val")
    none = F.isnan("val") | F.isnan(c) | c.isNull()
    rank = F.struct(none.alias("none"), F.when(~none, c).alias("cost"), *[F.col(x) for x in optim])
    best = m.groupBy(keep).agg(F.min_by(F.struct(*optim, "val", "prec", "n_fail", "n_success"), rank).alias("b"))
    return best.select(*keep, "b.*")

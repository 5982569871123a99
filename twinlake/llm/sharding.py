"""Sharding by a minimax contiguous partition of ordered groups: DataFrame functions only.

Rows of equal texts are one group that is never cut. Groups stand in one order; the smallest capacity that holds them
in so many shards is searched for, each trial cutting greedily, and there the order is cut. A row then finds its shard by
comparing its group's place in the order with the few cuts: no row meets another row for that."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinlake.llm.common import materialise, others

#: Groups lie in so many buckets by the first bits of their digest: the driver holds a sum and a count of each.
BUCKETS = 1 << 16
#: A group over the total by this number and the shards is large: there are at most as many as their product.
LARGE = 64
#: Capacities that are tried at once.
TRIED = 4096
_SMALL = (1 << 20) - 1


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def size_of(text: Column) -> Column:
    """UTF-8 bytes (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _bucket(key: str) -> Column:
    return F.conv(F.hex(F.substring(key, 1, 2)), 16, 10).cast("int")


@dataclass
class Order:
    """The order of groups but giants, as sums: buckets of small groups, and large ones each by itself.

    ``ends`` are running sums; an entry of ``bucket`` >= 0 can be cut where it has several groups (``groups``, the written
    table of small groups with their running sums in the bucket)."""

    ends: np.ndarray
    bucket: np.ndarray
    count: np.ndarray
    groups: DataFrame

    def reach(self, bounds: np.ndarray) -> np.ndarray:
        """The greatest running sum that is no greater than each bound, in one job over the buckets that bounds fall in."""
        at = np.searchsorted(self.ends, bounds, "right")
        out = np.where(at > 0, self.ends[np.maximum(at - 1, 0)], 0)
        inside = at < len(self.ends)
        inside[inside] = self.count[at[inside]] > 1
        inside &= bounds > out
        if not inside.any():
            return out
        asked, back = np.unique(np.stack([self.bucket[at[inside]], bounds[inside] - out[inside]], 1), axis=0, return_inverse=True)
        spark = self.groups.sparkSession
        said = F.lit(",".join(f"{k} {b} {most}" for k, (b, most) in enumerate(asked.tolist())))  # one literal: at most TRIED bounds
        one = lambda k: F.get("a", k).cast("long")
        q = spark.range(1).select(F.explode(F.split(said, ",")).alias("a")).select(F.split("a", " ").alias("a")).select(one(0).alias("q"), one(1).alias("at"), one(2).alias("most"))
        near = self.groups.where(F.col("bucket").between(int(asked[0, 0]), int(asked[-1, 0]))).select("bucket", "run")
        found = near.join(F.broadcast(q), (F.col("bucket") == F.col("at")) & (F.col("run") <= F.col("most"))).groupBy("q").agg(F.max("run").alias("run"))
        more = np.zeros(len(asked), "i8")
        for r in found.collect():
            more[r.q] = r.run
        out[inside] += more[back.reshape(-1)]
        return out

    def roughly(self, bound: int, start: int, early: bool) -> int:
        """``reach`` from the sums alone: no further than it (``early``), or no less far."""
        at = int(np.searchsorted(self.ends, bound, "right"))
        base = int(self.ends[at - 1]) if at else 0
        if early or at == len(self.ends) or self.count[at] < 2:
            return max(base, start)
        return max(bound, start)


def smallest(order: Order, start: int, shards: int, most: int) -> int:
    """The smallest capacity with which ``shards`` greedy steps from the running sum ``start`` come to the end; ``most`` is one."""
    total = int(order.ends[-1])

    def sure(c: int, early: bool) -> bool:
        at = start
        for _ in range(shards):
            at = order.roughly(at + c, at, early)
        return at >= total

    def first(lo: int, hi: int, early: bool) -> int:
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if sure(mid, early) else (mid + 1, hi)
        return lo

    lo = first(-(-(total - start) // shards), most, False)  # under it even cuts inside groups fail
    hi = first(lo, most, True)
    while lo < hi:
        tried = np.unique(np.linspace(lo, hi - 1, TRIED, dtype="i8")) if hi - lo > TRIED else np.arange(lo, hi)
        at = np.full(len(tried), start)
        for _ in range(shards):
            at = order.reach(at + tried)
        good = np.flatnonzero(at >= total)
        k = int(good[0]) if good.size else len(tried)
        lo, hi = (int(tried[k - 1]) + 1 if k else lo), (int(tried[k]) if k < len(tried) else hi)
    return lo


def partition(groups: DataFrame, shards: int) -> tuple[DataFrame, int, list[tuple[int, bytes]]]:
    """(large groups with their places, number of giants, cuts) for ``groups`` (key, size).

    A giant has an even share of the total or more, and a shard for itself. Other groups stand by key, but for large
    ones: these are dealt out, largest first and to and fro, to as many places as there are shards left, evenly spaced by
    size, so that a cut falls among small groups. The order is cut at the smallest capacity; what is then left is cut at the
    smallest capacity of the shards that are left, and so on, so no shard is filled at another's cost."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    big = groups.where(F.col("size") * (LARGE * shards) >= total).withColumn("r", F.row_number().over(Window.orderBy(F.desc("size"), "key")) - 1)
    rows = [(r.size, r.key) for r in big.orderBy("r").select("size", "key").collect()]  # at most LARGE * shards
    giants = sum(s * shards >= total for s, _ in rows)
    left, large = shards - giants, [s for s, _ in rows[giants:]]
    small = groups.where(F.col("size") * (LARGE * shards) < total).withColumn("bucket", _bucket("key"))
    run = F.sum("size").over(Window.partitionBy("bucket").orderBy("key"))
    small = materialise(small.repartitionByRange("bucket").select("bucket", "key", run.alias("run")), "groups")
    sums, count = np.zeros(BUCKETS, "i8"), np.zeros(BUCKETS, "i8")
    for r in small.groupBy("bucket").agg(F.max("run").alias("s"), F.count(F.lit(1)).alias("n")).collect():
        sums[r.bucket], count[r.bucket] = r.s, r.n
    if not left or not (sums.sum() + sum(large)):
        return big.withColumn("place", F.lit(0).cast("long")), giants, []

    seats = [r % left if r // left % 2 == 0 else left - 1 - r % left for r in range(len(large))]
    even, ends = (int(sums.sum()) + sum(large)) // left, np.cumsum(sums)
    ahead, start = 0, []
    for j in range(left):
        start.append(max(start[-1] if j else 0, min(int(ends[-1]), j * even - ahead)))
        ahead += sum(s for s, k in zip(large, seats, strict=True) if k == j)
    first = np.searchsorted(ends, start, "right")
    line = sorted(range(len(large)), key=lambda r: (seats[r], r))
    places = {r: int(first[seats[r]]) << 20 | i for i, r in enumerate(line)}

    full = np.flatnonzero(count)
    place = np.concatenate([full << 20 | _SMALL, np.array([places[r] for r in range(len(large))], "i8")])
    o = np.argsort(place)
    n = np.concatenate([count[full], np.ones(len(large), "i8")])[o]
    order = Order(np.cumsum(np.concatenate([sums[full], np.array(large, "i8")])[o]), np.concatenate([full, np.full(len(large), -1)])[o], n, small)
    end, at, cuts = int(order.ends[-1]), 0, []
    most = -(-end // left) + max([*large, int(sums.max())])
    for j in range(left - 1):
        most = smallest(order, at, left - j, most)
        at = int(order.reach(np.array([at + most]))[0])
        if at >= end:
            break
        cuts.append(at)
    placed = [0] * giants + [places[r] for r in range(len(large))]
    place_of = F.element_at(F.lit(placed).cast("array<bigint>"), F.col("r") + 1) if placed else F.lit(0).cast("long")
    return big.withColumn("place", place_of), giants, _keys(order, place[o], cuts, [k for _, k in rows[giants:]], places)


def _keys(order: Order, place: np.ndarray, cuts: list[int], large: list[bytes], places: dict[int, int]) -> list[tuple[int, bytes]]:
    """(place, key) of the last group before each cut, by one look at the few buckets that cuts are in."""
    at = np.searchsorted(order.ends, cuts, "left")
    base = np.where(at > 0, order.ends[np.maximum(at - 1, 0)], 0)
    asked = {(int(order.bucket[i]), int(c - b)) for i, c, b in zip(at, cuts, base, strict=True) if order.bucket[i] >= 0}
    found = {}
    if asked:
        hit = F.lit(False)
        for b, run in asked:
            hit |= (F.col("bucket") == b) & (F.col("run") == run)
        found = {(r.bucket, r.run): bytes(r.key) for r in order.groups.where(hit).collect()}
    by_place = {p: large[r] for r, p in places.items()}
    return [(int(place[i]), found[int(order.bucket[i]), int(c - b)] if order.bucket[i] >= 0 else bytes(by_place[int(place[i])])) for i, c, b in zip(at, cuts, base, strict=True)]


def shards(df: DataFrame, count: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns and ``shard`` (0 to ``count`` - 1), ``slot`` (gapless from 0 in each shard, by id): sizes are near equal.

    A row's size is the UTF-8 bytes of its text plus 1; rows of equal texts come to one shard, whatever their number
    (a null text is an empty one). Rows are sorted by (shard, id) over all tasks and written so; repeated rows have slots of
    their own, a null id sorts first. Columns named like the two that are added are replaced. An empty table stays empty."""
    names = others(df, "shard", "slot")
    text = F.col(f"`{text_col}`")
    groups = materialise(df.select(digest(text).alias("key"), size_of(text).alias("size")).groupBy("key").agg(F.sum("size").alias("size")), "sizes")
    big, giants, cuts = partition(groups, count)
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    d = df.select(row.alias("row"), digest(text).alias("key"), F.monotonically_increasing_id().alias("nth"))
    big = F.broadcast(big.select(F.col("key").alias("k"), "r", "place"))  # at most LARGE groups a shard
    d = d.join(big, F.col("key") == F.col("k"), "left")
    place = F.coalesce("place", F.shiftleft(_bucket("key").cast("long"), 20).bitwiseOR(F.lit(_SMALL).cast("long")))
    d = d.withColumn("place", place)
    after = sum((((F.col("place") > p) | ((F.col("place") == p) & (F.col("key") > F.lit(k)))).cast("int") for p, k in cuts), F.lit(giants))
    d = d.select("row", F.when(F.col("r") < giants, F.col("r")).otherwise(after).cast("int").alias("shard"), "nth")
    by = ["shard", F.col(f"row.`{id_col}`"), "nth"]
    d = d.repartitionByRange(*by).sortWithinPartitions(*by).select("row", "shard", F.monotonically_increasing_id().alias("nth"))
    d = materialise(d, "shards")
    part = F.shiftrightunsigned("nth", 33).alias("part")
    runs = d.groupBy("shard", part).agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    runs = F.broadcast(runs.select(F.col("shard").alias("s"), F.col("part").alias("p"), (ahead - F.col("first")).alias("shift")))  # tasks and shards at most
    d = d.join(runs, (F.col("shard") == F.col("s")) & (part == F.col("p")))
    return d.select(*[F.col(f"row.`{c}`") for c in names], "shard", (F.col("nth") + F.col("shift")).alias("slot"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard of near equal size and its slot there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shards(docs)
    text = F.col("text")
    return out.select("doc_id", size_of(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _greedy(j: int) -> str:
    """SQL that finds the smallest capacity of what is left before shard ``j`` by trying all, and the running sum where it ends."""
    steps = ", ".join(
        f"g{j}_{i} AS (SELECT g.c, g.m, CASE WHEN {i} < g.m THEN e.hi ELSE g.pos END AS pos FROM g{j}_{i - 1} g ASOF JOIN ends e ON e.hi <= g.pos + g.c)" if i else
        f"g{j}_0 AS (SELECT t.c, p.m, CASE WHEN p.m > 0 THEN e.hi ELSE p.pos END AS pos FROM (SELECT unnest(range(lo, hi + 1)) AS c FROM p{j}) t CROSS JOIN p{j} p ASOF JOIN ends e ON e.hi <= p.pos + t.c)"
        for i in range(8)
    )
    return f"""{steps}, c{j} AS MATERIALIZED (SELECT min(c) AS c FROM g{j}_7, t WHERE pos = t.rest),
p{j + 1} AS MATERIALIZED (SELECT n.pos, p.m - 1 AS m, CASE WHEN p.m > 1 THEN ceil((t.rest - n.pos) / (p.m - 1))::BIGINT ELSE 0 END AS lo, CASE WHEN p.m > 1 THEN c.c ELSE 0 END AS hi
  FROM p{j} p, t, c{j} c, (SELECT coalesce(max(e.hi), 0) AS pos FROM ends e, p{j} p, c{j} c WHERE e.hi <= p.pos + c.c) n)"""


#: The same by trying every capacity; sums of bits give the checksum of a text.
OP12_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 1 AS size, sha256(coalesce(text, '')) AS k FROM documents),
g AS MATERIALIZED (SELECT k, sum(size)::BIGINT AS size, ('0x' || k[1:4])::BIGINT AS bucket FROM d GROUP BY k),
t0 AS MATERIALIZED (SELECT sum(size)::BIGINT AS total FROM g),
b AS MATERIALIZED (SELECT g.*, size * 8 >= total AS giant, size * 512 >= total AS large, row_number() OVER (ORDER BY size DESC, k) - 1 AS r FROM g, t0),
t AS MATERIALIZED (SELECT count(*) FILTER (giant) AS giants, 8 - count(*) FILTER (giant) AS m, coalesce(sum(size) FILTER (NOT giant), 0)::BIGINT AS rest, coalesce(sum(size) FILTER (NOT large), 0)::BIGINT AS small, coalesce(max(size) FILTER (NOT giant), 0) AS most FROM b),
cum AS MATERIALIZED (SELECT bucket, sum(sum(size)) OVER (ORDER BY bucket)::BIGINT AS hi FROM b WHERE NOT large GROUP BY bucket),
l AS MATERIALIZED (SELECT k, size, r - giants AS r, CASE WHEN ((r - giants) // m) % 2 = 0 THEN (r - giants) % m ELSE m - 1 - (r - giants) % m END AS seat FROM b, t WHERE large AND NOT giant),
s AS MATERIALIZED (SELECT j, least(t.small, greatest(0, j * (rest // m) - coalesce((SELECT sum(size) FROM l WHERE seat < j), 0))) AS want FROM t, range(0, 8) x(j) WHERE j < m),
s2 AS (SELECT j, max(want) OVER (ORDER BY j) AS want FROM s),
s3 AS MATERIALIZED (SELECT j, coalesce((SELECT min(bucket) FROM cum WHERE hi > want), 65536) AS first FROM s2),
p AS (SELECT l.k, l.size, first * 1048576 + row_number() OVER (ORDER BY seat, r) - 1 AS place FROM l JOIN s3 ON j = seat UNION ALL SELECT k, size, bucket * 1048576 + 1048575 FROM b WHERE NOT large),
o AS MATERIALIZED (SELECT k, sum(size) OVER (ORDER BY place, k)::BIGINT AS hi FROM p),
ends AS MATERIALIZED (SELECT hi FROM o UNION ALL SELECT 0),
p0 AS MATERIALIZED (SELECT 0::BIGINT AS pos, m, CASE WHEN m > 0 THEN ceil(rest / m)::BIGINT ELSE 0 END AS lo, CASE WHEN m > 0 THEN ceil(rest / m)::BIGINT + most ELSE 0 END AS hi FROM t),
{", ".join(_greedy(j) for j in range(7))},
w AS MATERIALIZED (SELECT k, r AS shard FROM b WHERE giant UNION ALL SELECT k, giants + {" + ".join(f"(CASE WHEN hi > (SELECT pos FROM p{j}) THEN 1 ELSE 0 END)" for j in range(1, 8))} FROM o, t),
ct AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS tab FROM range(0, 256) x(n)),
e AS (SELECT k, any_value(t) AS t FROM d GROUP BY k),
cr AS (SELECT k, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, v: xor(c >> 8, tab[xor(c & 255, v) + 1]))) AS crc FROM e, ct)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM d JOIN w USING (k) JOIN cr USING (k)
"""

"""Filter interaction audit: what each filter removes in each order, and what it would have removed anyway.

Texts are measured in Arrow's own buffers with numpy (byte classes, prefix sums, sorted word hashes whose equal
neighbours are compared byte by byte). What a row fails is one bit a filter; rows are counted by part and mask, and
every order of the filters is read from these counts: no text is measured twice, no order runs over the documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.llm.bytescan import BASES, STRIP, buffers, hashes, mix, rows_by_bytes, same, table, words
from twinlake.llm.common import materialise, others, small_batches, tidy

#: White space, capitals and symbols.
GAP, CAPITAL, SYMBOL = table(" \t\n\x0b\x0c\r"), table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), table("#$%&*|")
GAPS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
MEASURES = ["n_words", "n_distinct", "n_capitals", "n_symbols", "n_points", "text_key"]
KINDS = "n_words long, n_distinct long, n_capitals long, n_symbols long, n_points long, text_key binary"


def distinct(data: np.ndarray, first: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words that differ from the one before them in the order of their hashes, texts of which that is no proof).

    Two neighbours with one hash are the same word only if they are of one text and their bytes agree."""
    key = mix(hashes(data, first, end, BASES[0]) + doc.astype(np.uint64) * np.uint64(BASES[1]))
    order = np.argsort(key)
    a, b = order[:-1], order[1:]
    at = np.flatnonzero(key[a] == key[b])
    a, b = a[at], b[at]
    size = end[a] - first[a]
    alike = (doc[a] == doc[b]) & (size == end[b] - first[b])
    alike[alike] = same(data, first[a[alike]], first[b[alike]], size[alike])
    new = np.ones(len(order), bool)
    new[at + 1] = ~alike
    return order[new], np.unique(np.concatenate([doc[a[~alike]], doc[b[~alike]]]))


def counted(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Words, distinct words, capitals, symbols and code points (rows) of each text (columns)."""
    n = len(off) - 1
    out = np.zeros((5, n), "i8")
    for k, sign in ((2, CAPITAL[data]), (3, SYMBOL[data]), (4, (data & 0xC0) != 0x80)):
        sums = np.concatenate([[0], np.cumsum(sign)])
        out[k] = sums[off[1:]] - sums[off[:-1]]
    first, end = words(GAP[data], off[:-1])
    doc = np.searchsorted(off, first, "right") - 1
    out[0] = np.bincount(doc, minlength=n)
    new, unproved = distinct(data, first, end, doc)
    out[1] = np.bincount(doc[new], minlength=n)
    for i in unproved:
        out[1, i] = len(set(data[off[i] : off[i + 1]].tobytes().translate(GAPS).split(b" ")) - {b""})
    return out


def counted_long(text: np.ndarray) -> np.ndarray:
    """The same of one long text, in strips that end at white space; a word of several strips is taken as plain bytes."""
    out, seen, at = np.zeros(5, "i8"), set(), 0
    while at < len(text):
        end = at + STRIP
        while end < len(text) and not (gap := np.flatnonzero(GAP[text[end : end + STRIP]])).size:
            end += STRIP
        end = min(len(text), end + int(gap[0]) if end < len(text) else end)
        strip = text[at:end]
        if len(strip) <= 4 * STRIP:
            first, stop = words(GAP[strip], np.zeros(1, "i8"))
            new, _ = distinct(strip, first, stop, np.zeros(len(first), "i8"))
            raw = strip.tobytes()
            seen.update(raw[a:z] for a, z in zip(first[new].tolist(), stop[new].tolist(), strict=True))
            out[0] += len(first)
        else:
            every = [w for w in strip.tobytes().translate(GAPS).split(b" ") if w]
            seen.update(every)
            out[0] += len(every)
        for a in range(0, len(strip), STRIP):
            part = strip[a : a + STRIP]
            out[2:] += CAPITAL[part].sum(), SYMBOL[part].sum(), ((part & 0xC0) != 0x80).sum()
        at = end
    out[1] = len(seen)
    return out


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``df`` but the text, and its ``MEASURES``: words (runs without blank, tab to carriage return), distinct
    words, capitals A-Z, symbols, code points, and ``text_key``, a digest of 256 bits that equal texts share.

    A null text is an empty one. Texts of any length are measured whole, in strips of ``STRIP`` bytes. Columns named like
    a measure are replaced."""
    small_batches(df.sparkSession)
    names = [c for c in others(df, *MEASURES) if c != text_col]
    d = df.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    kind = d.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column("text"))
            parts = []
            for a, z in rows_by_bytes(off):
                text = data[off[a] : off[z]]
                parts.append(counted(text, off[a : z + 1] - off[a]) if len(text) <= 4 * STRIP else counted_long(text)[:, None])
            n = np.concatenate(parts, 1) if parts else np.zeros((5, 0), "i8")
            keys = [hashlib.sha256(data[a:z]).digest() for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), *map(pa.array, n), pa.array(keys, pa.binary())], names=["row", *MEASURES])

    out = d.mapInArrow(tidy(run), f"row {kind}, {KINDS}")
    return out.select(*[F.col(f"row.`{c}`") for c in names], *MEASURES)


def repeated(m: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds ``repeat``: whether a row of a smaller id has the same text.

    The smallest id of a text meets the rows by text and id together, so a text of which there are very many is dealt out
    by id. A null id is never smaller nor greater; rows that share the smallest id are no repeats."""
    first = m.where(F.col(id_col).isNotNull()).groupBy(F.col("text_key").alias("_key")).agg(F.min(id_col).alias("_first"))
    d = m.join(first, (F.col("text_key") == F.col("_key")) & (F.col(id_col) == F.col("_first")), "left")
    return d.withColumn("repeat", F.col(id_col).isNotNull() & F.col("_first").isNull()).drop("_key", "_first")


def by_mask(rows: DataFrame, part: Column, filters: dict[str, Column], **flags: Column) -> DataFrame:
    """(part, mask, n, one count a flag): rows by what they fail, bit k for the k-th filter."""
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(filters.values())), F.lit(0))
    return rows.groupBy(part.alias("part"), mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c.cast("long")).alias(name) for name, c in flags.items()])


def orders(counts: DataFrame, letters: str, *flags: str) -> DataFrame:
    """A row a part, order of the filters and step: ``kept``, ``removed``, ``redundant``, ``unique_fails``, removals by flag
    (``<flag>_lost``) and ``shapley``.

    A filter's share of a row that fails m filters is the same for each of them: of all orders, one in m has it first."""
    bit = {c: 1 << k for k, c in enumerate(letters)}
    steps, total = [], 1
    for k in range(len(letters)):
        total *= k + 1
    for p in permutations(letters):
        before = 0
        for k, c in enumerate(p):
            steps.append(f"{''.join(p)} {k + 1} {before} {bit[c]}")
            before |= bit[c]
    d = counts.select("*", F.explode(F.split(F.lit(",".join(steps)), ",")).alias("_step"))  # a fixed table: every order and step
    d = d.withColumn("_step", F.split("_step", " ")).withColumns({"o": F.get("_step", 0), **{c: F.get("_step", k).cast("int") for k, c in ((1, "s"), (2, "b"), (3, "f"))}})
    hit = (F.col("mask").bitwiseAND(F.col("f"))) > 0
    early = (F.col("mask").bitwiseAND(F.col("b"))) > 0
    here = hit & ~early
    n = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    out = d.groupBy("part", F.col("o").alias("filter_order"), F.col("s").alias("step")).agg(
        n(~hit & ~early).alias("kept"),
        n(here).alias("removed"),
        n(hit & early).alias("redundant"),
        n(F.col("mask") == F.col("f")).alias("unique_fails"),
        *[n(here, c).alias(f"{c}_lost") for c in flags],
        F.sum(F.when(hit, F.expr(f"n * ({total} div bit_count(mask))")).otherwise(0)).cast("long").alias("shapley"),
    )
    return out


#: Filters of the registered query: what makes a document fail, over the measures and ``repeat``.
FILTERS = {
    "A": "n_words < 100",
    "B": "100 * n_distinct < 80 * n_words",
    "C": "100 * n_capitals > 10 * n_points",
    "D": "n_symbols > 0",
    "E": "repeat",
}


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """Per part (lang, null: empty), order and step of ``filters`` (conditions of failure over ``MEASURES`` and ``repeat``).

    ``labels`` (doc_id, quality, toxic) may cover some documents; where a document has several labels, one with
    quality 1 (toxic 1) counts. An empty table gives no rows; other columns play no part, whatever their names."""
    d = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.col("text").alias("text"))
    m = materialise(measured(d), "measures")
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("quality") == 1)).alias("good"), F.max((F.col("toxic") == 1)).alias("toxic"))
    rows = repeated(m).join(said, F.col("doc_id") == F.col("_id"), "left")
    no = F.lit(False)
    counts = by_mask(rows, F.col("part"), {k: F.expr(v) for k, v in filters.items()}, good=F.coalesce("good", no), toxic=F.coalesce("toxic", no))
    return orders(counts, "".join(filters), "good", "toxic")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over every document, in all 120 orders."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: The same by patterns and plain counting of every document in every order.
OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
f AS MATERIALIZED (SELECT doc_id, part,
  CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END AS a, CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 1 ELSE 0 END AS b,
  CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 1 ELSE 0 END AS c,
  CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 1 ELSE 0 END AS d, CASE WHEN doc_id > first_id THEN 1 ELSE 0 END AS e FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
r AS MATERIALIZED (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, MAP {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, a + b + c + d + e AS failed FROM f LEFT JOIN l USING (doc_id)),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT [p.c, q.c, s.c, t.c, u.c] AS o FROM x p, x q, x s, x t, x u WHERE len(list_distinct([p.c, q.c, s.c, t.c, u.c])) = 5),
runs AS (SELECT part, good, toxic, fails, failed, o, step::INTEGER AS step, fails[o[step]] AS fail,
  CASE WHEN len(list_filter(o[1:step - 1], lambda z: fails[z] = 1)) > 0 THEN 1 ELSE 0 END AS gone FROM r, o, range(1, 6) s(step)),
y AS (SELECT part, array_to_string(o, '') AS filter_order, step, o[step] AS c, count(*) FILTER (fail = 0 AND gone = 0) AS kept, count(*) FILTER (fail = 1 AND gone = 0) AS removed,
  count(*) FILTER (fail = 1 AND gone = 1) AS redundant, count(*) FILTER (fail = 1 AND failed = 1) AS unique_fails,
  count(*) FILTER (fail = 1 AND gone = 0 AND good = 1) AS good_lost, count(*) FILTER (fail = 1 AND gone = 0 AND toxic = 1) AS toxic_lost FROM runs GROUP BY part, o, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, c)::BIGINT AS shapley FROM y
"""

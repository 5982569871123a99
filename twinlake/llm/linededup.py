"""Line dedup by winnowing over line hashes: DataFrame functions only.

A window is a run of lines that counts: of ``window + 1`` lines, or of fewer with ``min_words`` words. In each window
the line of the least hash is the fingerprint, so a run that stands at two places has the same fingerprints at both.
Fingerprints that stand at one place only are dropped. At the others the match is extended both ways to the whole
window, and windows of one fingerprint and the same lines are held against the first of them. Longer runs are
windows one after another: what later windows cover is deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.llm.common import let, materialise, others


def _lines(text: Column) -> Column:
    """The non-blank lines: a hash of the trimmed line, its words."""
    said = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda t: t != "")
    return F.transform(said, lambda t: F.struct(F.xxhash64(t).alias("h"), (F.length(t) - F.length(F.translate(t, " ", "")) + 1).alias("w")))


def _windows(h: Column, w: Column, n: Column, k: int, window: int, min_words: int) -> Column:
    """Windows of ``k`` lines that are not put together from shorter ones.

    Each has its start ``s``, its lines ``k``, the fingerprint's place ``p`` and hash ``key``, and a hash ``run`` of all lines."""
    words = lambda i, k: sum((F.get(w, i + j) for j in range(1, k)), F.get(w, i))
    need = lambda i: F.lit(True) if k > window else words(i, k) >= min_words
    made = lambda i: (words(i, k - 1) >= min_words) & (words(i + 1, k - 1) >= min_words) if k > 1 else F.lit(False)

    def one(i):
        own = [F.get(h, i + j) for j in range(k)]
        least = F.array_min(F.array(*own))
        place = F.array_position(F.array(*own), least).cast("int") - 1 + i
        return F.struct(place.alias("p"), i.alias("s"), F.lit(k).alias("k"), least.alias("key"), F.xxhash64(F.lit(k), *own).alias("run"))

    at = F.filter(F.sequence(F.lit(0), n - k), lambda i: need(i) & ~made(i))
    return F.when(n >= k, F.transform(at, one)).otherwise(F.array().cast("array<struct<p:int,s:int,k:int,key:bigint,run:bigint>>"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2, min_words: int = 8) -> DataFrame:
    """One row per window with its fingerprint: document (``id``, ``th``), ``p``, ``s``, ``k``, ``key``, ``run``."""
    d = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"), _lines(F.col(f"`{text_col}`")).alias("ln"))
    every = lambda h, w: F.concat(*[_windows(h, w, F.size(h), k, window, min_words) for k in range(1, window + 2)])
    d = d.select("id", "th", let(F.col("ln.h"), lambda h: let(F.col("ln.w"), lambda w: every(h, w))).alias("f"))
    return d.select("id", "th", F.inline("f"))


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2, min_words: int = 8) -> DataFrame:
    """Per document with later repeats: ``drop``, the places (among non-blank lines) of repeated lines, in order.

    First places are plain minima with partial sums, so a line that very many documents share is a row a task;
    the joins with them have no other need of their keys, so adaptive execution may split a hot one."""
    f = materialise(fingerprints(df, id_col, text_col, window, min_words), "line-windows")
    seen = f.groupBy("key").agg(F.min(F.struct("id", "th", "p")).alias("a"), F.max(F.struct("id", "th", "p")).alias("z")).where(~F.col("a").eqNullSafe(F.col("z")))
    hit = materialise(f.join(seen.select("key"), "key", "left_semi").drop("p"), "line-matches")
    first = hit.groupBy("key", "run").agg(F.min(F.struct("id", "th", "s")).alias("a"), F.max(F.struct("id", "th", "s")).alias("z")).where(~F.col("a").eqNullSafe(F.col("z")))
    later = hit.join(first.drop("z"), ["key", "run"]).where(~F.struct("id", "th", "s").eqNullSafe(F.col("a")))
    at = later.select("id", "th", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("k") - 1)).alias("at"))
    return at.groupBy("id", "th").agg(F.sort_array(F.collect_set("at")).alias("drop"))


def _mask(places: Column) -> Column:
    """Whether each line up to the last of ``places`` (in order) is one of them."""
    before = lambda i: F.when(i == 0, -1).otherwise(F.get(places, i - 1))
    return F.flatten(F.transform(places, lambda d, i: F.concat(F.array_repeat(F.lit(False), d - before(i) - 1), F.array(F.lit(True)))))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2, min_words: int = 8) -> DataFrame:
    """Delete later repeats of runs of lines; all columns stay, ``_n_lines`` and ``_n_removed`` are added.

    Documents are ordered by id, then by a hash of the text. A run of more than ``window`` lines, or of
    ``min_words`` words, that stands at an earlier place (in this or another document) is deleted; the
    first place of any line stays. Lines are compared without outer blanks; blank lines
    are skipped in comparison and kept. Null text stays null, empty text stays empty. Rows with the
    same id and text are one document and are treated alike; a null id sorts first. Work and memory
    are linear in the lines of a text, however long. Extra columns pass
    through whatever their names, but for those named like the two that are added."""
    drop = repeated(df, id_col, text_col, window, min_words)
    names = others(df, "_n_lines", "_n_removed")
    d = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"))
    x = drop.select(F.col("id").alias("did"), F.col("th").alias("dth"), "drop")
    d = d.join(x, F.col("id").eqNullSafe(F.col("did")) & (F.col("th") == F.col("dth")), "left")
    text = F.col(f"row.`{text_col}`")
    lines = F.split(text, "\n", -1)
    blank = lambda t: F.trim(t) == ""
    place = F.filter(F.transform(lines, lambda t, i: F.when(~blank(t), i)), lambda i: i.isNotNull())
    gone = let(place, lambda at: F.transform("drop", lambda k: F.get(at, k)))
    kept = let(gone, lambda g: let(_mask(g), lambda m: F.array_join(F.filter(lines, lambda t, i: ~F.coalesce(F.get(m, i), F.lit(False))), "\n")))
    new = F.when(F.col("drop").isNull(), text).otherwise(kept)
    return d.select(
        *[(new if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in names],
        F.coalesce(F.size(F.filter(lines, lambda t: ~blank(t))), F.lit(0)).alias("_n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).alias("_n_removed"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    """Every document with its later repeated runs deleted."""
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"))


#: The same rule by strings: runs of one to three lines that count, each against the first place of its lines.
OP7_SQL = """
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS ln FROM documents),
every AS (SELECT doc_id, unnest(ln) AS t, unnest(range(len(ln))) AS i FROM split),
said AS (SELECT doc_id, i, trim(t, ' ') AS t, len(trim(t, ' ')) - len(replace(trim(t, ' '), ' ', '')) + 1 AS w,
  row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM every WHERE trim(t, ' ') <> ''),
ahead AS (SELECT *, lead(t, 1) OVER d AS t1, lead(t, 2) OVER d AS t2, lead(w, 1) OVER d AS w1 FROM said WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
runs AS (
  SELECT doc_id, p, 1 AS k, t AS run FROM ahead WHERE w >= 8
  UNION ALL SELECT doc_id, p, 2, t || chr(10) || t1 FROM ahead WHERE t1 IS NOT NULL AND w + w1 >= 8
  UNION ALL SELECT doc_id, p, 3, t || chr(10) || t1 || chr(10) || t2 FROM ahead WHERE t2 IS NOT NULL),
later AS (SELECT doc_id, p, k FROM (SELECT *, row_number() OVER (PARTITION BY k, run ORDER BY doc_id, p) AS nth FROM runs) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, p + d AS p FROM later, range(3) AS r(d) WHERE d < k),
mark AS (SELECT s.doc_id, s.i FROM said AS s JOIN gone AS g ON s.doc_id = g.doc_id AND s.p = g.p),
kept AS (SELECT e.doc_id, string_agg(e.t, chr(10) ORDER BY e.i) AS text FROM every AS e LEFT JOIN mark AS m ON e.doc_id = m.doc_id AND e.i = m.i WHERE m.i IS NULL GROUP BY e.doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM said GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT s.doc_id, CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
  CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed
FROM split AS s LEFT JOIN kept ON s.doc_id = kept.doc_id LEFT JOIN n ON s.doc_id = n.doc_id LEFT JOIN r ON s.doc_id = r.doc_id
"""

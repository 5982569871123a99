"""Small tables and comparisons that the tests of this folder share."""

from pathlib import Path

DATA = "/root/testdata/sf0.001"
CLASH = ("node", "key", "row", "drop", "at", "text_", "_size", "_rank", "_shard", "_base", "_spans", "_found", "grp", "id", "ids", "batch", "word")


def documents(spark, rows, more=False):
    """(doc_id, text, lang, source, n_chars) of (id, text) or (id, text, lang) rows, with columns whose names operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1]), *(CLASH if more else ())) for r in rows]
    kind = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in CLASH) * more
    return spark.createDataFrame(full, kind)


def folder(spark, tmp_path, **tables):
    """A folder of tables for a query: each is one Parquet folder."""
    out = Path(tmp_path) / "tables"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}.parquet")
    return str(out)


def texts():
    """Every document of the small table, in Python."""
    import pyarrow.parquet as pq

    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()]

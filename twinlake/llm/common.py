"""Shared helpers: the shared folder, written tables, safe text chunks."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none, a temporary one is set if all runs on one machine (as in tests); on a cluster
    that folder would be another on each machine, so it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="twinlake-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_RUN.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: The folder of the run that is going on in this thread, if ``scratch`` began one.
_RUN: contextvars.ContextVar[str | None] = contextvars.ContextVar("twinlake_run", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """A run whose intermediate tables lie in one folder, which goes at the end: write what the run gives before that.

    Without it such tables stay in the shared folder, since a result may be read at any time."""
    path = fresh_path(spark, "run")
    token = _RUN.set(path)
    try:
        yield path
    finally:
        _RUN.reset(token)
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of text that go to Python at once: a batch is held by the JVM, outside its heap, and by the worker.
BATCH_ROWS = 2048


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows a batch to ``BATCH_ROWS`` where it has more: rows here are whole texts, not numbers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def tidy(run):
    """A function of record batches that gives back what its task has freed: workers stay for later tasks, beside the JVM."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only where the C library can
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but those that an operator's own ``names`` replace."""
    own = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in own]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(text: str) -> list[str]:
    """Cut ``text`` where every BPE pre-tokeniser used here cuts too; the parts join to the text.

    A cut is made before one blank between two non-blank characters, and around one line feed between
    two non-blank characters. Every token pattern here starts a token at such a blank (an optional
    leading blank, then one class of characters) and gives such a line feed a token of its own, so
    tokens of the parts in order are the tokens of the text. A part that holds other white space is
    left to the tokeniser as it is."""
    if is_odd(text):
        return _SAFE(text)
    out = []
    for k, line in enumerate(text.split("\n")):
        if k:
            out.append("\n")
        first, *rest = line.split(" ")
        out.append(first)
        out += [" " + x for x in rest]
    return out


def is_odd(text: str) -> bool:
    """Whether white space stands next to white space or at an end."""
    if any(map(text.__contains__, _RARE)):
        return _ODD(text) is not None
    return any(map(text.__contains__, _TWICE)) or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n")


#: White space but blank and line feed, and runs of these two: found faster than by a pattern.
_RARE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_TWICE = ["  ", " \n", "\n ", "\n\n"]
_ODD = re.compile(r"\s\s|^\s|\s\Z").search
_SAFE = re.compile(r"(?:(?<!\s) (?!\s)|(?<=\S)\n(?=\S)|)(?:(?!(?<=\S)[ \n](?=\S)).)*", re.S).findall

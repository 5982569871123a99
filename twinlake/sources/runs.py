"""Runs of experiments as tables on any file system: a folder a name, a partition a run, written once.

A run's rows carry ``run_ts``; the latest run is the largest, compaction writes a run anew, and what a run
lacks of its plan is what crashed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_run(xps: DataFrame, root: str, name: str, run_ts: int, files: int = 0) -> None:
    """Write a run; with ``files``, dealt out by experiment into that many."""
    d = xps.repartition(files, "xp_id") if files else xps
    d.write.mode("errorifexists").parquet(f"{root}/{name}/run_ts={run_ts}")


def latest_run(spark: SparkSession, root: str, name: str) -> int | None:
    """From the names of partitions: no rows are read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [p.getPath().getName() for p in fs.listStatus(path)]
    return max((int(x.removeprefix("run_ts=")) for x in found if x.startswith("run_ts=")), default=None)


def load_run(spark: SparkSession, root: str, name: str, run_ts: int | None = None) -> DataFrame:
    """The rows of a run, the latest by default."""
    ts = latest_run(spark, root, name) if run_ts is None else run_ts
    return spark.read.parquet(f"{root}/{name}/run_ts={ts}")


def crashed(plan: DataFrame, done: DataFrame) -> DataFrame:
    """The planned experiments of which no row came back."""
    return plan.join(done.select("xp_id").distinct(), "xp_id", "left_anti")


def compacted(spark: SparkSession, root: str, name: str, run_ts: int, files: int) -> int:
    """Write the run again in fewer files, as a run of its own; gives its number."""
    new = max(latest_run(spark, root, name), run_ts) + 1
    load_run(spark, root, name, run_ts).coalesce(files).write.parquet(f"{root}/{name}/run_ts={new}")
    return new


def job_folders(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the folders under ``root`` whose names are numbers, in order: one a job."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(x) for x in (p.getPath().getName() for p in fs.listStatus(path)) if x.isdigit())


def overwritten(spark: SparkSession, xps: DataFrame, root: str, name: str, run_ts: int) -> None:
    """Put ``xps`` in place of a run: written beside it first, so the old rows may be read for it; then the old run is put
    aside, the new one in its place, and the old one deleted. Whatever fails on the way, one of both is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    here, new, aside = (hadoop.Path(f"{root}/{name}/{x}") for x in (f"run_ts={run_ts}", f"_new_{run_ts}", f"_old_{run_ts}"))
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    restored(spark, root, name, run_ts)
    xps.write.mode("overwrite").parquet(new.toString())
    if fs.exists(here) and not fs.rename(here, aside):
        raise OSError(f"could not put {here.toString()} aside")
    if not fs.rename(new, here):
        restored(spark, root, name, run_ts)
        raise OSError(f"could not rename {new.toString()}")
    fs.delete(aside, True)


def restored(spark: SparkSession, root: str, name: str, run_ts: int) -> bool:
    """Bring back a run that an overwrite had put aside when it broke off; whether there was one."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    here, aside = hadoop.Path(f"{root}/{name}/run_ts={run_ts}"), hadoop.Path(f"{root}/{name}/_old_{run_ts}")
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(aside):
        return False
    if fs.exists(here):  # the new run is whole: only the old one's deletion is open
        fs.delete(aside, True)
        return False
    return fs.rename(aside, here)

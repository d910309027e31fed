"""Runs of a labelled table: each writer claims a number of its own, and a run is there once it is whole."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

#: Below a table's folder: a file for each number that is claimed, and for each run that is whole.
MARKS = "_runs"


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def _create_new(spark: SparkSession, path: str) -> bool:
    """Creates an empty file unless it is there: of several that try, one has it."""
    fs, at = _at(spark, path)
    fs.mkdirs(at.getParent())
    if fs.getScheme() == "file":  # where Hadoop's own check and creation are two steps
        try:
            os.close(os.open(at.toUri().getPath(), os.O_CREAT | os.O_EXCL))
            return True
        except FileExistsError:
            return False
    try:
        fs.create(at, False).close()
        return True
    except Exception:
        if fs.exists(at):
            return False
        raise


def _numbers(spark: SparkSession, path: str, mark: str) -> list[int]:
    found = (re.fullmatch(rf"(\d+)\.{mark}", n) for n in _names(spark, f"{path}/{MARKS}"))
    return sorted(int(m[1]) for m in found if m)


def claim_run(spark: SparkSession, path: str) -> int:
    """A run number that no other writer has or gets: from 1, the next after all that are claimed."""
    number = max(_numbers(spark, path, "claim"), default=0) + 1
    while not _create_new(spark, f"{path}/{MARKS}/{number}.claim"):
        number += 1
    return number


def runs(spark: SparkSession, path: str) -> list[int]:
    """The runs that are whole. What a writer that died has left is none."""
    return _numbers(spark, path, "done")


def write_labelled(df: DataFrame, path: str, by: str | None = None) -> int:
    """Writes a labelled table as a run of its own and gives the run's number; columns named __* are dropped.

    The rows are written first and the mark that makes the run count last, so readers never see a part of it.
    """
    spark = df.sparkSession
    number = claim_run(spark, path)
    out = df.drop(*[c for c in df.columns if c.startswith("__")])
    (out.write.partitionBy(by) if by else out.write).mode("errorifexists").parquet(f"{path}/run_id={number}")
    if not _create_new(spark, f"{path}/{MARKS}/{number}.done"):
        raise OSError(f"run {number} is there already")
    return number


def read_run(spark: SparkSession, path: str, number: int) -> DataFrame:
    """One run, with its run_id. Files of other runs aren't opened."""
    return spark.read.option("basePath", path).parquet(f"{path}/run_id={number}")


def newest_run(spark: SparkSession, path: str, by: str | None = None) -> DataFrame | None:
    """The newest run, or of each category the newest that has it if `by` names the column; None where there is no run.

    Which files that are is told by names of folders alone: no other file is opened, and no job looks for the latest.
    """
    there = runs(spark, path)
    if not there:
        return None
    if by is None:
        return read_run(spark, path, there[-1])
    newest: dict[str, int] = {}
    for number in there:
        newest |= {n: number for n in _names(spark, f"{path}/run_id={number}") if n.startswith(f"{by}=")}
    folders = [f"{path}/run_id={number}/{name}" for name, number in sorted(newest.items())]
    # runs may have different columns; only the files that are read are asked for theirs
    return spark.read.option("basePath", path).option("mergeSchema", True).parquet(*folders)

"""What a session needs before Python functions run on its executors."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_local: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, wherever the driver imported it from."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's path in the one that driver and executors share (spark.checkpoint.dir). Only a local session may do without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def make_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


def remove_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: A table of one file below this is dealt to all cores.
ONE_FILE = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table that is one small file, dealt to all cores: else one task has it, however much work its rows are.

    Any other table stays as it is read, without a shuffle.
    """
    files = df.inputFiles()
    if len(files) != 1:
        return df
    size = df.sparkSession.read.format("binaryFile").load(files[0]).select("length").first()[0]
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < ONE_FILE else df

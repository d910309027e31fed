"""What the operators of this subpackage share: tables, scratch tables, skew-safe joins, prefix sums."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.session import ship, spread  # noqa: F401  the operators take ship from here

#: Keys with more than 1/HOT_KEYS of all rows: there are fewer than HOT_KEYS of them. Parts that each is dealt to.
HOT_KEYS, HOT_PARTS = 4096, 64
#: Rows of one block in prefix_sums().
BLOCK_ROWS = 2000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_scratch: dict[str, str] = {}
#: The folder of the run that scratch tables are made for, in this thread.
_owner: ContextVar[str | None] = ContextVar("owner", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; F.lower would also change other letters."""
    return F.translate(text, _UPPER, _LOWER)


def hash32(text: Column) -> Column:
    """32 bits of the text's MD5 as a long: a hash that other SQL engines have too."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a local session may do without it."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _scratch.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{_owner.get() or scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: it is computed once, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@dataclass
class Settled:
    """Rows that are written to a folder of their own, until drop()."""

    rows: DataFrame
    path: str

    def drop(self) -> None:
        remove(self.rows.sparkSession, self.path)


def settled(spark: SparkSession, build: Callable[[], DataFrame], label: str) -> Settled:
    """build()'s rows, written. What build() makes goes to a folder that this run owns, and that folder goes then.

    Other runs, also those of other threads meanwhile, have folders of their own.
    """
    path = fresh_path(spark, label)
    before = _owner.set(own := f"{path}-run")
    try:
        rows = build()
        rows.write.parquet(path)
    finally:
        _owner.reset(before)
        remove(spark, own)
    return Settled(spark.read.schema(rows.schema).parquet(path), path)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores as it takes to be no column of df, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of their own for rows, and that column's name: doc_ids may be null or repeat."""
    row = free_name(docs, "__row")
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def attach_by_key(facts: DataFrame, dims: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of facts with dims (one row a key; `size`: the key's rows in facts), without a task for a hot key.

    Keys above total / HOT_KEYS rows are fewer than HOT_KEYS, whatever the input. Their facts are dealt to HOT_PARTS
    parts by a hash of the row, and their dims row is copied to each part. All others have one part. dims are read
    twice and should be materialised; facts have no map columns.
    """
    hot = [r[0] for r in dims.filter(F.col(size) > max(1, -(-total // HOT_KEYS))).select(key).limit(HOT_KEYS).collect()]
    parts = F.when(F.col(key).isin(hot), HOT_PARTS).otherwise(1) if hot else F.lit(1)
    salted = facts.withColumn("__part", F.pmod(F.xxhash64(*facts.columns), parts).cast("int"))
    dealt = dims.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return salted.join(dealt, [key, "__part"]).drop("__part")


def blocks_for(total: int) -> int:
    return max(1, total // BLOCK_ROWS)


def prefix_sums(df: DataFrame, group: list[str], block: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` (long) over the rows of the same group before this one, by block and order.

    The columns of group and block hold no nulls. A group of any size is spread over its blocks: block totals are summed first, their running sums are added to
    sums within each block. No task gets more than a block, or one row for each block of a group.
    """
    df = df.withColumn("__value", value)
    over_blocks = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    in_block = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, block).agg(F.sum("__value").alias("__total"))
    starts = totals.withColumn("__start", F.coalesce(F.sum("__total").over(over_blocks), F.lit(0))).drop("__total")
    return df.join(starts, [*group, block]).withColumn(out, F.col("__start") + F.coalesce(F.sum("__value").over(in_block), F.lit(0))).drop("__start", "__value")


def arrow_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each key of a task's rows, which are sorted by keys. A key's rows fit in memory together."""
    held: list[pa.RecordBatch] = []
    name: tuple | None = None
    for batch in batches:
        own = [batch.column(k).to_pylist() for k in keys]
        names = list(zip(*own))
        lo = 0
        for i in range(1, len(names) + 1):
            if i == len(names) or names[i] != names[lo]:
                if held and names[lo] != name:
                    yield name, pa.Table.from_batches(held)
                    held = []
                name = names[lo]
                held.append(batch.slice(lo, i - lo))
                lo = i
    if held:
        yield name, pa.Table.from_batches(held)

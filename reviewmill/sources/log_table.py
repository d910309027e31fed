"""The request log by day: retention drops whole days by name and writes one day anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import Snapshots

#: Snapshots that are kept.
KEPT = 2


def _write(rows: DataFrame, path: str, version: int) -> None:
    """rows with their day, as a version; a day of any size is many files."""
    rows.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{path}/v={version}")


def _days(rows: DataFrame) -> list[str]:
    """The days of rows as their folders name them: as many as a log has days."""
    return [r[0] or "__HIVE_DEFAULT_PARTITION__" for r in rows.select("day").distinct().collect()]


def append_log(log: DataFrame, path: str) -> None:
    """Adds requests to the log in path: the days that they are of are written anew, the others stay as they lie.

    Rows without a time have a part of their own. One writer at a time; what a writer that died has left is in no snapshot.
    """
    snapshots = Snapshots(log.sparkSession, path, "day")
    numbers, where = snapshots.numbers(), snapshots.where()
    number = max(numbers, default=-1) + 1
    rows = log.withColumn("day", F.to_date("created_at").cast("string")).persist()
    try:
        days = _days(rows)
        if not days:
            return
        old = snapshots.read({d: v for d, v in where.items() if d in days})
        _write(rows if old is None else rows.unionByName(old.withColumn("day", F.col("day").cast("string")), allowMissingColumns=True), path, number)
        snapshots.commit(number, where | dict.fromkeys(days, number))
        snapshots.prune([*numbers, number][-KEPT:])
    finally:
        rows.unpersist()


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The log as its newest snapshot has it; None where there is none."""
    rows = Snapshots(spark, path, "day").read()
    return None if rows is None else rows.drop("day")


def delete_before(spark: SparkSession, path: str, moment: str) -> int:
    """Deletes the requests before a moment (yyyy-MM-dd HH:mm:ss, of the session's time zone); how many went.

    Whole days are left out of the next snapshot: their rows are counted by the files' footers and not read. The day
    of the moment is written anew. The next snapshot counts once it is whole, and only then the files go: a
    writer that dies before has deleted nothing, one that dies after leaves files that the next one removes.
    """
    snapshots = Snapshots(spark, path, "day")
    numbers, where, last = snapshots.numbers(), snapshots.where(), moment[:10]
    gone = {d: v for d, v in where.items() if d < last}
    dropped = snapshots.read(gone).count() if gone else 0  # no column is read
    number, left = max(numbers, default=-1) + 1, {d: v for d, v in where.items() if d >= last}
    if last in where:
        rows = snapshots.read({last: where[last]}).withColumn("day", F.lit(last))
        old = rows.filter(F.col("created_at") < F.lit(moment).cast("timestamp")).count()
        if old:
            _write(rows.filter(F.col("created_at") >= F.lit(moment).cast("timestamp")), path, number)
            kept = snapshots.exists(number, last)
            left = {d: v for d, v in left.items() if d != last} | ({last: number} if kept else {})
            dropped += old
    if dropped:
        snapshots.commit(number, left)
    snapshots.prune([number] if dropped else numbers[-1:])
    return dropped

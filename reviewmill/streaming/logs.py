"""The same questions on streams: request rates, ledger upserts, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import KEY, upsert_downloads
from ..sources.snapshots import Snapshots


def request_windows(log: DataFrame, size: str = "5 minutes", slide: str | None = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Requests by window and status code. On a stream, the watermark bounds the state and drops what is later."""
    span = F.window("created_at", size, slide) if slide else F.window("created_at", size)
    counts = log.withWatermark("created_at", late).groupBy(span.alias("w"), "status_code").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("response_time"), 6).alias("avg_time"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "status_code", "n", "avg_time")


#: Parts of a ledger by a hash of the key; snapshots that are kept.
BUCKETS, KEPT = 64, 2


def upsert_stream(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the ledger of download results, see merge_batch(). A batch that runs again changes nothing, also under a new checkpoint."""
    return results.writeStream.foreachBatch(lambda batch, _: merge_batch(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_batch(batch: DataFrame, path: str) -> None:
    """Writes the next snapshot of the ledger in path: the latest row of each key, of the last snapshot and the batch.

    Only the buckets with keys of the batch are written anew, to path/v=<snapshot>; path/_snapshots/<snapshot>.json
    says where each bucket is, and a snapshot counts once it stands there. Snapshots are numbered by the store, so a
    new checkpoint goes on after the last. Older ones than KEPT, and buckets that none of the kept names, are removed.
    One stream writes to a ledger at a time.
    """
    spark = batch.sparkSession
    bucketed = batch.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int")).persist()
    try:
        touched = [r[0] for r in bucketed.select("bucket").distinct().collect()]  # BUCKETS at most
        if not touched:
            return
        snapshots = Snapshots(spark, path, "bucket")
        numbers, where = snapshots.numbers(), snapshots.where()
        number = numbers[-1] + 1 if numbers else 0
        old = snapshots.read({b: v for b, v in where.items() if int(b) in touched})
        merged = upsert_downloads(bucketed.limit(0) if old is None else old.select(*bucketed.columns), bucketed)
        # what an attempt that failed has left behind is overwritten: no snapshot names it
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={number}")
        where |= {str(b): number for b in touched}
        snapshots.commit(number, where)
        snapshots.prune([*numbers, number][-KEPT:])
    finally:
        bucketed.unpersist()


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest snapshot; None where there is none."""
    rows = Snapshots(spark, path, "bucket").read()
    return None if rows is None else rows.drop("bucket")

"""The ledger as a bucketed table: a batch of results meets it without moving it.

A ledger is a view over its newest version, a table bucketed and sorted by the key. A batch is shuffled into the ledger's buckets;
the ledger's side of the join is read as it lies, and each task writes the bucket that it has read. The view is replaced
once the new version is whole, so readers see one version or the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import KEY, latest_downloads

#: Buckets of a ledger: its files, and tasks of an upsert.
BUCKETS = 64


def _write_version(rows: DataFrame, name: str, path: str, buckets: int) -> str:
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    rows.write.bucketBy(buckets, *KEY).sortBy(*KEY).format("parquet").option("path", f"{path}/{table}").saveAsTable(table)
    return table


def _show(spark: SparkSession, name: str, table: str, buckets: int) -> None:
    # the version's name and buckets stand in the view's comment
    spark.sql(f"create or replace view {name} comment '{table} {buckets}' as select * from {table}")


def version_of(spark: SparkSession, name: str) -> tuple[str, int]:
    """The table that holds a ledger now, and its buckets."""
    rows = {r.col_name: r.data_type for r in spark.sql(f"describe table extended {name}").collect()}
    table, buckets = rows["Comment"].split()
    return table, int(buckets)


def create_ledger(downloads: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """A new ledger of the last row of each key of downloads, in tables below path."""
    spark = downloads.sparkSession
    _show(spark, name, _write_version(latest_downloads(downloads).repartition(buckets, *KEY), name, path, buckets), buckets)
    return spark.table(name)


def merged(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger (a row a key) after new results: only the new ones are shuffled if the ledger is bucketed."""
    rest = [c for c in ledger.columns if c not in KEY]
    fresh = latest_downloads(new).select(*KEY, F.struct("created_at", "seq").alias("__at"), F.struct(*rest).alias("__new"))
    both = ledger.select(*KEY, F.struct("created_at", "seq").alias("__was"), F.struct(*rest).alias("__old")).join(fresh.hint("merge"), KEY, "full_outer")
    later = F.when(F.col("__was").isNull() | (F.col("__at") >= F.col("__was")), F.col("__new")).otherwise(F.col("__old"))
    return both.withColumn("__row", later).select(*[f"__row.{c}" if c in rest else c for c in ledger.columns])


def upsert_ledger(new: DataFrame, name: str, path: str) -> DataFrame:
    """Upserts results into a ledger: a new version, then the view, then the old version goes. Replays change nothing.

    Keys aren't null. One writer at a time; a writer that dies leaves a table that no view names.
    """
    spark = new.sparkSession
    old, buckets = version_of(spark, name)
    _show(spark, name, _write_version(merged(spark.table(old), new), name, path, buckets), buckets)
    location = spark.sql(f"describe table extended {old}").filter("col_name = 'Location'").first().data_type
    spark.sql(f"drop table {old}")
    at = spark._jvm.org.apache.hadoop.fs.Path(location)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return spark.table(name)


def drop_ledger(spark: SparkSession, name: str) -> None:
    """Forgets a ledger; its files stay."""
    table, _ = version_of(spark, name)
    spark.sql(f"drop view {name}")
    spark.sql(f"drop table {table}")

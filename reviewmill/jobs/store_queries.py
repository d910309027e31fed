"""Queries on files that Spark makes of the benchmark's rows: images, runs, retention."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import images, ledger
from ..sources import ledger_table, log_table, runs
from ..sources.session import make_folder, remove_folder, shared_folder, ship
from ..sources.tables import read_images, report, write_report
from .bindings import AS_OF, bound, ctes, table

#: Kinds of the files of parts, in turn.
KINDS = ("png", "jpg", "webp", "cut png", "text jpg", "gone bad jpg", "padded png")


def image_bytes(kind: str, width: int, height: int, filler: int) -> bytes:
    """A file of the least that makes it an image, with `filler` bytes in the middle."""

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"tEXt", b"x" * filler) + chunk(b"IEND", b"")
    app = lambda n: b"\xff\xe1" + struct.pack(">H", n + 2) + b"y" * n
    jpg = b"\xff\xd8" + app(min(filler, 60_000)) + app(9) + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, height, width, 3) + b"z" * filler + b"\xff\xd9"
    webp = b"VP8X" + struct.pack("<I", 10) + b"\0\0\0\0" + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little") + b"w" * filler
    webp = b"RIFF" + struct.pack("<I", len(webp) + 4) + b"WEBP" + webp
    return {"png": png, "jpg": jpg, "webp": webp, "cut png": png[:-6], "text jpg": b"not an image", "gone bad jpg": jpg[:-1], "padded png": png + b"\0" * 300}[kind]


def _write_images(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                kind = KINDS[r["p_partkey"] % len(KINDS)]
                data = image_bytes(kind, 60 + r["p_size"] * 4, 90 + r["p_size"], r["p_partkey"] % 97 * 300)
                at = f"{root}/{r['p_partkey'] % 20}"
                store.create_dir(at, recursive=True)
                with store.open_output_stream(f"{at}/{r['p_partkey']}.{kind.split()[-1]}", compression=None) as out:
                    out.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], ["n"])

    return run


IMAGES_SQL = f"""with made as (select p_partkey, 60 + p_size * 4 as width, 90 + p_size as height, p_partkey % {len(KINDS)} in (0, 1, 2, 6) as whole from part)
select p_partkey, case when whole then width end as width, case when whole then height end as height,
  case when not whole then 'corrupt' when width < {images.LEAST_SIDE} or height < {images.LEAST_SIDE} then 'small' else 'valid' end as status, true as bounded
from made"""

IMAGE_REPORT_SQL = f"""with checked as ({IMAGES_SQL}),
counts as (select count(*) as total, count(*) filter (status = 'valid') as valid, count(*) filter (status <> 'valid') as corrupt, count(*) filter (status = 'small') as small from checked)
select *, case when total > 0 then round(valid * 100 / total, 1) else 0.0 end as valid_percent, case when total > 0 then round(corrupt * 100 / total, 1) else 0.0 end as corrupt_percent from counts"""


#: Parts whose image files lie in the shared folder at a time: 16 KB each on average, 60 KB at most.
PORTION = 20_000


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on an image file of each part, written by tasks to the shared folder and found there.

    Files lie there a portion of the parts at a time, so they take the same space and the same list of the driver's for
    any number of parts. A portion goes once its verdicts are written; these stay. The table is dealt to portions once.
    """
    ship(spark)
    root, cores = shared_folder(spark, "images"), spark.sparkContext.defaultParallelism
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long"), F.col("p_size").cast("long"))
    n = max(1, math.ceil(parts.count() / PORTION))
    parts = parts.withColumn("portion", F.pmod(F.xxhash64("p_partkey"), F.lit(n)).cast("int"))
    parts.repartition("portion").write.partitionBy("portion").parquet(f"{root}/parts")
    dealt = spark.read.schema(parts.schema).parquet(f"{root}/parts")
    for i in range(n):
        folder = f"{root}/{i}"
        make_folder(spark, folder)
        try:
            own = dealt.filter(F.col("portion") == i).repartition(cores)
            own.mapInArrow(_write_images(folder), "n long").agg(F.sum("n")).collect()
            # the scan makes a task of a few files each, as if it would read them
            checked = images.check_images(read_images(spark, folder).coalesce(cores))
            checked.write.mode("append").parquet(f"{root}/verdicts")
        finally:
            remove_folder(spark, folder)
    return spark.read.schema(checked.schema).parquet(f"{root}/verdicts")


def io6_h4_image_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and status of every part's image file, of which some kilobytes are read at most."""
    key = F.regexp_extract("path", r"/(\d+)\.\w+$", 1).cast("int")
    most = images.HEAD + images.TAIL + 9 * images.SEGMENTS
    return _checked(spark, sf_dir).select(key.alias("p_partkey"), "width", "height", "status", (F.col("n_read") <= most).alias("bounded"))


def a18_image_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.image_report(_checked(spark, sf_dir))


# the ledger as a bucketed table -----------------------------------------------------------------------------------------


def _bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of half of the results, upserted in its buckets by the other half and then by some of the first again."""
    results, path = bound(spark, sf_dir, "downloads"), shared_folder(spark, "ledger")
    name = "ledger_" + path[-32:]
    first = F.pmod(F.xxhash64("asin", "image_url", "seq"), F.lit(2)) == 0
    ledger_table.create_ledger(results.filter(first), name, path, 8)
    ledger_table.upsert_ledger(results.filter(~first), name, path)
    return ledger_table.upsert_ledger(results.filter(first & (F.col("file_size") > 25000)), name, path)


def u7_bucketed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucketed(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("total_size"))


def j8_bucketed_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results without a success in the ledger: the ledger's side of the join isn't shuffled."""
    return ledger.pending(bound(spark, sf_dir, "downloads"), _bucketed(spark, sf_dir)).select("asin", "image_url", "seq")


# retention --------------------------------------------------------------------------------------------------------------

_CUTOFF = "2024-01-13 00:00:00"
_MIDDAY = "2024-01-12 13:30:00"
RETENTION_SQL = f"""with {ctes('requests')}
select count(*) filter (created_at < timestamp '{_MIDDAY}')::bigint as first_dropped, count(*) filter (created_at >= timestamp '{_MIDDAY}' and created_at < timestamp '{_CUTOFF}')::bigint as then_dropped,
  count(*) filter (created_at >= timestamp '{_CUTOFF}')::bigint as kept, coalesce(sum(event_id) filter (created_at >= timestamp '{_CUTOFF}'), 0)::bigint as kept_ids from requests"""


def pf12_delete_old_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log by day, of which all before a midday and then all before a day go: what the deletions say, and what is left."""
    path = shared_folder(spark, "requests")
    log_table.append_log(bound(spark, sf_dir, "requests").withColumn("created_at", F.col("created_at").cast("timestamp")), path)
    dropped = [log_table.delete_before(spark, path, moment) for moment in (_MIDDAY, _CUTOFF)]
    left = log_table.read_log(spark, path)
    if left is None:
        left = bound(spark, sf_dir, "requests").limit(0)
    row = left.agg(F.count(F.lit(1)).alias("kept"), F.coalesce(F.sum("event_id"), F.lit(0)).cast("long").alias("kept_ids"))
    return row.select(*[F.lit(n).cast("long").alias(c) for n, c in zip(dropped, ("first_dropped", "then_dropped"))], "kept", "kept_ids")


# runs -------------------------------------------------------------------------------------------------------------------

RUNS_SQL = """with cells as (select p_partkey, p_brand as category, p_size from part)
select category, case when category < (select max(category) from cells) then 2 else 1 end as run_id, count(*) as n, sum(p_size * case when category < (select max(category) from cells) then 2 else 1 end)::bigint as size
from cells group by category"""


def io7_io8_t6_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs by category, the second without the last one: the newest run of each category."""
    path = shared_folder(spark, "runs")
    cells = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("category"), F.col("p_size").cast("long").alias("size"))
    last = cells.agg(F.max("category")).first()[0]
    runs.write_labelled(cells, path, "category")
    runs.write_labelled(cells.filter(F.col("category") < last).withColumn("size", F.col("size") * 2), path, "category")
    return runs.newest_run(spark, path, "category").groupBy("category", "run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


# report -----------------------------------------------------------------------------------------------------------------

REPORT_SQL = f"""with {ctes('downloads', 'products')}, stats as (select status, count(*) as n, round(avg(download_time), 6) as avg_time, sum(file_size)::bigint as total_size from downloads group by 1)
select '{AS_OF}' as generated_at, (select string_agg(status || ' ' || n || ' ' || round(avg_time * 1000000)::bigint || ' ' || total_size, '; ' order by status) from stats) as by_status,
  (select count(*) from products) as total_products, (select count(distinct asin) from downloads where status = 'success') as products_with_images,
  (select sum(n)::bigint from stats) as total, (select round(sum(total_size) / 1048576.0, 4) from stats) as mb"""


def io9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of one row, written as JSON and read back."""
    path = shared_folder(spark, "report")
    row = report(bound(spark, sf_dir, "downloads"), bound(spark, sf_dir, "products"), AS_OF)
    write_report(row, path)
    back = spark.read.schema(row.schema).json(path)
    entries = F.transform(F.array_sort(F.map_entries("by_status")), lambda e: F.concat_ws(" ", e["key"], e["value"]["n"], F.round(e["value"]["avg_time"] * 1_000_000).cast("long"), e["value"]["total_size"]))
    return back.withColumn("by_status", F.array_join(entries, "; "))

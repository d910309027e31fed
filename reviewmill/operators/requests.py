"""Reports on the request log: url, status_code, response_time, error_type, created_at. `as_of` stands for now."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.session import ship


def _moment(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def retained(log: DataFrame, as_of: str, days: int) -> DataFrame:
    """Rows of the last days. The bound is a constant, so it reaches the scan."""
    return log.filter(F.col("created_at") >= _moment(as_of) - F.make_dt_interval(F.lit(days)))


def retention_counts(log: DataFrame, as_of: str, days: int) -> DataFrame:
    old = F.col("created_at") < _moment(as_of) - F.make_dt_interval(F.lit(days))
    return log.agg(F.count_if(old).alias("dropped"), F.count_if(~old).alias("kept"))


def status_codes(log: DataFrame, as_of: str, minutes: int = 60) -> DataFrame:
    """Requests by status code in the last minutes."""
    recent = (F.col("created_at") > _moment(as_of) - F.make_dt_interval(mins=F.lit(minutes))) & (F.col("created_at") <= _moment(as_of))
    return log.filter(recent).groupBy("status_code").agg(F.count(F.lit(1)).alias("n"))


def request_rates(log: DataFrame, as_of: str, spans: list[int]) -> DataFrame:
    """Requests a minute over the last N minutes, for several N in one pass over the longest."""
    since = lambda m: F.col("created_at") > _moment(as_of) - F.make_dt_interval(mins=F.lit(m))
    row = log.filter(since(max(spans)) & (F.col("created_at") <= _moment(as_of))).agg(*[F.count_if(since(m)).alias(f"n{m}") for m in spans])
    each = F.array(*[F.struct(F.lit(m).alias("minutes"), F.col(f"n{m}").alias("n")) for m in spans])
    return row.select(F.explode(each).alias("x")).select("x.minutes", "x.n", F.round(F.col("x.n") / F.col("x.minutes"), 6).alias("per_minute"))


#: Rows of the sample from which bounds between parts are taken, for each part, and in all.
SAMPLED, MOST_SAMPLED = 200, 1_000_000


class Bounds:
    """Bounds between parts of rows in order of (key's hash, time)."""

    def __init__(self, sample: list[tuple[int, int]], parts: int):
        rows = sorted(sample)
        some = [rows[i * len(rows) // parts] for i in range(1, parts)] if rows else []
        self.keys, self.times = (np.array([r[i] for r in some], np.int64) for i in (0, 1))

    def part_of(self, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Number of bounds below each row: rows of one key and time are of one part."""
        first, last = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        part = first.astype(np.int32)
        for k in np.unique(keys[last > first]):  # keys that bounds go through: each has a part's share of all rows
            own = keys == k
            lo, hi = np.searchsorted(self.keys, k, "left"), np.searchsorted(self.keys, k, "right")
            part[own] = lo + np.searchsorted(self.times[lo:hi], times[own], "left")
        return part


def _counted(rows: pa.Table, micros: int) -> pa.Array:
    """For each real row of a part, sorted by key and time, the rows of its key in the `micros` up to it, ties among them.

    kind: 0 real, 1 of an earlier part, 2 a number (at) of rows of earlier parts that every row of the key in this part sees.
    """
    n = rows.num_rows
    kind, at = rows.column("__kind").to_numpy(), rows.column("__at").to_numpy()
    key = rows.column("__key").combine_chunks().dictionary_encode()
    code = key.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    cuts = np.concatenate([[0], np.flatnonzero(code[1:] != code[:-1]) + 1, [n]])
    out = np.zeros(n, np.int64)
    for lo, hi in zip(cuts, cuts[1:]):
        own, real = kind[lo:hi], kind[lo:hi] == 0
        times = np.sort(at[lo:hi][own < 2])
        now = at[lo:hi][real]
        more = int(at[lo:hi][own == 2].sum())
        out[lo:hi][real] = np.searchsorted(times, now, "right") - np.searchsorted(times, now - micros, "left") + more
    return pa.array(out)


def over_limit(log: DataFrame, key: str, most: int = 30, seconds: int = 60) -> DataFrame:
    """Requests with the number of the same key in the seconds up to each (in_span), and whether that is over the limit.

    The log is cut into parts in order of key and time, so a key of many requests, or a burst of one, is many parts.
    What a part has to know of earlier ones is little: the rows whose `seconds` end in it, one by one, and how many
    rows' seconds reach beyond it. So each request goes to its part and to one more at most, and where parts are
    longer than `seconds`, only what is near their ends. Requests of one key and microsecond are of one part.
    Requests without a time see each other; a null key is a key.
    """
    spark = log.sparkSession
    ship(spark)
    parts, micros = int(spark.conf.get("spark.sql.shuffle.partitions")), seconds * 1_000_000
    told = [F.xxhash64(key).alias("__hash"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("__at")]
    timed = log.filter("created_at is not null")
    share = min(1.0, min(SAMPLED * parts, MOST_SAMPLED) / max(1, timed.count()))
    bounds = spark.sparkContext.broadcast(Bounds([tuple(r) for r in timed.select(*told).sample(share, 5).collect()], parts))

    @F.arrow_udf("int")
    def part(keys: pa.Array, times: pa.Array) -> pa.Array:
        return pa.array(bounds.value.part_of(keys.to_numpy(), times.to_numpy()))

    rows = timed.withColumn("__key", F.col(key)).withColumns({"__hash": told[0], "__at": told[1]}).withColumn("__part", part("__hash", "__at")).withColumn("__kind", F.lit(0))
    ends = rows.select("__key", "__hash", "__at", "__part", part("__hash", F.col("__at") + micros).alias("__end")).filter("__end > __part")
    near = ends.select("__key", "__hash", "__at", F.col("__end").alias("__part"), F.lit(1).alias("__kind"))
    # how many rows see over a part: counts by where they are and where their seconds end
    over = ends.filter("__end > __part + 1").groupBy("__key", "__hash", "__part", "__end").agg(F.count(F.lit(1)).alias("__at"))
    over = over.select("__key", "__hash", "__at", F.explode(F.sequence(F.col("__part") + 1, F.col("__end") - 1)).alias("__part"), F.lit(2).alias("__kind"))
    met = rows.unionByName(near, allowMissingColumns=True).unionByName(over, allowMissingColumns=True)
    # sorted by key too: different keys may have one hash
    met = met.repartitionById(parts, "__part").sortWithinPartitions("__hash", "__key", "__kind")
    names = [f.name for f in log.schema]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held)
            real = pc.equal(table.column("__kind"), 0)
            yield from table.select(names).append_column("in_span", _counted(table, micros)).filter(real).to_batches(10_000)

    schema = StructType([*log.schema.fields, StructField("in_span", LongType())])
    counted = met.mapInArrow(count, schema)
    lost = log.filter("created_at is null")
    alike = lost.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("in_span"))
    lost = lost.join(alike, F.col(key).eqNullSafe(F.col("__key"))).select(*names, "in_span")
    return counted.unionByName(lost).withColumn("over", F.col("in_span") > most)

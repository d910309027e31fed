"""Distinct products over any span of days, from small sketches that are kept by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logarithm of a sketch's buckets. An estimate's standard error is 0.83 / sqrt(2 ** LG_BUCKETS), 0.65 %: one in 20 million is off by more than ERROR.
LG_BUCKETS, ERROR = 14, 0.035


def daily_sketches(downloads: DataFrame) -> DataFrame:
    """day, products and with_images: sketches of the ids of a day, and of those with a success. Tasks sketch what they have read.

    A day's later rows can be sketched on their own and merged by merged_sketches(). Rows without a time have a null day.
    """
    some = F.when(F.col("status") == "success", F.col("asin"))
    sketch = lambda c: F.hll_sketch_agg(c, LG_BUCKETS)
    return downloads.groupBy(F.to_date("created_at").alias("day")).agg(sketch(F.col("asin")).alias("products"), sketch(some).alias("with_images"))


def merged_sketches(sketches: DataFrame, *by: Column | str) -> DataFrame:
    """Sketches of the same shape for groups of days, or for all."""
    return sketches.groupBy(*by).agg(*[F.hll_union_agg(c).alias(c) for c in ("products", "with_images")])


def distinct_counts(sketches: DataFrame, *by: Column | str) -> DataFrame:
    """Estimated numbers of products and of those with images, of groups of days or of all: whole numbers, within ERROR."""
    found = merged_sketches(sketches, *by)
    return found.withColumns({c: F.hll_sketch_estimate(c) for c in ("products", "with_images")})


def over_span(sketches: DataFrame, first: str, last: str) -> DataFrame:
    """distinct_counts() of the days from first to last (yyyy-MM-dd): only sketches are read."""
    return distinct_counts(sketches.filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))))

"""How often each label occurs: one pass for all headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cut_tags

TOTAL = "总计"


def unpivot_tags(labelled: DataFrame, headers: list[str]) -> DataFrame:
    """A row for each tag of each cell: dimension, tag. Headers that the table lacks are passed over."""
    present = [h for h in headers if h in labelled.columns]
    cells = F.array(*[F.struct(F.lit(h).alias("dimension"), cut_tags(F.col(f"`{h}`")).alias("tags")) for h in present])
    return labelled.select(F.explode(cells).alias("c")).select("c.dimension", F.explode("c.tags").alias("tag"))


def tag_pivot(labelled: DataFrame, headers: list[str], totals: bool = False) -> DataFrame:
    """dimension, tag, n, share (percent of the dimension's tags, 2 decimals); with totals, a row TOTAL of each.

    Counts are made in the map tasks first, so a common tag is no skew; shares are made of the counts. A dimension of
    many different tags is many tasks: what it has in all, one row a header, is joined to them.
    """
    counts = unpivot_tags(labelled, headers).groupBy("dimension", "tag").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("dimension").agg(F.sum("n").alias("whole"))
    out = counts.join(F.broadcast(whole), "dimension").select("dimension", "tag", "n", F.round(F.col("n") * 100 / F.col("whole"), 2).alias("share"))
    if totals:
        ends = counts.groupBy("dimension").agg(F.sum("n").alias("n")).select("dimension", F.lit(TOTAL).alias("tag"), "n", F.lit(100.0).alias("share"))
        out = out.unionByName(ends)
    return out


def ordered(pivot: DataFrame) -> DataFrame:
    return pivot.orderBy("dimension", F.desc("n"), "tag")


def rollup_counts(labelled: DataFrame, headers: list[str]) -> DataFrame:
    """Counts of tags and of dimensions by one rollup: level 0 is a tag, 1 a dimension's total."""
    tags = unpivot_tags(labelled, headers).rollup("dimension", "tag").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"))
    return tags.filter("level < 3").select("dimension", F.when(F.col("level") == 1, TOTAL).otherwise(F.col("tag")).alias("tag"), "n", F.col("level").cast("int").alias("level"))


def filled_rows(labelled: DataFrame, headers: list[str]) -> DataFrame:
    """Rows with any tag for each configured header; a header that the table lacks is reported as missing."""
    present = [h for h in headers if h in labelled.columns]
    counts = labelled.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.size(cut_tags(F.col(f"`{h}`"))) > 0).alias(f"c{i}") for i, h in enumerate(present)])
    each = [F.struct(F.lit(h).alias("dimension"), F.col(f"c{present.index(h)}").alias("filled"), F.lit(False).alias("missing")) if h in present else F.struct(F.lit(h).alias("dimension"), F.lit(0).cast("long").alias("filled"), F.lit(True).alias("missing")) for h in headers]
    return counts.select("n_rows", F.explode(F.array(*each)).alias("d")).select("d.*", "n_rows")

"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach_by_key, blocks_for, free_name, hash32, materialise, numbered, prefix_sums

#: Weights of the sources in code-point order, repeating; and the mix's size as a fraction of all sizes.
WEIGHTS, SHARE_NUM, SHARE_DEN, MOST_COPIES = (3, 1, 2), 3, 2, 2
#: Expected copies are whole numbers of this part of a copy, so that prefix sums are exact.
UNIT = 1_000_000

_WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """sizes: source, source_size. Adds weight and target.

    A target is its weight times the level at which the capped targets add up to the whole: what sources above twice
    their size leave is shared by weight among the others, until none is above. One row a source goes through the
    two windows, never a document.
    """
    by_name, all_rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS)))
    weight = F.when(turn == 0, WEIGHTS[0]).when(turn == 1, WEIGHTS[1]).otherwise(WEIGHTS[2]).cast("long")
    cap = F.col("source_size") * MOST_COPIES
    ranked = sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("whole", F.sum("source_size").over(all_rows))
    # in the order in which sources meet their cap as the level rises
    rise = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below = F.coalesce(F.sum("cap").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights_left = F.sum("weight").over(rise.rowsBetween(0, Window.unboundedFollowing))
    # level of the rest, as a fraction num / den, if all sources before this one are capped
    ranked = ranked.withColumn("num", SHARE_NUM * F.col("whole") - SHARE_DEN * below).withColumn("den", SHARE_DEN * weights_left)
    open_ = F.col("cap") * F.col("den") >= F.col("num") * F.col("weight")
    first = F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "num", "den"))).over(all_rows)
    share = F.col("weight") * F.col("level.num") / F.col("level.den")
    return ranked.withColumn("level", first).withColumn("target", F.least(F.col("cap").cast("double"), share))


def _key():
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def systematic_copies(rows: DataFrame, total: int, seed: int = 7) -> DataFrame:
    """Adds `copies` to rows (key, doc_id, size, mark, and expected copies in UNITs).

    Within a key, documents are dealt into blocks by a hash of id and mark (a hash of the text: ids may be null or repeat) and lie in order of size in each block, up and down in
    turn. Expected copies are prefix-summed over that order, one random offset is added, and a document is emitted
    once for each whole copy that the sum passes in it. The offset is a hash of the key and the seed, so all is a
    function of ids, sizes and the seed, and reruns agree.
    """
    block = F.pmod(hash32(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id"), F.col("mark"))), F.lit(blocks_for(total)))
    rows = rows.withColumn("block", block)
    turn = F.when(F.col("block") % 2 == 0, F.col("size")).otherwise(-F.col("size"))
    rows = prefix_sums(rows, ["key"], "block", [turn, F.col("doc_id"), F.col("mark")], F.col("expected"), "before")
    offset = F.pmod(hash32(F.concat_ws(":", F.lit(str(seed)), F.col("key"))), F.lit(UNIT))
    copies = F.expr(f"(offset + before + expected) div {UNIT} - (offset + before) div {UNIT}")
    return rows.withColumn("offset", offset).withColumn("copies", copies).drop("offset", "n_docs")


def mix_plan(docs: DataFrame) -> DataFrame:
    """Copies of every row of docs (doc_id, text, source): doc_id, source, size, source_size, target, copies, taken.

    size: words of the text, 0 for null. An empty document is expected like the others and takes nothing. Sources
    with no words have a target of 0. Rows of a null or repeated doc_id are sampled each on its own. An empty table
    gives an empty one; other columns are not read.
    """
    return _plan(docs)


def _plan(docs: DataFrame, *keys: str) -> DataFrame:
    """mix_plan with further columns of docs."""
    rows = materialise(docs.select("doc_id", *keys, "source", _key().alias("key"), n_words(F.col("text")).alias("size"), hash32(F.coalesce("text", F.lit(""))).alias("mark")), "sizes")
    sizes = rows.groupBy("source", "key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = materialise(source_targets(sizes).select("key", "n_docs", "source_size", "target"), "targets")
    total = rows.count()
    joined = attach_by_key(rows, targets, "key", "n_docs", total)
    expected = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") * UNIT / F.col("source_size") + 0.5)).cast("long")
    out = systematic_copies(joined.withColumn("expected", expected), total)
    return out.select("doc_id", *keys, "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, all their columns."""
    rows, row = numbered(docs)
    plan = _plan(rows.select("doc_id", "text", "source", row), row).filter("copies > 0").select(row, "copies")
    times = free_name(rows, "__times")
    many = rows.join(plan.withColumnRenamed("copies", times), row).withColumn(free_name(rows, "__copy"), F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return many.select(*docs.columns)

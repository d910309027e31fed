"""Exact dedup with a minimal perfect hash over the historical digests.

The index has one row a bucket of digests: the bit sets of a level-by-level minimal perfect hash (Limasset et al.,
2017) and, in slot order, full digests and the locators of their winners. A lookup finds a digest's only slot, then
compares all bytes of the digest there: equal is a repeat, anything else is no member and is grouped on its own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, attach_by_key, free_name, materialise, ship

#: Distinct digests in a bucket, on average: about 0.5 MB of index, whatever the input.
BUCKET_KEYS = 8192
_GAMMA, _LEVELS = 1.5, 128

_INDEX = "bucket int, level_sizes array<int>, bits binary, digests binary, winners array<long>, named array<boolean>, copies array<long>"
_MERGED = "digest binary, keep_id long, named boolean, group_size long, slot int, member boolean"


def digest_of(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256))


def _halves(digests: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    words = np.frombuffer(b"".join(digests), dtype=">u8").reshape(-1, 4).astype(np.uint64)
    return words[:, 1].copy(), words[:, 2].copy()  # the first word chose the bucket


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a ^ np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9) + b
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def build_levels(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Bit set of each level: a key that is alone in its place stays there, the rest go on to the next level."""
    levels: list[np.ndarray] = []
    while len(a):
        if len(levels) == _LEVELS:
            raise ValueError("the keys aren't distinct")
        at = _place(a, b, len(levels), size := max(16, int(_GAMMA * len(a))))
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left = ~alone[at]
        a, b = a[left], b[left]
    return levels


def find_slots(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Slot of each key, 0 to n - 1 and different for the keys of the set; -1 for some that aren't in it."""
    slots, live, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
    for level, alone in enumerate(levels):
        at = _place(a[live], b[live], level, len(alone))
        here = alone[at]
        slots[live[here]] = base + np.cumsum(alone)[at[here]] - 1
        live, base = live[~here], base + int(alone.sum())
    return slots


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    a, b = _halves(pdf.digest)
    levels = build_levels(a, b)
    order = np.argsort(find_slots(levels, a, b))
    pdf = pdf.iloc[order]
    return pd.DataFrame({
        "bucket": [pdf.bucket.iloc[0]], "level_sizes": [[len(x) for x in levels]], "bits": [np.packbits(np.concatenate(levels)).tobytes()],
        "digests": [b"".join(pdf.digest)], "winners": [pdf.last_id.tolist()], "named": [pdf.named.tolist()], "copies": [pdf.n.tolist()],
    })


def build_index(history: DataFrame) -> DataFrame:
    """history: bucket, digest (distinct), last_id, named, n. One row a bucket."""
    return history.groupBy("bucket").applyInPandas(_build, _INDEX)


def _merge(index: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    parts = []
    slots = np.full(len(new), -1, np.int64)
    if len(index):
        row = index.iloc[0]
        cuts = np.cumsum(row.level_sizes)
        bits = np.unpackbits(np.frombuffer(row.bits, np.uint8), count=int(cuts[-1])).astype(bool)
        digests = np.frombuffer(row.digests, dtype="V32")
        last, named, n = np.array(row.winners, np.int64), np.array(row.named, bool), np.array(row.copies, np.int64)
        if len(new):
            slots = find_slots(np.split(bits, cuts[:-1]), *_halves(new.digest))
            asked = np.frombuffer(b"".join(new.digest), dtype="V32")
            slots[digests[slots] != asked] = -1  # all bytes of the slot's digest; a slot of -1 stays as it is
            found = slots >= 0
            at = slots[found]
            last[at] = np.maximum(last[at], new.last_id.to_numpy(np.int64)[found])
            named[at] |= new.named.to_numpy(bool)[found]
            n[at] += new.n.to_numpy(np.int64)[found]
        parts.append(pd.DataFrame({"digest": [d.tobytes() for d in digests], "keep_id": last, "named": named, "group_size": n, "slot": np.arange(len(n)), "member": True}))
    other = new[slots < 0] if len(new) else new
    parts.append(pd.DataFrame({"digest": other.digest, "keep_id": other.last_id, "named": other.named, "group_size": other.n, "slot": -1, "member": False}))
    return pd.concat(parts, ignore_index=True)


def merge_lookup(index: DataFrame, new: DataFrame) -> DataFrame:
    """One row a distinct digest of either side: digest, keep_id (largest id; named: there is one), group_size, slot (-1: none), member."""
    return index.groupBy("bucket").cogroup(new.groupBy("bucket")).applyInPandas(_merge, _MERGED)


def distinct_digests(rows: DataFrame, buckets: int) -> DataFrame:
    """rows: doc_id, digest. Copies are counted before the shuffle, so a text that fills a third of the table is a row a task.

    last_id is the least long where no row of the digest has an id (`named` is false): the pandas side has no null longs.
    """
    bucket = (F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long") % buckets).cast("int")
    return rows.groupBy("digest").agg(F.coalesce(F.max("doc_id"), F.lit(-(2**63))).alias("last_id"), (F.count("doc_id") > 0).alias("named"), F.count(F.lit(1)).alias("n")).withColumn("bucket", bucket)


def exact_groups(docs: DataFrame, history: Column | None = None) -> DataFrame:
    """Group of every row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, slot, in_history.

    Texts are equal when identical after lower-casing A-Z; null is empty. The largest doc_id of a group stays.
    history: which rows are the historical ones whose digests the index holds; by default the lower half of the
    range of ids. The result doesn't depend on it. Rows of a null doc_id are in their text's group and have a null
    `kept`; where a group has no other, keep_id is null. Rows that repeat a doc_id and its text get the same verdict.
    An empty table gives an empty one; other columns are not read.
    """
    ship(docs.sparkSession)
    rows = materialise(docs.select("doc_id", digest_of(F.col("text")).alias("digest")), "digests")
    total, low, high = rows.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    old = F.col("doc_id") < F.lit(((low or 0) + (high or 0)) // 2) if history is None else history
    old = F.coalesce(old, F.lit(False))
    buckets = 2 ** max(0, math.ceil(math.log2(max(1, total) / BUCKET_KEYS)))
    index = materialise(build_index(distinct_digests(rows.filter(old), buckets)), "mph")
    new = distinct_digests(rows.filter(~old), buckets)
    groups = merge_lookup(index, new).withColumn("keep_id", F.when(F.col("named"), F.col("keep_id")))
    groups = materialise(groups, "groups")
    return attach_by_key(rows, groups, "digest", "group_size", total).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "slot", F.col("member").alias("in_history"),
    )


def drop_repeats(docs: DataFrame) -> DataFrame:
    """One row of docs for each text, all its columns: a row of the largest doc_id, or of a null one if there is no other.

    The row is found again by its text and id, so different texts that share a doc_id all stay.
    """
    name = lambda sha: F.concat_ws(":", sha, F.col("doc_id").cast("string"))
    own = free_name(docs, "__name")
    kept = exact_groups(docs).filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(name(F.col("text_sha256")).alias(own))
    named = docs.withColumn(own, name(F.lower(F.hex(digest_of(F.col("text"))))))
    return named.join(kept, own, "left_semi").dropDuplicates([own]).select(*docs.columns)

"""A corpus from documents: toxic and repeated ones go, sources are mixed to target weights, the rest is encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reviewmill.llm import exact_dedup, mixing, near_dups, pieces, toxicity
from reviewmill.llm.common import settled, table
from reviewmill.llm.queries import PIECE_BPE


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a model trained on the labels calls toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps the one with the largest doc_id."""
    return exact_dedup.drop_repeats(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group (sets of five-word shingles, similarity 0.8), keeps the smallest doc_id."""
    return near_dups.drop_near_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their target weights: a document comes as often as it is taken."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document: doc_id, n_tokens, ids."""
    return pieces.encode(docs, public_tokenizers.path(PIECE_BPE))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact), ("near dedup", drop_near), ("source mix", mix), ("pieces", encode)]

#: SQL can't express the trained model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. What a stage has left in the shared folder goes when the next one has its rows."""
    docs, spent = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        now = settled(spark, lambda: stage(spark, docs, sf_dir), name.replace(" ", "-"))  # noqa: B023
        if spent:
            spent.drop()
        docs, spent = now.rows, now
    return STAGES[-1][1](spark, docs, sf_dir)

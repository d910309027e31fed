"""The queries of this subpackage: thin, each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, licenses, mixing, near_dups, packing, pieces, quality, ranking, sharding, tokens, toxicity, warc, whitening
from .common import table

SHARDS = 24
#: File of the word-level tokenizer, and the id that ends a document.
WORD_BPE, END_ID = "word_bpe_49k.json", 2
#: File of the byte-level tokenizer, the id that ends a document, and the most ids of a sequence.
BYTE_BPE, BYTE_END, SEQUENCE = "byte_bpe_50k.json", 0, 2048
#: File of the SentencePiece model.
PIECE_BPE = "piece_bpe_32k.model"


def op1_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("slot", "in_history")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op4_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"))


def op5_toxic_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_docs(docs, model).withColumn("held_out", toxicity.held_out(F.col("doc_id")))


def op6_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op7_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


def op8_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS).withColumn("law", F.lit("key"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_index(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), END_ID)


def op10_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.link(table(spark, sf_dir, "documents"), k=2)


def op11_tput_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op13_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), BYTE_END, SEQUENCE)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")}

"""Registered queries: each operator on its whole table, with the columns that its contract names."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagetrail.llm import chat, decontam, lengths, lexical, mixing, nearcopies, negatives, packing, pii, quality, repeats, toxicity, warc
from stagetrail.llm.common import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    verdict = F.col("quality")
    columns = [*quality.BASE, "base_failed", "kept", "distance"]
    return quality.judged(docs, keep=["doc_id"]).select("doc_id", *[verdict[c].alias(c) for c in columns])


def op2_relational_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    return chat.chat_digest(chat.format_chats(rows.unionByName(own)))


def op3_context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.scores(table(spark, folder, "documents").select("doc_id", "text"))


def op4_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack_best_fit(table(spark, folder, "documents").select("doc_id", "text"), WORD_BPE)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pii_digest(pii.find_pii(table(spark, folder, "documents").select("doc_id", "text")).drop("text"))


def op6_warc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return warc.record_digest(warc.archived(table(spark, folder, "pages")))


def op7_template_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.leaks(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))


def op8_suffix_arrays(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.repeats_digest(repeats.without_repeats(table(spark, folder, "documents").select("doc_id", "text")))


def op9_bagminhash(spark: SparkSession, folder: str) -> DataFrame:
    return nearcopies.near_classes(table(spark, folder, "documents").select("doc_id", "text"))


def op10_length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lengths.length_histogram(lengths.encoded_lengths(docs, WORD_BPE))


def op11_anchor_lists(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_ngram_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return toxicity.scored(docs, table(spark, folder, "labels").select("doc_id", "toxic"))


def op13_automaton_scan(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_robust_outliers, op2_relational_chat, op3_context_mixing, op4_best_fit, op5_pii, op6_warc_chunks, op7_template_leaks, op8_suffix_arrays, op9_bagminhash, op10_length_histogram, op11_anchor_lists, op12_ngram_toxicity, op13_automaton_scan)
}

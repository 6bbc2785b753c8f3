"""From documents to packed sequences: quality rules, near copies, benchmark leaks, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the
columns of documents: the first three drop rows, the fourth replaces personal data in the text. A null text fails the
quality rules; null ids stay; an empty table stays empty through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagetrail.llm import decontam, nearcopies, packing, pii, quality
from stagetrail.llm.common import staged, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spans = "_" + "_".join(["spans", *docs.columns])
    found = pii.find_pii(docs, into=spans)
    # Under a name of its own: inside a lambda, `text` would mean a column of that name made beside it.
    clean = spans + "_text"
    found = found.withColumn(clean, pii.redacted(F.col("text"), F.col(spans)))
    made = {"text": F.col(clean)}
    if "n_chars" in docs.columns:
        length = F.length(clean).cast(docs.schema["n_chars"].dataType)
        made["n_chars"] = F.when(F.size(spans) > 0, length).otherwise(F.col("n_chars"))
    return found.select(*[made.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.pack_best_fit(docs, TOKENIZER)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Robust estimates, signatures and token ids are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Five stages over the documents table, whose decisions take effect. Each calls one of the training-data operators; the
near-duplicate stage links by op2's fingerprints and adds the pairs of similar.py, an exact join by five-word sets."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import packing, quality_classifier, quality_rules, similar, simhash, suffix_dedup
from tallywright.llm.common import settle, shared_folder, table


#: Words of the shortest passage that counts as repeated: over 50.
PASSAGE = 51


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as bad go."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model).filter("predicted = 1").select(docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that SimHash fingerprints within three bits, or a five-word similarity of 0.8 or more,
    join; of rows with one id, one."""
    named = docs.filter("doc_id is not null")
    if not named.groupBy("doc_id").count().filter("count > 1").isEmpty():
        docs = settle(named.dropDuplicates(["doc_id"]).unionByName(docs.filter("doc_id is null")))
    return simhash.keep_first(docs, find=simhash.with_links_of(similar.similar))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE words or more that start anywhere else too go from the texts."""
    cut = suffix_dedup.remove_repeats(docs, length=PASSAGE, unit=suffix_dedup.WORDS)
    made = cut.withColumn("text", F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text")))
    return made.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that are left."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("best-fit packing", pack),
]

#: The classifier and the tokenizer can't be written in SQL; tests/llm/ hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is written as Parquet in the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs

"""A training corpus from `documents`: quality classifier, exact dedup, near-dedup, secret scan, packing.

Each stage is one operator over all rows its predecessor kept. Stages but the last return the columns of documents; the secret
scan replaces what it finds in the text and corrects n_chars. The result is the packed corpus: a row for each piece, with its token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievetree.llm import exact_dedup, packing, quality, secret_scan, simhash
from sievetree.llm.common import load, scratch, temporary

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, load(spark, sf_dir, "labels"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality classifier", good_quality), ("exact dedup", distinct_texts), ("simhash near-dedup", no_near_copies), ("secret scan", no_secrets), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet in the shared folder and read again."""
    docs = load(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name.replace(' ', '-')}")
        with temporary(spark):  # a stage's own tables go when its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

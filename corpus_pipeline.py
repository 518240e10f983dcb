"""A training-data pipeline over `documents`: classify, deduplicate, decontaminate, mask secrets, encode."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import byte_bpe, decontamination, near_copies, quality_classifier, secrets, simhash
from tidewatch.llm.common import table, without
from tidewatch.llm.token_files import new_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, model).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: first the smallest doc_id of each SimHash component, then, of what stays, the smallest of each class of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more."""
    path = new_folder(spark, "near-dedup")
    simhash.deduplicate(docs).select(*COLUMNS).write.parquet(path)
    first = spark.read.schema(docs.select(*COLUMNS).schema).parquet(path)
    again = near_copies.classes(first).where("doc_id <> component_id").select("doc_id").distinct()
    return without(first, again).select(*COLUMNS)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each reported secret masked and n_chars of the new text."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes that they decode to."""
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", contamination), ("secret scans", secret_masks), ("byte-level BPE", tokens)]
#: Training and decoding have no SQL form; tests/llm hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs

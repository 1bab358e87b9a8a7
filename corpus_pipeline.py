"""Corpus pipeline: stages over the documents table, each on all that its predecessor kept.

``STAGES`` names them in order. Each takes (spark, docs, sf_dir) and returns the next stage's
documents, with the columns of ``documents``; the last returns the packed pieces. ``run`` writes
every stage's result as Parquet in the folder that the cluster shares and reads it again, so that
a lost executor costs at most one stage; a stage's input is deleted once its result is written.

The two deduplicating stages name rows by doc_id and text, so that rows without a doc_id or with a
repeated one stay unless they duplicate another's text.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm import exact_dedup, near_sets, packing, quality, secrets
from meridia.llm.common import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    return quality.accept(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row that is kept."""
    return exact_dedup.one_of_each(docs.select(*COLUMNS))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (shingles of five words, similarity 0.8 or more), the
    row with the smallest id. SimHash links near copies, each link confirmed by shingles; an exact
    search finds what lies beyond its radius."""
    return near_sets.one_of_each(docs.select(*COLUMNS))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the values of secrets masked."""
    masked = secrets.redact(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, each with its place in a training sequence."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]

#: Trained models and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs

"""Corpus pipeline: language, near duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoframe.llm import decontaminate, language, near, packing, secrets
from echoframe.llm.queries import public_tokenizer
from echoframe.session import fresh_folder, remove_folder

#: Share of a document's words in benchmark passages from which it is dropped.
CONTAMINATED = 0.0


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages; texts without letters and undecided ones go."""
    network = language.fit(docs, "doc_id", "text", "lang", F.lit(True))
    return language.keep_known(docs, "text", network)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word-shingle similarity 0.8: that with the least doc_id."""
    return near.deduplicate(docs, "doc_id", "text")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word passage of a benchmark item."""
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, "doc_id", "text", tests, "item_id", "text", CONTAMINATED)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by their kinds; n_chars follows the text."""
    return secrets.redact(docs, "text").withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, with their ids."""
    return packing.pack(docs, "doc_id", "text", **public_tokenizer()).withColumnRenamed("key", "doc_id")


STAGES = [
    ("language identification", known_languages),
    ("n-gram Jaccard join", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("packing", packed),
]

# The language network and packing cannot be said in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder.

    Stages are written under the folder in spark.checkpoint.dir, which all machines share; a stage's input is deleted
    once its output is there, so that one copy stays, the result.
    """
    home = fresh_folder(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{number}")
        docs = spark.read.parquet(f"{home}/{number}")
        if number:
            remove_folder(spark, f"{home}/{number - 1}")
    return docs

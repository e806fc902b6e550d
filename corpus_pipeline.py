"""A corpus in five stages: quality, near-duplicates, repeated passages, benchmark leaks, mixture.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read
again as the documents of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.decontamination import decontaminate
from kinlink.llm.mixing import with_copies
from kinlink.llm.quality import score, train
from kinlink.llm.simhash import one_of_each
from kinlink.llm.substring_dedup import dedup_substrings
from kinlink.storage import materialize

#: Stages fit models and search approximately, which SQL cannot express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores below one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels), name="_score").filter(F.col("_score") >= 0.5).drop("_score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    First is the smallest id; null ids come last, and among equal ids the smallest digest of the text.
    """
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages of 13 words and more that a document of smaller id holds; n_chars follows the text."""
    return dedup_substrings(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: every document that the mix takes, with how often (``copies``) and its share of words.

    One row for each document and not for each copy; ``kinlink.llm.mixing.sample_mix`` repeats them.
    """
    return with_copies(docs, "size", "source_size", "target", "taken", "copies")


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("mixing", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

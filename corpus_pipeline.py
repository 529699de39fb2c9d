"""A training corpus from the table documents: classified, deduplicated, decontaminated and packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the docs of
the next. All but the last return the columns of documents. A stage covers all that the one before it kept.

Defined cases: those of the operators. Null texts have no features, so the bias decides in the first stage. Stages 2, 3
and 4 decide by row, whatever its id. Empty tables give empty results; extra columns are carried on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import decontamination, exact_dedup, ngram_join, packing, quality
from spanweave.llm.common import crc32_mod, free_name, scratch_dir, table
from spanweave.llm.queries import QUALITY_LEAST, vocabulary


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the rows that op8 learns from."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), crc32_mod("doc_id", 4) != 2)
    score = free_name(docs, "score")
    return quality.score(docs, model, keep=True, out=score).where(F.col(score) >= QUALITY_LEAST).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the row with the smallest doc_id."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links at a Jaccard similarity of 0.8 connect, the one with the smallest doc_id."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, each with its sequence of at most 4096 tokens and its place there."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", classify),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: SQL cannot express the classifier and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; between stages the rows lie in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_dir(spark)
    for name, function in STAGES:
        path = f"{folder}/{name}"
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

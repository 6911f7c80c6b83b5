"""A training corpus from raw documents: five stages, each a Parquet table that the next one reads.

Every stage works on all rows its predecessor kept, and keeps all columns of its input, whatever they are called; the key is `doc_id`, the text
`text`. The classifiers learn from the labels beside the documents, and only from documents that reached them.

Defined results, for every stage: a null text counts as empty; a null key is a row like others; rows of one key are rows of their own, and equal
rows stay as often as they came until a stage for copies keeps one; of copies and near copies the row stays that the operator names; scores on a
threshold follow the operator (0.5 is toxic, 0.7 is good); without labels of both classes nothing is toxic and every document scores as its one class does; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrane.llm import common, exact_dedup, near_dedup, packing, quality, toxicity


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.prepared(spark).read.parquet(f"{sf_dir}/labels.parquet")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 for toxicity."""
    return toxicity.without_toxic(docs, _labels(spark, sf_dir))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good: a probability of 0.7 or more."""
    return quality.of_quality(docs, _labels(spark, sf_dir))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts."""
    common.prepared(spark)
    return exact_dedup.keep_one(docs)


def one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    common.prepared(spark)
    return near_dedup.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    common.prepared(spark)
    return packing.pack_documents(docs)


STAGES = [("toxicity", not_toxic), ("quality", of_quality), ("exact_dedup", one_of_each), ("near_dedup", one_of_alike), ("packing", packed)]

#: Learnt models and sampled sketches decide rows, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. What a stage wrote goes when the next has been written; the last table stays for the caller until the interpreter ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with common.passing(spark):
            path = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.forget(docs)
        docs = common.kept(spark, path)
    return docs

"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import classifier, decontaminate, near_dedup, packing, shared, substring_dedup


def drop_rejected(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it is fitted on the labelled ones."""
    return classifier.kept(docs, classifier.train(docs, shared.table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dedup.one_of_each(docs, near_dedup.near_duplicates(docs))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each passage that repeats, the first occurrence stays; the others are cut out of their texts."""
    return substring_dedup.without_repeats(docs, substring_dedup.repeated_passages(docs))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go."""
    return decontaminate.decontaminate(docs, shared.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left goes into bins."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", drop_rejected),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", cut_benchmark),
    ("packing", pack),
]

#: A trained network, MinHash and packing can't be written in SQL; each stage is tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each stage's rows written to the shared folder."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""Corpus pipeline: raw documents to packed training batches.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet
and read again as the next stage's ``docs``.  The first four keep the columns
of ``documents``; the last returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from surv.llm import decontam, langid, ngram_join, packing, quality_nbsvm
from surv.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7, learnt from the labelled documents: rejects scores under 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_nbsvm.fit(docs, labels)
    return quality_nbsvm.classify(docs, model, score_out="_score").where("_score >= 0.5").drop("_score")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2, learnt from the documents that name a language: rejects texts
    without a letter and texts that no learnt language fits better than the rest."""
    model = langid.fit(docs)
    out = langid.identify(docs, model, lang_out="_lang", score_out="_fit")
    return out.where("_lang <> 'und' AND _fit >= 0.5").drop("_lang", "_fit")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group the document with the smallest id stays."""
    return ngram_join.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a benchmark item go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: length buckets and batches."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", pack)]

# No stage but the last could be put in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

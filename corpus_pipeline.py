"""From raw documents to packed training sequences: five stages, each one corpus operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratafold.llm.exact_dedup import drop_exact_duplicates
from stratafold.llm.jaccard import keep_one_per_component
from stratafold.llm.mixing import mix
from stratafold.llm.packing import pack
from stratafold.llm.quality import drop_rejected
from stratafold.scratch import remove, save, scope


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    return drop_exact_duplicates(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return keep_one_per_component(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with their token ids."""
    return pack(docs, with_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("mixing to target weights", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and reread before the next stage, and what made it is freed."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scope() as written:
            docs, path = save(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        for made in [*before, *(p for p in written if p != path)]:
            remove(spark, made)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)


#: Near duplicates, a fitted classifier and token ids are beyond SQL; tests hold the result against brute force.
ORACLE_SQL = None

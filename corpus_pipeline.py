"""A corpus from raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import Scratch
from gridloom.llm.decontamination import decontaminate
from gridloom.llm.near_duplicates import near_dedup
from gridloom.llm.packing import pack_documents
from gridloom.llm.quality_rules import quality_filter
from gridloom.llm.suffix_dedup import dedup_texts


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or the rule cascade rejects go."""
    return quality_filter(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with a five-word similarity of 0.8 or more the document with the smallest doc_id stays."""
    return near_dedup(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under 50-byte strings that a smaller document has too go from the texts; all documents stay."""
    return dedup_texts(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, within its edits, go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is tokenised and packed into sequences of 1024 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no XXH64 fingerprints, edit distance search or tokenizer: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are a table in the shared scratch folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            last, docs = docs, scratch.table(done, name)
            if k:
                scratch.drop(last)
        else:
            docs = done
    return docs

"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing, sharding.

``run`` applies ``STAGES`` to the documents table; each stage's rows are written as Parquet and read back as the next
one's ``docs``.  All but the last return the columns of ``docs``; the last adds ``shard``.

Defined cases: a null or empty text is not toxic, has no near duplicates, holds no benchmark item and is not taken by
the mix, as it has no words; rows that repeat doc_id and text are one document, of which near-dedup keeps one row; rows
without a doc_id are judged by their text; very long texts are whole texts as any other; an empty table gives an empty
one; columns beyond those of ``documents`` are kept whatever their names, and one called ``shard`` is returned as
``input_shard``.  Mixing writes its rows in the order of the mixed shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftspark.llm import decontam, mixing, neardup, sharding, toxicity
from weftspark.llm._cluster import Staged, collecting, remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar, learned from the labelled ones, doesn't reject."""
    grammar = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, grammar)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 5-word shingles, similarity 0.8 or more."""
    return neardup.one_of_each(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes, shard after shard, each shuffled."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard; rows with equal texts share one."""
    return sharding.assign(docs, shards=16)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: The toxicity stage learns a grammar, which SQL can't express; ``tests/llm`` holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = Staged(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with collecting() as begun:
            before, docs = docs, staged.write(stage(spark, docs, sf_dir))
        remove(spark, begun)
        if hasattr(before, "_staged_at"):
            staged.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)

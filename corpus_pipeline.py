"""A corpus pipeline: five operators one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.  All but the last keep the
columns of documents, and mixing adds its place, MIX:

1. quality rules: documents that the learned decision list rejects go
2. MinHash near-dedup (five words, 0.8): one document of each class stays
3. benchmark decontamination: documents hit by benchmark items go
4. mixing sources to target weights: rows in Pfair training order; none go
5. sharding: rendezvous shards of eight, with slots in the order of the mixture

Nulls, empty texts, repeated rows, empty tables and clashing names are handled
as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import decontaminate, mixing, near_dups, quality_rules, sharding
from pathloom.llm.spark_tools import RANK_BUCKETS, gapless_rank, materialize

SHARDS = 8
#: Columns between the last two stages: slot and offset of the mixture.
MIX = ("mix_slot", "mix_offset")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the learned rules."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate class."""
    return near_dups.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with less than a twentieth of their words in benchmark windows."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place, MIX, in the mixture of their sources."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in MIX])
    own = {c: f"own_{c}" for c in docs.columns if c.lower() in mixing.RESULTS}
    mixed = mixing.mix_sources(docs.withColumnsRenamed(own)).withColumnsRenamed({"slot": MIX[0], "offset": MIX[1]})
    return mixed.drop(*mixing.RESULTS).withColumnsRenamed({v: k for k, v in own.items()})


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard, and their slot there in the order of MIX."""
    placed = sharding.shard_documents(docs, [1.0] * SHARDS, slots=False)
    last = docs.agg(F.max(MIX[0])).first()[0] or 0
    part = F.floor(F.col(MIX[0]) * F.lit(RANK_BUCKETS) / F.lit(last + 1))
    return gapless_rank(placed, "shard", F.lit(""), [F.col(c) for c in MIX], "slot", part).drop(*MIX)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", shards),
]

#: The learned rules aren't SQL; tests/llm/test_pipeline.py holds mixing and sharding against brute force, and the
#: operators' own tests hold the others.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a table is written after each but the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{k}")
    return docs

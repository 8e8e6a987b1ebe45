"""The corpus pipeline: documents through quality, near-duplicates, benchmark leaks, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes each stage's rows to the
shared folder and reads them back as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, mixing, quality, sharding, simhash
from tidewell.llm.registry import SHARD_BYTES
from tidewell.llm.shared import discard, stash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier, learned from these rows' labels, doesn't reject."""
    return quality.keep_quality(docs, quality.quality_model(docs, _table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component, by the 3 bits of op10, the document with the least doc_id; the README tells what stays."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole rows, each up to three times, so that the words of each source come near its target."""
    return mixing.whole_documents(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows' shards, with the digest of the text: doc_id, source, text_sha256, shard, depth, shard_bytes, row_bytes."""
    digested = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return sharding.extendible_shards(digested, SHARD_BYTES, carry=["doc_id", "source", "text_sha256"])


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix_sources),
    ("sharding", assign_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        after = stash(stage(spark, docs, sf_dir))
        if i:
            discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier has no SQL.
ORACLE_SQL = None

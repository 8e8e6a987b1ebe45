"""The registered queries of the corpus operators: opN_<name> applies operator N to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, language, line_dedup, negatives, quality
from .decontaminate import leaks
from .license_scan import license_scan
from .media import fingerprints, stored_media
from .mixing import mix
from .sharding import extendible_shards
from .sharding import oracle as sharding_oracle
from .simhash import near_duplicates
from .substring_dedup import substring_dedup
from .token_count import token_counts

#: Greatest bytes of text in a shard.
SHARD_BYTES = 1 << 20
#: Centroids, rounds and components of the clustering.
CLUSTERING = 40, 5, 64
#: Rows whose id this divides are anchors.
ANCHOR_EVERY = 100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints(stored_media(_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "landmarks")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards(_table(spark, sf_dir, "documents"), SHARD_BYTES, carry=["doc_id"])


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "freedom", "bound")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.quality_model(docs, _table(spark, sf_dir, "labels")))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs), spans=False)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_spanning_links")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(spark, _table(spark, sf_dir, "embeddings"), *CLUSTERING)


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % ANCHOR_EVERY == 0, label=negatives.moved_label())


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media": op1_media,
        "op2_decontaminate": op2_decontaminate,
        "op3_sharding": op3_sharding,
        "op4_license_scan": op4_license_scan,
        "op5_mixing": op5_mixing,
        "op6_token_count": op6_token_count,
        "op7_quality": op7_quality,
        "op8_language": op8_language,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_simhash": op10_simhash,
        "op11_centroids": op11_centroids,
        "op12_negatives": op12_negatives,
        "op13_line_dedup": op13_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_sharding": sharding_oracle(SHARD_BYTES),
        "op11_centroids": centroids.oracle(*CLUSTERING),
        "op12_negatives": negatives.oracle(ANCHOR_EVERY),
        "op13_line_dedup": line_dedup.oracle(),
    }

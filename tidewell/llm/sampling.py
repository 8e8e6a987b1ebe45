"""Bounded training samples: the rows with the least seeded hash, brought to the driver without moving other texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus


#: The bound of a sample's texts, in bytes of UTF-8.
MOST_BYTES = 128 << 20


def sample_texts(docs: DataFrame, chosen: DataFrame, most: int, seed: int, most_bytes: int = MOST_BYTES) -> pa.Table:
    """text and label of at most `most` rows and most_bytes of text. chosen: doc_id and label; those with the least hash come first.

    Texts that would pass most_bytes with those before them are passed over. Ids are broadcast, at most `most`.
    """
    ids = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("__order", F.xxhash64("doc_id", F.lit(seed))).orderBy("__order", "doc_id").limit(most)
    sized = docs.select("doc_id", F.octet_length("text").cast("long").alias("bytes")).join(F.broadcast(ids), "doc_id")
    sizes = sized.groupBy("doc_id", "label", "__order").agg(F.max("bytes").alias("bytes")).toArrow().sort_by([("__order", "ascending"), ("doc_id", "ascending")])
    keep, total = [], 0
    for n in sizes["bytes"].fill_null(0).to_pylist():
        keep.append(total + n <= most_bytes)
        total += n * keep[-1]
    kept = sizes.filter(pa.array(keep, pa.bool_())).select(["doc_id", "label"])
    spark = docs.sparkSession
    if not kept.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "label": kept["label"].slice(0, 0)})
    found = docs.select("doc_id", "text").join(F.broadcast(spark.createDataFrame(kept)), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return found.toArrow().sort_by("doc_id")

"""A join on keys of any frequency: the rows of a hot key are dealt over salts, those of the others go by the key alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has over 1 / HOT of all rows, so there are fewer than HOT hot keys whatever the data are.
HOT = 1024


def split_join(left: DataFrame, right: DataFrame, key: str, rows: int, salt: Column) -> DataFrame:
    """left joined with right (one row a key, with n, at least the rows of left that hold it) on `key`; n is dropped.

    rows: the sum of n or more. A hot key gets as many salts as leave rows / HOT of its rows to each; the table of hot keys
    is broadcast, as its size is bounded by HOT. salt: a bigint that tells the rows of left apart. right is read twice.
    """
    sized = right.withColumn("__salts", F.ceil(F.col("n") * HOT / F.lit(float(max(1, rows)))).cast("int"))
    hot = sized.where("__salts > 1").select(key, F.col("__salts").alias("__of"))
    tagged = left.join(F.broadcast(hot), key, "left").withColumn("__salt", F.pmod(salt, F.coalesce("__of", F.lit(1))).cast("int")).drop("__of")
    dealt = sized.withColumn("__salt", F.explode(F.expr("sequence(0, greatest(0, __salts - 1))"))).drop("n", "__salts")
    return tagged.join(dealt, [key, "__salt"]).drop("__salt")

"""Bloom filters as tables of set bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import bloom_indexes, bloom_shape


def build(keys: DataFrame, key: Column, n: int, p: float = 0.01) -> DataFrame:
    """(bit): the set bits, each once; at most m rows, combined on the map side."""
    m, k = bloom_shape(n, p)
    return keys.select(F.explode(bloom_indexes(key, m, k)).alias("bit")).distinct()


def probe(keys: DataFrame, key: Column, bits: DataFrame, n: int, p: float = 0.01) -> DataFrame:
    """``keys`` plus ``maybe``: whether all bits of the key are set.

    The filter's size is fixed by its shape (m bits); it is packed into one
    binary row and broadcast, 1 MB for a million keys at 1 %.
    """
    m, k = bloom_shape(n, p)
    words = F.transform(F.sequence(F.lit(0), F.lit((m - 1) // 64)), lambda w: F.coalesce(F.element_at(F.col("by_word"), w), F.lit(0).cast("long")))
    packed = (
        bits.groupBy(F.floor(F.col("bit") / 64).cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("x"))
        .agg(F.map_from_entries(F.collect_list(F.struct("w", "x"))).alias("by_word"))
        .select(words.alias("words"))
    )
    indexes = bloom_indexes(key, m, k)
    hit = F.forall(indexes, lambda i: F.getbit(F.get(F.col("words"), F.floor(i / 64).cast("int")), (i % 64).cast("int")) == 1)
    return keys.crossJoin(F.broadcast(packed)).withColumn("maybe", hit).drop("words")

"""Generated feature records, for load tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def feature_rows(spark: SparkSession, count: int = 100_000, dim: int = 128, seed: int = 0) -> DataFrame:
    """key user_i, value 'metadata', a vector of uniform numbers in [-1, 1): the same for the same seed."""
    number = lambda j: (F.pmod(F.xxhash64("id", j, F.lit(seed)), F.lit(1 << 30)).cast("double") / F.lit(float(1 << 29)) - 1).cast("float")
    vector = F.transform(F.sequence(F.lit(1), F.lit(dim)), number)
    return spark.range(count).select(F.concat(F.lit("user_"), "id").alias("key"), F.lit("metadata").alias("value"), vector.alias("vector"))

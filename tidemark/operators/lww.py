"""Last-write-wins views of a log (key, value, ts, tombstone, seq).

The version with the largest ts wins; of equal ones the first arrival: the
smallest seq or, in a log of several batches, the smallest (batch, seq). A
delete is a version like any other, with its tombstone set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def arrival_columns(log: DataFrame) -> list[str]:
    """The columns that order a log's rows by arrival."""
    return ["batch", "seq"] if "batch" in log.columns else ["seq"]


def arrival(log: DataFrame) -> Column:
    return F.struct(*arrival_columns(log))


def _age(log: DataFrame) -> Column:
    """Orders versions: the maximum wins."""
    return F.struct(F.col("ts"), *[(-F.col(c)).alias(f"-{c}") for c in arrival_columns(log)])


def latest(log: DataFrame, key: str = "key", by: Column | None = None) -> DataFrame:
    """The winning row of each key, tombstones included.

    A combining aggregate: each task sends one row per key, so a hot key is no
    bottleneck. Null keys are one key. Columns stay as they are.
    """
    rest = [c for c in log.columns if c != key]
    won = log.groupBy(key).agg(F.max_by(F.struct(*rest), _age(log) if by is None else by).alias("won"))
    return won.select(key, "won.*").select(*log.columns)


def latest_ranked(log: DataFrame, key: str = "key") -> DataFrame:
    """The same by ranking; for rows too wide to pass through aggregation buffers."""
    order = Window.partitionBy(key).orderBy(F.col("ts").desc(), *arrival_columns(log))
    return log.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def essential(log: DataFrame, key: str = "key") -> DataFrame:
    """What all later reads of a log with vectors need: each key's winner, and the put that brought
    its last vector, which may be another version (vectors go by arrival). Columns stay.

    A combining aggregate of one shuffle, as :func:`latest`; a winner's older vector goes.
    """
    row, came = F.struct(*log.columns), F.when(F.size("vector") > 0, arrival(log))
    both = log.groupBy(key).agg(F.max_by(row, _age(log)).alias("won"), F.max_by(row, came).alias("last"))
    same = F.forall(F.array(*[F.col(f"won.{c}") == F.col(f"last.{c}") for c in arrival_columns(log)]), lambda x: x)
    bare = F.col("won").withField("vector", F.lit(None).cast(log.schema["vector"].dataType))
    rows = F.when(F.col("last").isNull() | same, F.array("won")).otherwise(F.array(bare, F.col("last")))
    return both.select(F.explode(rows).alias("row")).select("row.*").select(*log.columns)


def live(log: DataFrame, key: str = "key") -> DataFrame:
    """Keys whose winning version is not a delete. The filter must come after the fold."""
    return latest(log, key).filter(~F.col("tombstone"))


def tombstones(log: DataFrame, key: str = "key") -> DataFrame:
    return latest(log, key).filter("tombstone")


def lookup(log: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Each requested key with outcome 'live', 'deleted' or 'absent', value and ts.

    Only the requested keys' versions are folded: the requests reduce the log
    before its shuffle where they are small enough to be broadcast by Spark.
    """
    asked = keys.select(key)
    versions = log.join(asked.distinct(), key, "left_semi")
    found = latest(versions, key).select(key, "value", "ts", "tombstone")
    outcome = F.when(F.col("ts").isNull(), "absent").when(F.col("tombstone"), "deleted").otherwise("live")
    joined = asked.join(found, key, "left").withColumn("outcome", outcome)
    return joined.select(key, "outcome", F.when(F.col("outcome") == "live", F.col("value")).alias("value"), "ts")


def layered_get(log: DataFrame, layer: str = "layer", key: str = "key") -> DataFrame:
    """For study: the newest layer that holds a key answers, whatever its time."""
    return latest(log, key, F.struct(F.col(layer).alias("layer"), _age(log).alias("age")))


def compact(log: DataFrame, layer: str = "layer", key: str = "key") -> DataFrame:
    """One run from all: each layer's winners, then the winners of those. Tombstones stay."""
    per_layer = log.withColumn("__k", F.struct(layer, key))
    folded = latest(per_layer, "__k").drop("__k")
    return latest(folded.drop(layer), key)

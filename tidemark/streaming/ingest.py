"""Streams of puts into a log, and last-write-wins state over a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lww import latest


def ingest_log(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Appends a stream to a log, one folder per micro-batch.

    A micro-batch is the unit of commit (group commit): its folder is written
    over when the batch is repeated after a failure, so rows come once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


def lww_changes(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Keyed last-write-wins state: each batch's changed winners go to ``sink``.

    No watermark: an older time loses however late it is, and is never dropped.
    State is one row per key.
    """
    rest = [c for c in stream.columns if c != "key"]
    won = stream.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct(F.col("ts"), (-F.col("seq")).alias("first"))).alias("won"))
    changes = won.select("key", "won.*")
    return changes.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def fold_changes(changes: DataFrame) -> DataFrame:
    """The state that a table of changes adds up to; winners only get newer."""
    return latest(changes)

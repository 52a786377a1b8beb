"""Scans and statistics over layers of a log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lww import latest


def scan_since(log: DataFrame, ts: int) -> DataFrame:
    """Rows of time ``ts`` or later; the comparison reaches the Parquet scan."""
    return log.filter(F.col("ts") >= F.lit(ts))


def scan_since_keys(layers: list[DataFrame], ts: int, dedupe: bool = False) -> DataFrame:
    """Keys of rows since ``ts``, layer after layer with repeats, or each once."""
    keys = reduce(DataFrame.unionByName, [scan_since(x, ts).select("key") for x in layers])
    return keys.distinct() if dedupe else keys


def sorted_scan(log: DataFrame) -> DataFrame:
    """The current version of each key in bytewise key order."""
    return latest(log).orderBy("key")


def run_stats(log: DataFrame, layer: str = "layer") -> DataFrame:
    """Rows, least and largest time and bytes (keys, values and 17 each) of each run."""
    size = F.length("key") + F.coalesce(F.length("value"), F.lit(0)) + 17
    return log.groupBy(layer).agg(F.count("*").alias("n_rows"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.sum(size).cast("long").alias("n_bytes"))


def sync_rows(log: DataFrame, since: int = 0) -> DataFrame:
    """What a replica sends to a peer: current versions since a time, tombstones included.

    The winner has the largest time, so older rows can go before the fold, at the scan.
    """
    return latest(scan_since(log, since))


def valid_prefix(log: DataFrame, valid: str = "valid", order: str = "seq") -> DataFrame:
    """The rows before the first invalid one: all that a damaged log still gives.

    The least invalid position is one combined number, not a running window.
    """
    first_bad = log.filter(~F.col(valid)).agg(F.min(order).alias("bad"))
    return log.crossJoin(F.broadcast(first_bad)).filter(F.col("bad").isNull() | (F.col(order) < F.col("bad"))).drop("bad")

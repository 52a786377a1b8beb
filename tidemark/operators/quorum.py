"""Quorum outcomes, reconciliation and repair over tables of replica answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lww import latest
from .scan import sync_rows
from .sizes import small


def write_outcome(acks: DataFrame, by: list[str], w: int) -> DataFrame:
    """(by, n_ok, committed): a write is committed if W replicas acknowledged it."""
    return acks.groupBy(*by).agg(F.count_if("ok").alias("n_ok")).withColumn("committed", F.col("n_ok") >= w)


def hints_of(acks: DataFrame) -> DataFrame:
    """The writes that a replica missed: whole records for later replay."""
    return acks.filter(~F.col("ok")).withColumnRenamed("node", "target").drop("ok")


def read_resolve(answers: DataFrame, r: int) -> DataFrame:
    """One row per key from the first R good answers: n_ok, quorum, and the version with the largest ts
    (ties to the first answer); without a quorum its columns are null.

    Needs key, node, value, ts, tombstone, found, ok, resp_order.
    """
    place = F.row_number().over(Window.partitionBy("key").orderBy("resp_order"))
    good = answers.filter("ok").withColumn("place", place).filter(F.col("place") <= r)
    version = F.struct("value", "ts", "tombstone", "found")
    best = good.groupBy("key").agg(
        F.count("*").alias("n_ok"), F.max_by(version, F.struct(F.when(F.col("found"), F.col("ts")).otherwise(0), -F.col("resp_order"))).alias("won")
    )
    met = F.col("n_ok") >= r
    known = answers.select("key").distinct().join(best, "key", "left").withColumn("n_ok", F.coalesce("n_ok", F.lit(0)))
    return known.select("key", "n_ok", met.alias("quorum"), *[F.when(met, F.col(f"won.{c}")).alias(c) for c in ("value", "ts", "tombstone", "found")])


def stale_replicas(answers: DataFrame) -> DataFrame:
    """(key, node, ts, best_ts): every good replica that is behind, in whatever order it answered."""
    seen = F.when(F.col("found"), F.col("ts")).otherwise(0)
    good = answers.filter("ok").withColumn("ts", seen)
    best = good.groupBy("key").agg(F.max("ts").alias("best_ts"))
    return good.join(best, "key").filter("ts < best_ts").select("key", "node", "ts", "best_ts")


def read_repair(answers: DataFrame) -> DataFrame:
    """(node, key, value, ts, tombstone): the winning record for each replica that is behind,
    with its vector if the answers have that column."""
    found = answers.filter("ok and found")
    record = [c for c in ("value", "ts", "tombstone", "vector") if c in answers.columns]
    won = found.groupBy("key").agg(F.max_by(F.struct(*record), F.struct("ts", -F.col("resp_order"))).alias("won"))
    return stale_replicas(answers).join(won, "key").select("node", "key", *[f"won.{c}" for c in record])


def replay_hints(hints: DataFrame, up: DataFrame, store: DataFrame) -> DataFrame:
    """The records of each node after replay: its own rows and the hints for nodes that are up, folded.

    ``store`` has node and the log columns; replay is idempotent.
    """
    due = hints.join(small(up.select(F.col("node").alias("target")).distinct()), "target", "left_semi")
    rows = store.unionByName(due.withColumnRenamed("target", "node").select(*store.columns))
    return latest(rows.withColumn("__k", F.struct("node", "key")), "__k").drop("__k")


def failure_detector(beats: DataFrame, max_misses: int = 3) -> DataFrame:
    """``beats`` (node, tick, ok) plus misses, state and recovered.

    Misses count since the last good beat; a node is DEAD from ``max_misses`` on,
    and a good beat after that has it recovered.
    """
    upto = Window.partitionBy("node").orderBy("tick").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    island = beats.withColumn("island", F.sum(F.col("ok").cast("long")).over(upto))
    within = Window.partitionBy("node", "island").orderBy("tick").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = island.withColumn("misses", F.sum((~F.col("ok")).cast("long")).over(within))
    before: Column = F.lag("misses", 1, 0).over(Window.partitionBy("node").orderBy("tick"))
    return counted.select(
        "node",
        "tick",
        "ok",
        "misses",
        F.when(F.col("misses") >= max_misses, "DEAD").otherwise("ALIVE").alias("state"),
        (F.col("ok") & (before >= max_misses)).alias("recovered"),
    )


def sync_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Keys on which two replicas' current versions differ: (key, local_ts, remote_ts, side), the side that is ahead."""
    a = latest(local).select("key", F.col("ts").alias("local_ts"))
    b = latest(remote).select("key", F.col("ts").alias("remote_ts"))
    ahead = F.when(F.col("remote_ts").isNull() | (F.col("local_ts") > F.col("remote_ts")), "local").otherwise("remote")
    return a.join(b, "key", "full").filter(~F.col("local_ts").eqNullSafe(F.col("remote_ts"))).withColumn("side", ahead)


def anti_entropy(local: DataFrame, remote: DataFrame, since: int = 0) -> DataFrame:
    """The local log after taking a peer's current versions since a time."""
    return latest(local.unionByName(sync_rows(remote, since).select(*local.columns)))

"""How the registered queries read the sample tables as logs, vectors and beats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanos(ts):
    """A timestamp's Unix nanoseconds (it holds microseconds)."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log: one key per user, an error is a delete. Keys stay text."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("key"),
        F.col("props").alias("value"),
        nanos(F.col("ts")).alias("ts"),
        (F.col("event_type") == "error").alias("tombstone"),
        F.col("event_id").alias("seq"),
    )


KV_SQL = """kv AS (SELECT 'user_' || user_id AS key, props AS value, epoch_us(ts) * 1000 AS ts, event_type = 'error' AS tombstone, event_id AS seq, event_type FROM events)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").alias("vector"), F.col("vec_id").alias("seq"), "label")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replica answers: the events of event_id mod 3 are a node's log; each node answers for every key
    it holds with its current version. Node 2 does not answer for keys whose user is a multiple of 7."""
    from ..operators.lww import latest

    log = kv(spark, sf_dir).withColumn("node", (F.col("seq") % 3).cast("int"))
    won = latest(log.withColumn("k", F.struct("key", "node")), "k").drop("k")
    user = F.substring("key", 6, 20).cast("long")
    return won.select(
        "key", "node", "value", "ts", "tombstone", F.lit(True).alias("found"), (~((F.col("node") == 2) & (user % 7 == 0))).alias("ok"), ((F.col("node") + user) % 3).cast("int").alias("resp_order")
    )


ANSWERS_SQL = (
    KV_SQL
    + """,
answers AS (SELECT key, node, value, ts, tombstone, NOT (node = 2 AND substr(key, 6)::BIGINT % 7 = 0) AS ok, (node + substr(key, 6)::BIGINT) % 3 AS resp_order
  FROM (SELECT *, (seq % 3)::INT AS node, row_number() OVER (PARTITION BY key, seq % 3 ORDER BY ts DESC, seq) AS n FROM kv) WHERE n = 1)"""
)

"""Consistent-hash placement.

A ring is configuration: nodes x virtual nodes tokens, a few thousand at most.
Its preference lists are worked out once on the driver and become a small table
of hash intervals; keys find theirs by an equi-join on the interval's leading
bits, so that no key is paired with every token.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a64, fnv1a64_py

#: Tokens above which a ring is refused: beyond, its interval table is no longer a small broadcast.
MOST_TOKENS = 1_000_000


class HashRing:
    """Distinct nodes with ``vnodes`` tokens each, hash of ``node#i``."""

    def __init__(self, nodes: list[str], vnodes: int = 3):
        self.nodes, self.vnodes = sorted(set(nodes)), vnodes
        if len(self.nodes) * vnodes > MOST_TOKENS:
            raise ValueError(f"a ring has at most {MOST_TOKENS} tokens")
        self.tokens = sorted((fnv1a64_py(f"{n}#{i}".encode()), n) for n in self.nodes for i in range(vnodes))

    def without(self, node: str) -> HashRing:
        return HashRing([n for n in self.nodes if n != node], self.vnodes)

    def owners(self, h: int, count: int) -> list[str]:
        """The first ``count`` distinct nodes clockwise from hash h; all if there are fewer."""
        if not self.tokens:
            raise ValueError("the ring has no nodes")
        at = bisect.bisect_left(self.tokens, (h, ""))
        out: dict[str, None] = {}
        for i in range(len(self.tokens)):
            out[self.tokens[(at + i) % len(self.tokens)][1]] = None
            if len(out) == count:
                break
        return list(out)

    def intervals(self, spark: SparkSession, count: int) -> DataFrame:
        """(lo, hi, owners): hashes of lo to hi, both included, go to these nodes."""
        rows, lo = [], 0
        for token, _ in self.tokens:
            if token >= lo:
                rows.append((str(lo), str(token), self.owners(token, count)))
                lo = token + 1
        if lo < 2**64:
            rows.append((str(lo), str(2**64 - 1), self.owners(lo, count)))
        table = spark.createDataFrame(rows, "lo string, hi string, owners array<string>")
        return table.select(F.col("lo").cast("decimal(20,0)").alias("lo"), F.col("hi").cast("decimal(20,0)").alias("hi"), "owners")


def tokens(nodes: DataFrame, vnodes: int) -> DataFrame:
    """(token, node) of a table of nodes, by the same hash as an expression."""
    each = nodes.distinct().select("node", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("i"))
    label = F.concat("node", F.lit("#"), F.col("i").cast("string"))
    return each.select(fnv1a64(label.cast("binary")).alias("token"), "node")


#: Leading bits that keys and intervals are joined by.
SHIFT = 2**52


def replicas(keys: DataFrame, key: Column, ring: HashRing, count: int) -> DataFrame:
    """``keys`` plus owners, the array of nodes of each key (primary first)."""
    spark = keys.sparkSession
    cells = lambda c: F.floor(c / F.lit(SHIFT)).cast("int")
    table = ring.intervals(spark, count).withColumn("cell", F.explode(F.sequence(cells(F.col("lo")), cells(F.col("hi")))))
    hashed = keys.withColumn("h", fnv1a64(key)).withColumn("cell", cells(F.col("h")))
    inside = (F.col("h") >= F.col("lo")) & (F.col("h") <= F.col("hi"))
    return hashed.join(F.broadcast(table), "cell").filter(inside).drop("cell", "lo", "hi", "h")


def route(keys: DataFrame, key: Column, ring: HashRing) -> DataFrame:
    return replicas(keys, key, ring, 1).withColumn("node", F.col("owners")[0]).drop("owners")


def remap(keys: DataFrame, key: Column, before: HashRing, after: HashRing) -> DataFrame:
    """The keys whose primary changes, with old and new node."""
    old = route(keys, key, before).withColumnRenamed("node", "old_node")
    return route(old, key, after).withColumnRenamed("node", "new_node").filter("old_node <> new_node")


def balance(keys: DataFrame, key: Column, ring: HashRing) -> DataFrame:
    """(node, n_keys): keys of each primary, nodes without keys too."""
    spark = keys.sparkSession
    counts = route(keys, key, ring).groupBy("node").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(n,) for n in ring.nodes], "node string").join(counts, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n_keys"))



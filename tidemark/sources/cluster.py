"""A replicated store: records on N nodes of a hash ring, quorum writes and reads.

Each node is a :class:`Store`. Batches are placed by the ring, written to every
replica that is up, and kept as hints for the others; a key's write is
committed if W replicas took it. Reads gather the answers of the replicas that
are up, resolve the first R of them by time, and send the newest record, its
vector included, to all that are behind.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lww, quorum, ring
from .store import Store


class Cluster:
    def __init__(self, spark: SparkSession, path: str, nodes: list[str], n: int = 3, w: int = 2, r: int = 2, vnodes: int = 16):
        self.spark, self.path, self.n, self.w, self.r = spark, path.rstrip("/"), n, w, r
        self.ring = ring.HashRing(nodes, vnodes)
        self.stores = {x: Store(spark, f"{self.path}/node={x}") for x in self.ring.nodes}
        self.hints = {x: Store(spark, f"{self.path}/hints={x}") for x in self.ring.nodes}
        self.down: set[str] = set()

    def _placed(self, rows: DataFrame) -> DataFrame:
        return ring.replicas(rows, F.col("key"), self.ring, self.n)

    def put_batch(self, rows: DataFrame, ts: int | None = None) -> DataFrame:
        """Writes a batch with one time; gives (key, n_ok, committed) of each key."""
        ts = time.time_ns() if ts is None else ts
        shaped = rows.withColumn("key", F.col("key").cast("binary"))
        if "ts" not in shaped.columns:
            shaped = shaped.withColumn("ts", F.lit(ts).cast("long"))
        if "seq" not in shaped.columns:  # one order of arrival for all replicas
            shaped = shaped.withColumn("seq", F.monotonically_increasing_id())
        batch = f"{self.path}/batches/{uuid.uuid4().hex}"
        dealt = self._placed(shaped).withColumn("owner", F.explode("owners"))
        dealt.write.partitionBy("owner").parquet(batch)  # a node reads its own rows only
        placed = self.spark.read.schema(dealt.schema).parquet(batch)
        for node, store in self.stores.items():
            mine = placed.filter(F.col("owner") == node).drop("owners", "owner")
            (self.hints[node] if node in self.down else store).put_batch(mine, ts)
        up = F.size(F.array_except("owners", F.array(*[F.lit(x) for x in sorted(self.down)]).cast("array<string>")))
        acks = placed.filter(F.col("owner") == F.col("owners")[0]).select("key", up.cast("long").alias("n_ok")).distinct()
        return acks.withColumn("committed", F.col("n_ok") >= self.w)

    def delete(self, keys: DataFrame, ts: int | None = None) -> DataFrame:
        gone = keys.select("key", F.lit(None).cast("binary").alias("value"), F.lit(True).alias("tombstone"))
        return self.put_batch(gone, ts)

    def _answers(self, keys: DataFrame) -> DataFrame:
        asked = self._placed(keys.select(F.col("key").cast("binary").alias("key")).distinct())
        out = None
        for i, (node, store) in enumerate(self.stores.items()):
            if node in self.down:
                continue
            mine = asked.filter(F.array_contains("owners", node))
            held = lww.latest(store.log().drop("layer").join(mine, "key", "left_semi"))
            part = mine.select("key").join(held, "key", "left").select(
                "key", F.lit(node).alias("node"), "value", "vector", "ts", F.coalesce("tombstone", F.lit(False)).alias("tombstone"), F.col("ts").isNotNull().alias("found"), F.lit(True).alias("ok"), F.lit(i).alias("resp_order")
            )
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise RuntimeError("no node is up")
        return out

    def get(self, keys: DataFrame, repair: bool = True) -> DataFrame:
        """(key, n_ok, quorum, value, ts, tombstone, found) of each key, from the first R replicas, in the
        order of nodes, that answer; repair takes all answers into account."""
        answers = self._answers(keys)
        if repair:
            self.read_repair(answers)
        won = quorum.read_resolve(answers, self.r).withColumn("found", F.coalesce("found", F.lit(False)))
        return won.withColumn("tombstone", F.when(F.col("found"), F.col("tombstone")))

    def read_repair(self, answers: DataFrame) -> None:
        fixes = quorum.read_repair(answers)
        for (node,) in fixes.select("node").distinct().collect():  # nodes of the ring at most
            self.stores[node].put_batch(fixes.filter(F.col("node") == node).drop("node"))

    def replay_hints(self, node: str) -> None:
        """Gives a node that is up what it missed; hints go once they are written."""
        if node in self.down:
            raise ValueError(f"{node} is down")
        missed = self.hints[node].log()
        if missed.take(1):
            self.stores[node].put_batch(missed.drop("layer"))
            self.hints[node] = Store(self.spark, f"{self.path}/hints={node}-{uuid.uuid4().hex}")

    def search(self, query: list[float], k: int) -> DataFrame:
        """Scatter-gather over the nodes that are up; replicas of a key count once."""
        parts = [s.search(query, k).drop("seq") for x, s in self.stores.items() if x not in self.down]
        merged = parts[0]
        for p in parts[1:]:
            merged = merged.unionByName(p)
        return merged.dropDuplicates(["id"]).orderBy(F.col("score").desc(), "id").limit(max(0, k))

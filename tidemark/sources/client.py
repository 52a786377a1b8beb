"""A record-at-a-time client of a store, and its command line."""

from __future__ import annotations

import argparse
from collections.abc import Iterable

from pyspark.sql import SparkSession

from .store import Store

PUT = "key binary, value binary, vector array<float>, ts long"


def _bytes(x: bytes | str) -> bytearray:
    return bytearray(x if isinstance(x, (bytes, bytearray)) else x.encode())


class Client:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    def put(self, key: bytes | str, value: bytes | str, vector: list[float] | None = None, ts: int | None = None) -> None:
        self.stream_put([{"key": key, "value": value, "vector": vector}], ts=ts)

    def stream_put(self, records: Iterable[dict], batch: int = 2000, ts: int | None = None) -> int:
        """Puts records {key, value, vector?, ts?} in batches, each one commit; gives their number."""
        done, block = 0, []

        def flush() -> None:
            self.store.put_batch(self.spark.createDataFrame(block, PUT).coalesce(1), ts)

        for r in records:
            block.append((_bytes(r["key"]), _bytes(r["value"]), r.get("vector"), r.get("ts")))
            if len(block) == batch:
                flush()
                done, block = done + len(block), []
        if block:
            flush()
        return done + len(block)

    def get(self, key: bytes | str) -> bytes | None:
        """The live value, or None."""
        row = self.store.get(self.spark.createDataFrame([(_bytes(key),)], "key binary")).first()
        return bytes(row["value"]) if row["outcome"] == "live" and row["value"] is not None else None

    def delete(self, key: bytes | str, ts: int | None = None) -> None:
        self.store.delete(self.spark.createDataFrame([(_bytes(key),)], "key binary"), ts)

    def search(self, vector: list[float], top_k: int = 5) -> list[dict]:
        return [{"key": bytes(r["key"]), "value": bytes(r["value"] or b""), "score": r["score"]} for r in self.store.search(vector, top_k).collect()]


def numbers(text: str) -> list[float]:
    """Comma-separated numbers; what is none counts as 0."""
    out = []
    for x in text.split(","):
        try:
            out.append(float(x))
        except ValueError:
            out.append(0.0)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("--store", required=True)
    commands = parser.add_subparsers(dest="command", required=True)
    put = commands.add_parser("put")
    put.add_argument("key")
    put.add_argument("value")
    put.add_argument("--vector")
    for name in ("get", "delete"):
        commands.add_parser(name).add_argument("key")
    search = commands.add_parser("search")
    search.add_argument("vector")
    search.add_argument("-k", type=int, default=5)
    commands.add_parser("status")
    commands.add_parser("compact")
    a = parser.parse_args(argv)
    client = Client(spark or SparkSession.builder.getOrCreate(), a.store)
    if a.command == "put":
        client.put(a.key, a.value, [float(x) for x in a.vector.split(",")] if a.vector else None)
    elif a.command == "get":
        value = client.get(a.key)
        print("not found" if value is None else value.decode("utf-8", "replace"))
        return int(value is None)
    elif a.command == "delete":
        client.delete(a.key)
    elif a.command == "search":
        for r in client.search(numbers(a.vector), a.k):
            print(f"{r['key'].decode('utf-8', 'replace')}\t{r['score']:.6f}\t{r['value'].decode('utf-8', 'replace')}")
    elif a.command == "compact":
        client.store.compact()
    else:
        print(client.store.status().first().asDict())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

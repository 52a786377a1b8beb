"""A store of records: immutable Parquet runs under a manifest.

Every put or delete batch is a run of its own, written whole before a manifest
names it; readers see the runs of the newest manifest. Compaction writes the
merged run, publishes a manifest with it, and retires the old runs: they are
removed some time later (``KEEP_S``), when no reader needs them any more. Rows
arrive in the order of (batch, seq): the manifest numbers the batches, ``seq``
orders a batch's rows, so that equal times go to the first arrival.

Writers that meet take turns by creating the next manifest, which is exclusive
where the file system's rename is (HDFS and its like). On an object store whose
rename replaces, only one writer at a time may publish.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lww, scan, vector
from ..schema import STORED
from . import files

#: Parquet settings of a run: a Bloom filter on the key needs plain encoding.
RUN_OPTIONS = {"parquet.bloom.filter.enabled#key": "true", "parquet.enable.dictionary#key": "false", "compression": "zstd"}
#: Seconds that retired runs stay for readers of older manifests.
KEEP_S = 86_400
#: Runs of a manifest whose table is broadcast; more, and it is joined as any table.
MOST_RUNS = 100_000


class Store:
    """Put, get, delete, search, scan and compaction over runs in ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # Manifest

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in files.names(self.spark, f"{self.path}/manifest") if n.endswith(".json"))

    def manifest(self) -> dict:
        """The newest manifest: version, next_batch, runs [{id, batch}] from old to new, retired [{id, at}]."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "next_batch": 0, "runs": [], "retired": []}
        return json.loads(files.read_text(self.spark, f"{self.path}/manifest/{versions[-1]:020d}.json"))

    def _publish(self, change) -> dict:
        """Writes the next manifest; if another writer was first, applies the change anew."""
        while True:
            new = change(self.manifest())
            new["version"] += 1
            if files.write_text(self.spark, f"{self.path}/manifest/{new['version']:020d}.json", json.dumps(new)):
                return new

    def _run(self, run_id: str) -> str:
        return f"{self.path}/runs/{run_id}"

    # Writes

    def put_batch(self, rows: DataFrame, ts: int | None = None) -> str:
        """Appends puts: key, value and optionally ts, tombstone, vector. Rows without ts get one time.

        Arrival order within the batch is the order of ``seq`` if given, of (batch, seq) if the rows
        come from another store, else of the rows as read.
        """
        now = F.lit(time.time_ns() if ts is None else ts).cast("long")
        has = set(rows.columns)
        if "batch" in has:
            rows, has = rows.orderBy("batch", "seq").drop("batch", "seq"), has - {"batch", "seq"}
        order = F.col("seq") if "seq" in has else F.monotonically_increasing_id()
        shaped = rows.select(
            F.lit(None).cast("long").alias("batch"),
            F.col("key").cast("binary").alias("key"),
            F.col("value").cast("binary").alias("value"),
            F.coalesce(F.col("ts").cast("long"), now).alias("ts") if "ts" in has else now.alias("ts"),
            F.coalesce(F.col("tombstone"), F.lit(False)).alias("tombstone") if "tombstone" in has else F.lit(False).alias("tombstone"),
            order.cast("long").alias("seq"),
            F.col("vector").cast("array<float>").alias("vector") if "vector" in has else F.lit(None).cast("array<float>").alias("vector"),
        )
        run_id = uuid.uuid4().hex
        shaped.sortWithinPartitions("key", "seq").write.options(**RUN_OPTIONS).parquet(self._run(run_id))

        def change(m: dict) -> dict:
            return m | {"next_batch": m["next_batch"] + 1, "runs": [*m["runs"], {"id": run_id, "batch": m["next_batch"]}]}

        self._publish(change)
        return run_id

    def delete(self, keys: DataFrame, ts: int | None = None) -> str:
        """Appends a tombstone for each key."""
        return self.put_batch(keys.select("key", F.lit(None).cast("binary").alias("value"), *[c for c in ("ts",) if c in keys.columns], F.lit(True).alias("tombstone")), ts)

    # Reads

    def log(self) -> DataFrame:
        """All rows of all runs, with ``layer``, the run's place; (batch, seq) is their order of arrival."""
        runs = self.manifest()["runs"]
        if not runs:
            return self.spark.createDataFrame([], STORED).withColumn("layer", F.lit(0))
        # One scan of all runs; the manifest, a row per run, tells each file's place.
        places = self.spark.createDataFrame([(r["id"], i, r["batch"]) for i, r in enumerate(runs)], "run string, layer int, of long")
        rows = self.spark.read.schema(STORED).parquet(*[self._run(r["id"]) for r in runs])
        rows = rows.withColumn("run", F.regexp_extract("_metadata.file_path", "/runs/([0-9a-f]{32})/", 1))
        rows = rows.join(F.broadcast(places) if len(runs) <= MOST_RUNS else places, "run")
        return rows.select(F.coalesce("batch", "of").alias("batch"), "key", "value", "ts", "tombstone", "seq", "vector", "layer")

    def view(self) -> DataFrame:
        """The current version of each key, tombstones included."""
        return lww.latest(self.log().drop("vector", "layer"))

    def get(self, keys: DataFrame) -> DataFrame:
        return lww.lookup(self.log().drop("vector", "layer"), keys.select(F.col("key").cast("binary").alias("key")))

    def scan_since(self, ts: int, vectors: bool = False) -> DataFrame:
        """Current versions since a time, tombstones included.

        With ``vectors``, what a replica needs: the vectors too, and the puts that brought the last
        ones where they are other versions.
        """
        if vectors:
            return lww.essential(scan.scan_since(self.log().drop("layer"), ts))
        return scan.sync_rows(self.log().drop("vector", "layer"), ts)

    def search(self, query: list[float], k: int, live_only: bool = True) -> DataFrame:
        """The k nearest vectors: the last arrival of each key's vector, without deleted keys if ``live_only``."""
        log = self.log()
        puts = log.filter("size(vector) > 0").select(F.decode("key", "UTF-8").alias("id"), "key", "value", "vector", "batch", "seq")
        vectors = vector.latest_vectors(puts)
        if live_only:
            vectors = vector.searchable(vectors, log.drop("vector", "layer"))
        return vector.knn(vectors, query, k)

    # Maintenance

    def compact(self, keep_s: float = KEEP_S) -> None:
        """Merges the present runs into one: each key's winner and the put of its last vector.

        The old runs are retired, and runs retired more than ``keep_s`` seconds ago removed.
        """
        old = self.manifest()["runs"]
        if len(old) >= 2:
            run_id = uuid.uuid4().hex
            merged = lww.essential(self.log().drop("layer")).select(*STORED.names)
            merged.repartitionByRange("key").sortWithinPartitions("key").write.options(**RUN_OPTIONS).parquet(self._run(run_id))
            gone = {r["id"] for r in old}

            def change(m: dict) -> dict:
                retired = [*m["retired"], *({"id": r["id"], "at": time.time()} for r in old)]
                return m | {"runs": [{"id": run_id, "batch": old[-1]["batch"]}, *[r for r in m["runs"] if r["id"] not in gone]], "retired": retired}

            self._publish(change)
        self.vacuum(keep_s)

    def vacuum(self, keep_s: float = KEEP_S) -> None:
        """Removes runs that were retired more than ``keep_s`` seconds ago."""
        due = {r["id"] for r in self.manifest()["retired"] if time.time() - r["at"] >= keep_s}
        for run_id in due:
            files.remove(self.spark, self._run(run_id))
        if due:
            self._publish(lambda m: m | {"retired": [r for r in m["retired"] if r["id"] not in due]})

    def sync_from(self, peer: Store, since: int = 0) -> str:
        """Takes a peer's current versions since a time, vectors included, as a batch of its own."""
        return self.put_batch(peer.scan_since(since, vectors=True))

    def backup(self, path: str) -> None:
        """The current log as gzip-compressed Parquet in any store that Spark reaches."""
        self.log().drop("layer").write.option("compression", "gzip").parquet(path)

    def status(self) -> DataFrame:
        m = self.manifest()
        return self.spark.createDataFrame([(m["version"], len(m["runs"]), True)], "version long, runs int, alive boolean")

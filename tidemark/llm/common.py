"""Shared plumbing of the training-data operators.

Nothing here depends on a particular operator: reading tables, the shared
scratch folder, shipping this package to executors, ASCII lower-casing and
the word pattern every text operator uses.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import os
import shutil
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes other than space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"
#: Upper bound on the text that one Arrow batch hands to a Python worker.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2000
#: Scratch tables are read only once their job is done: no marker file tells so.
NO_MARK = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
#: Rows of a file of a small written table.
ROWS_PER_FILE = 250_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column | str) -> Column:
    """Lower-cases A-Z only; every other character stays as it is."""
    return F.translate(c, UPPER, LOWER)


def crc_mod(c: Column | str, m: int) -> Column:
    """crc32 of a value's decimal text, modulo ``m``; null counts as ''."""
    c = F.col(c) if isinstance(c, str) else c
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once per application, and bounds Arrow batches.

    Executors import the operators from the zip that the driver serves, so the
    repository need not be installed on them.
    """
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(path := os.path.join(folder, "tidemark_pkg.zip"), "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(top, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    sc._tidemark_shipped = True


def tidy(run):
    """A function of Arrow batches that gives back the memory it freed when its task ends.

    Worker processes outlive their tasks; without this the next operator's
    tasks would run beside what allocators still hold for the last one's.
    """

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return task


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in its absence,
    on a local master only (tests), a temporary folder that is then set as such."""
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        folder = getattr(spark.sparkContext, "_tidemark_scratch", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            local = tempfile.mkdtemp(prefix="tidemark-shared-")
            atexit.register(shutil.rmtree, local, ignore_errors=True)
            folder = spark.sparkContext._tidemark_scratch = f"file://{local}"
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Scratch:
    """Written tables in the shared folder; they cut lineage and survive lost executors.

    ``save`` writes a DataFrame and returns it as read from there; ``drop``
    removes tables that no later step reads. Results are read from here, so a
    folder stays until its user removes it (:func:`swept`).
    """

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top, self.n = spark, f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}", 0
        Scratch.made.append(self)

    def path(self) -> str:
        self.n += 1
        return f"{self.top}/{self.n}"

    def save(self, df: DataFrame, rows: int | None = None, codec: str = "zstd") -> DataFrame:
        """``rows``, an upper bound where one is known, keeps small tables from being many tiny files."""
        path = self.path()
        if rows is not None and (n := max(1, -(-rows // ROWS_PER_FILE))) < partitions(self.spark):
            df = df.repartition(n)
        df.write.options(**{"compression": codec, **NO_MARK}).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidemark_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self.remove(df._tidemark_path)

    def remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def swept():
    """Removes, behind the block, the folders of the scratch tables that operators made in it."""
    at = len(Scratch.made)
    try:
        yield
    finally:
        for scratch in Scratch.made[at:]:
            scratch.remove(scratch.top)
        del Scratch.made[at:]


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df``, of ``rows`` counted rows, marked for broadcast if these are ``most`` at most, else as it is."""
    return F.broadcast(df) if rows <= most else df


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

"""Quality by importance resampling of hashed n-grams, sampled by Gumbel top-k.

Two bag-of-n-grams models over hashed words and word pairs, of the target
(documents labelled of good quality) and of the raw corpus. A document's log
importance weight is the sum over its n-grams of log p_target - log p_raw.
Adding Gumbel noise and keeping the k largest keys samples k documents without
replacement in proportion to the weights.

Scale: the raw model counts every document; each task sums its own vector of
BUCKETS counts, so what is gathered is bounded by tasks x buckets. The target
model is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``), found
by id as the corpus is counted, so no text is joined. The cut of the top k is
found by narrowing a histogram of keys, a pass over the written keys each;
nothing is sorted but the few rows of the last bin. Noise is a hash of the key
and a seed: reruns agree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, ship, table, tidy

BUCKETS = 1 << 14
SMOOTHING = 0.5
SAMPLE_ROWS = 50_000
#: The share of documents that the registered query keeps.
KEEP = 0.8
SEED = "gumbel-1"
CACHE = 500_000
BINS, LAST_BIN = 4096, 10_000


class Hashes(dict):
    """crc32 of words, kept by word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = zlib.crc32(word)
        return h


def grams(words: np.ndarray) -> np.ndarray:
    """Bucket numbers of a document's words and pairs, from the words' hashes."""
    one = words * np.uint64(0x9E3779B97F4A7C15)
    two = (words[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[1:]) * np.uint64(0x9E3779B97F4A7C15)
    return (np.concatenate([one, two]) >> np.uint64(40)).astype(np.int64) % BUCKETS


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    known = Hashes()
    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            words = (text or b"").lower().split()
            out.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
            if len(known) > CACHE:
                known.clear()
        yield batch.column(0).to_pylist(), out


_COUNTS = pa.schema([("bucket", pa.int32()), ("target", pa.int64()), ("raw", pa.int64())])


def _count(target: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for ids, docs in _hashed(batches):
            for i, words in zip(ids, docs, strict=True):
                if len(words):
                    n = np.bincount(grams(words), minlength=BUCKETS)
                    total[1] += n
                    if i in target:
                        total[0] += n
        yield pa.record_batch([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(total[0]), pa.array(total[1])], schema=_COUNTS)

    return tidy(run)


_WEIGHTS = pa.schema([("id", pa.int64()), ("n_grams", pa.int64()), ("log_weight", pa.float64())])


def _weigh(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, docs in _hashed(batches):
            buckets = [grams(words) if len(words) else np.zeros(0, np.int64) for words in docs]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(b) for b in buckets], pa.int64()), pa.array([float(ratio[b].sum()) for b in buckets])], schema=_WEIGHTS)

    return tidy(run)


def gumbel(key: Column, seed: str = SEED) -> Column:
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return -F.log(-F.log(u))


def top_k(rows: DataFrame, k: int, order: str, tie: str, name: str, apart: str | None = None) -> DataFrame:
    """``rows`` (best a written table, it is read several times) with a boolean column ``name``:
    whether the row is among the k of the largest ``order``, ties to the smaller ``tie``, null ties last.

    Rows alike in both are told apart by the smaller ``apart``, a unique number of each row; without
    it arbitrarily, and in one task. ``order`` must not be null or NaN.
    """
    keyed = rows.withColumn("__tie", F.coalesce(-F.col(tie), F.lit(-(2**63) + 1)))
    keyed = keyed.withColumn("__apart", -F.col(apart)) if apart else keyed
    return _largest(keyed, k, [order, "__tie", *(["__apart"] if apart else [])], name).drop("__tie", "__apart")


def _largest(rows: DataFrame, k: int, keys: list[str], name: str) -> DataFrame:
    """Narrows the first key down to the bin that holds the cut; if one value is left, goes on with the next key."""
    order = keys[0]
    lo, hi, n = rows.agg(F.min(order), F.max(order), F.count("*")).first()
    if k <= 0 or n <= k:
        return rows.withColumn(name, F.lit(bool(k > 0)))
    within, rest = F.lit(True), k
    above = F.lit(False)
    while n > LAST_BIN:
        width = (hi - lo) / BINS
        if not width > 0 or lo + width <= lo:
            break
        bins = F.least(F.floor((F.col(order).cast("double") - F.lit(float(lo))) / F.lit(width)), F.lit(BINS - 1)).cast("int")
        sums = rows.filter(within).groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi")).collect()  # BINS rows at most
        for r in sorted(sums, key=lambda r: -r["bin"]):
            if rest <= r["n"]:
                break
            rest -= r["n"]
        if r["lo"] == lo and r["hi"] == hi:
            break
        lo, hi, n = r["lo"], r["hi"], r["n"]
        above = F.col(order) > F.lit(hi)
        within = (F.col(order) >= F.lit(lo)) & (F.col(order) <= F.lit(hi))
    if n > LAST_BIN and lo == hi and keys[1:]:
        edge = _largest(rows.filter(within), rest, keys[1:], name)
    else:
        edge = rows.filter(within).withColumn(name, F.row_number().over(Window.orderBy(*[F.col(c).desc() for c in keys])) <= rest)
    return rows.filter(~within).withColumn(name, above).unionByName(edge)


def importance_sample(docs: DataFrame, labels: DataFrame, scratch: Scratch, keep: float = KEEP, key: str = "doc_id", text: str = "text", label: str = "quality", seed: str = SEED) -> DataFrame:
    """One row per document: key, n_grams, log_weight, gumbel_key, kept.

    ``keep`` of all rows, rounded down, are kept. Target rows are those whose
    label is positive (SAMPLE_ROWS of smallest hash at most); without any, all
    weights are 0 and the sample is uniform. Null, empty and wordless texts
    weigh 0; very long ones are counted and weighed whole. Rows that repeat a
    key share its noise; if they tie, some are kept as the cut demands. Columns other
    than key and text, whatever their names, are not read. No rows give none.
    """
    ship(docs.sparkSession)
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    good = labels.filter(F.col(label) > 0).select(F.col(key).cast("long").alias("id")).filter("id is not null").distinct()
    target = frozenset(r[0] for r in good.orderBy(F.crc32(F.col("id").cast("string").cast("binary")), "id").limit(SAMPLE_ROWS).collect())
    counts = slim.mapInArrow(_count(target), "bucket int, target bigint, raw bigint").groupBy("bucket").agg(F.sum("target"), F.sum("raw"))
    total = np.zeros((2, BUCKETS))
    for b, t, r in counts.collect():  # BUCKETS rows
        total[:, b] = t, r
    p = (total + SMOOTHING) / (total.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
    ratio = np.log(p[0]) - np.log(p[1]) if total[0].any() else np.zeros(BUCKETS)
    weighed = slim.mapInArrow(_weigh(ratio), "id bigint, n_grams bigint, log_weight double")
    rows = scratch.save(weighed.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("id"), seed)).withColumn("row", F.monotonically_increasing_id()))
    return top_k(rows, int(rows.count() * keep), "gumbel_key", "id", "kept", "row").drop("row").withColumnRenamed("id", key)


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op10"))

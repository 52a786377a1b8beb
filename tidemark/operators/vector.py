"""Exact vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from .lww import arrival, tombstones

#: Queries scored against each batch of the corpus at once; more make more passes.
BLOCK_QUERIES = 4096
#: Rows of the corpus scored at once.
BLOCK_ROWS = 1024


def latest_vectors(vectors: DataFrame) -> DataFrame:
    """The last arrival of each id, whatever its time: vectors are versioned by arrival."""
    rest = [c for c in vectors.columns if c != "id"]
    won = vectors.groupBy("id").agg(F.max_by(F.struct(*rest), arrival(vectors)).alias("won"))
    return won.select("id", "won.*").select(*vectors.columns)


def scores(corpus: DataFrame, query: list[float]) -> DataFrame:
    wanted = F.array(*[F.lit(float(x)) for x in query]) if query else F.array().cast("array<double>")
    return corpus.withColumn("score", cosine(F.col("vector"), wanted))


def knn(corpus: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k rows nearest to one query: top k of each task, then of all. Ties go to the smaller id."""
    if k <= 0:
        return scores(corpus, query).limit(0)
    return scores(corpus, query).filter(~F.isnan("score")).orderBy(F.col("score").desc(), "id").limit(k)


_OUT = pa.schema([("qid", pa.string()), ("id", pa.string()), ("score", pa.float64())])


def _nearest(qids: list[str], queries: np.ndarray, k: int):
    norms = np.linalg.norm(queries, axis=1)
    asked = pa.array(qids, pa.string())
    unit = np.divide(queries, norms[:, None], out=np.zeros_like(queries), where=norms[:, None] > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                order = pc.sort_indices(batch.column(0))
                names, vectors = batch.column(0).take(order), batch.column(1).take(order)
                fits = (pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False) == unit.shape[1]) & (pc.list_value_length(vectors).is_valid().to_numpy(zero_copy_only=False))
                block = np.zeros((len(names), unit.shape[1]))
                if fits.any() and unit.shape[1]:
                    block[fits] = vectors.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, unit.shape[1])
                size = np.linalg.norm(block, axis=1)
                block = np.divide(block, size[:, None], out=np.zeros_like(block), where=size[:, None] > 0)
                score = unit @ block.T
                score[np.isnan(score)] = -np.inf
                # Per query what is at or above the block's k-th score, then the best of it; rows are in order of id.
                top = min(k, len(names))
                least = np.partition(score, len(names) - top, axis=1)[:, len(names) - top]
                q, row = np.nonzero((score >= least[:, None]) & np.isfinite(score))
                s = score[q, row]
                best = np.lexsort((row, -s, q))
                q, row, s = q[best], row[best], s[best]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                q, row, s = (x[place < k] for x in (q, row, s))
                yield pa.record_batch([asked.take(pa.array(q)), names.take(pa.array(row)), pa.array(s)], schema=_OUT)

    return run


def knn_batch(corpus: DataFrame, queries: list[tuple[str, list[float]]], k: int) -> DataFrame:
    """(qid, rank, id, score): the k nearest rows of each query, in blocks of queries against all rows.

    Each batch is scored by one matrix product and gives its k best per query;
    a ranking, limited per group before and after its shuffle, picks the final
    ones. Vectors of another length, null and zero vectors score 0.
    """
    spark = corpus.sparkSession
    out = spark.createDataFrame([], "qid string, id string, score double")
    widths = sorted({len(v) for _, v in queries})
    for width in widths if k > 0 else []:
        same = [(q, v) for q, v in queries if len(v) == width]
        for at in range(0, len(same), BLOCK_QUERIES):
            part = same[at : at + BLOCK_QUERIES]
            found = corpus.select("id", "vector").mapInArrow(_nearest([q for q, _ in part], np.array([v for _, v in part], np.float64), k), "qid string, id string, score double")
            out = found if out is None else out.unionByName(found)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "id"))
    return out.withColumn("rank", place).filter(F.col("rank") <= k).select("qid", "rank", "id", "score")


def knn_sharded(shards: list[DataFrame], query: list[float], k: int) -> DataFrame:
    """Scatter-gather: the k best of each shard, one row per key (replicas of a key meet), then the k best."""
    parts = [knn(s, query, k) for s in shards]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return merged.dropDuplicates(["id"]).orderBy(F.col("score").desc(), "id").limit(max(0, k))


def searchable(vectors: DataFrame, log: DataFrame) -> DataFrame:
    """Vectors whose key's current version is not a delete (keys without a version stay)."""
    return vectors.join(tombstones(log).select("key"), "key", "left_anti")

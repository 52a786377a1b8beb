"""Exact deduplication by deterministic block naming.

Texts are cut into fixed-size blocks; equal blocks get one integer name by
sorting, adjacent pairs of names are named again by sorting, level by level,
until each text has a single name. Names are never hashes: two texts share a
name if and only if they are identical byte for byte.

Scale: block contents are shuffled once, as name buckets sorted by content.
Each Arrow batch first merges its own equal texts and equal blocks, so a group
of copies that holds a third of all rows reaches a name bucket at most once a
batch, as three numbers; the ids of its rows go elsewhere, spread by batch. Pairs are made distinct (combined on the map side) before they are
sorted and named, and joined back by a join whose skewed side Spark can split.
A level handles only texts that still have several names, half as many as the
level before; a text of b blocks takes ceil(log2 b) levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, ship, table, tidy

BLOCK = 4096
#: Name buckets for each shuffle partition: more make smaller sorts.
BUCKETS = 64

_OCC = pa.list_(pa.struct([("rep", pa.int64()), ("pos", pa.int32()), ("n", pa.int32())]))
_BLOCKS = pa.schema([("block", pa.binary()), ("occ", _OCC), ("rep", pa.int64()), ("members", pa.list_(pa.int64())), ("sha", pa.string())])
_BLOCKS_SQL = "block binary, occ array<struct<rep:bigint,pos:int,n:int>>, rep bigint, members array<bigint>, sha string"


def _cut(size: int):
    """Batches of (id, content) to rows of two kinds: blocks with where they occur, and, with a null
    block, representatives. One stands for the equal texts of a batch and has their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts: dict[bytes, list] = {}
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(text or b"", []).append(i)
            found: dict[bytes, list] = {}
            reps, shas = range(rep, rep + len(texts)), []
            for rep, text in zip(reps, texts, strict=True):  # noqa: PLW2901
                n = max(1, -(-len(text) // size))
                shas.append(hashlib.sha256(text).hexdigest())
                for pos in range(n):
                    found.setdefault(text[pos * size : (pos + 1) * size], []).append({"rep": rep, "pos": pos, "n": n})
            rep = reps.stop
            f, r = len(found), len(reps)
            columns = [[*found, *[None] * r], [*found.values(), *[None] * r], [None] * f + [*reps], [*[None] * f, *texts.values()], [None] * f + shas]
            yield pa.record_batch([pa.array(c, x.type) for c, x in zip(columns, _BLOCKS, strict=True)], schema=_BLOCKS)

    return tidy(run)


def _named(df: DataFrame, by: list[str], buckets: int, deal: list[str] | None = None) -> DataFrame:
    """``df`` with a column ``name``: equal values of ``by`` have equal names, others never.

    Buckets deal the values out; within one, values are sorted and numbered.
    ``deal``, further columns to deal by, must be null wherever ``by`` counts.
    """
    bucket = F.pmod(F.xxhash64(*by, *(deal or [])), F.lit(buckets))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy(*by))
    return df.withColumn("bucket", bucket).withColumn("name", F.col("bucket") + F.lit(buckets) * rank).drop("bucket")


def identities(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(rep, members, sha, level, name): one row per representative.

    Two representatives have equal texts if and only if (level, name) are equal.
    ``members`` are the keys of the equal texts it stands for.
    """
    spark = docs.sparkSession
    ship(spark)
    buckets = BUCKETS * partitions(spark)
    blocks = docs.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`").cast("binary")).mapInArrow(_cut(block), _BLOCKS_SQL)
    # One shuffle for both kinds: blocks by their content, representatives by their number.
    names = scratch.save(_named(blocks, ["block"], buckets, ["rep"]).select("occ", "rep", "members", "sha", "name"))
    first = names.filter("occ is not null").select(F.explode("occ").alias("o"), "name").select("o.*", "name")
    info = names.filter("occ is null").select("rep", "members", "sha")
    done, level = [first.filter("n = 1").select("rep", F.lit(0).alias("level"), "name")], 0
    now = first.filter("n > 1").select("rep", "pos", "n", "name")
    longest, rows = first.agg(F.coalesce(F.max("n"), F.lit(1)), F.count("*")).first()
    while longest > 1:
        level, longest = level + 1, -(-longest // 2)
        half = F.col("pos").bitwiseAND(F.lit(1))
        pairs = now.groupBy("rep", F.shiftright("pos", 1).alias("pos"), F.shiftright(F.col("n") + 1, 1).alias("n")).agg(
            F.max(F.when(half == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        pairs = scratch.save(pairs, rows)
        known = _named(pairs.select("left", "right").distinct(), ["left", "right"], buckets)
        step = scratch.save(pairs.join(known, ["left", "right"]).select("rep", "pos", "n", "name"), rows)
        scratch.drop(pairs)
        done.append(step.filter("n = 1").select("rep", F.lit(level).alias("level"), "name"))
        now = step.filter("n > 1")
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return info.join(found, "rep")


def exact_dedup(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256.

    Of identical texts the row with the largest key stays; if that key is
    repeated, exactly one of its rows does. Null keys come before all others.
    Null text counts as empty, and empty texts are equal. A very long text is
    as many blocks as it takes, never a row of its whole content. Columns other
    than key and text, whatever their names, are not read. No rows give none.
    """
    reps = scratch.save(identities(docs, scratch, key, text, block))
    rows = reps.select("level", "name", "rep", F.size("members").alias("size"), F.array_max(F.transform("members", lambda m, i: F.struct(m.alias("id"), F.col("rep").alias("rep"), i.alias("i")))).alias("top"))
    groups = rows.groupBy("level", "name").agg(F.sum("size").alias("group_size"), F.max("top").alias("keep"))
    out = reps.join(groups, ["level", "name"]).select("rep", "sha", "group_size", "keep", F.posexplode("members").alias("i", "id"))
    return out.select(
        F.col("id").alias(key),
        F.col("keep.id").alias("keep_id"),
        F.col("group_size").cast("long"),
        ((F.col("rep") == F.col("keep.rep")) & (F.col("i") == F.col("keep.i"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), Scratch(spark, "op7"))


ORACLE = """
WITH g AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM g WINDOW w AS (PARTITION BY t)
"""

"""Binary log files: frames of crc32, time, mark, lengths, key, value."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import wal_frame, wal_payload

HEADER = struct.Struct("<IqBII")

_ROWS = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("key", pa.binary()), ("value", pa.binary()), ("ts", pa.int64()), ("tombstone", pa.bool_())])


def frames(data: bytes) -> Iterator[tuple[int, bytes, bytes, int, bool]]:
    """(offset, key, value, ts, tombstone) of the longest valid prefix."""
    at = 0
    while at + HEADER.size <= len(data):
        crc, ts, mark, klen, vlen = HEADER.unpack_from(data, at)
        end = at + HEADER.size + klen + vlen
        if end > len(data) or zlib.crc32(data[at + 4 : end]) != crc:
            return
        key_at = at + HEADER.size
        yield at, data[key_at : key_at + klen], data[key_at + klen : end], ts, mark == 1
        at = end


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = [(path, *f) for f in frames(data)]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_ROWS), _ROWS, strict=True)], schema=_ROWS)


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """Rows of log files: each file up to its first damaged or incomplete frame. Deletes stay deletes."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInArrow(_parse, "path string, offset bigint, key binary, value binary, ts bigint, tombstone boolean")


def to_frames(log: DataFrame) -> DataFrame:
    """(seq, frame, crc): each row's bytes and checksum."""
    parts = [F.col(c) for c in ("key", "value", "ts", "tombstone")]
    return log.select("seq", wal_frame(*parts).alias("frame"), F.crc32(wal_payload(*parts)).alias("crc"))

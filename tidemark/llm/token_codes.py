"""Token ids as directly addressable codes, with random access to any token.

File format (a *segment*, little-endian): ids are split into chunks of
``width`` bits, low chunk first. Level 0 holds the lowest chunk of every id in
order; level k+1 holds the next chunk of those ids that have one, in the same
order. Each level has a continuation bitmap (bit i: id i of the level goes on)
and a rank directory, the number of set bits before every 512th bit. The token
at position i is read by following its bit: its place in the next level is the
rank of its bit, found by one directory entry and at most 512 bits. Nothing
else is read or decoded, from memory or from storage.

    header          8 bytes b"TIDEDAC2", u32 width, u32 levels, u32 part, u32 seq,
                    u64 at, u64 tokens, u64 documents
    directory       for each level u64 n, u64 place of its first byte in the segment
    documents       i64 doc_id each, u8 present (0: null id) each, u64 start each
    level, each     chunks   n x u8 (width 8) or u16 (width 16),
                    bitmap   ceil(n / 8) bytes,
                    ranks    ceil(n / 512) x u32

A dataset has raw files of at most ``FILE_SEGMENTS`` segments, each followed by
a line feed, in ``kind=segments``, and their index, a line of text for each
segment, in ``kind=index`` (``INDEX``). Part is the place of a range of
doc_ids, seq counts within it and ``at`` is the number of tokens of the part
before the segment. Both are written by Spark, so any store that it reaches
holds them; :class:`TokenFiles` reads single tokens by byte ranges.

Scale: one shuffle, by ranges of (doc_id, hash of the text); each task encodes
its range in order and closes a segment after a bounded number of tokens. The
prefix sum over parts is the only thing the driver sees: one number a part.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import threading
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_MARK, Scratch, partitions, ship, table, tidy

MAGIC = b"TIDEDAC2"
HEAD = struct.Struct("<8sIIIIQQQ")
WIDTH = 8
RANK_STEP = 512
END = 0
#: A segment closes at the first document end after so many tokens.
SEGMENT_TOKENS = 1 << 18
#: Segments of a file, and the columns of a line of the index (size: bytes of the segment at the file's offset).
FILE_SEGMENTS = 64
INDEX = "part int, seq int, file int, offset long, size long, at long, n_tokens long, n_docs long"
#: Pieces of text whose ids a worker keeps: about 0.2 kB each, beside other stages or alone.
CACHE, LARGE_CACHE = 150_000, 1_200_000
IDLE_S = 5


class Encoder:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library.

    Such a tokenizer merges only within pieces cut by a fixed pattern, so a
    text's ids are those of its pieces one after another; pieces that come
    often are encoded once and kept. Where white space comes singly and no
    other sign stands before a closing . or , the cuts are plain splits; other
    texts are cut by the pattern; texts with characters outside a range where
    the pattern's character classes are beyond doubt, or with an added token's
    string, are encoded whole.
    """

    #: The pattern that cuts pieces, the characters it is used on, and
    #: white space or signs that call for the pattern rather than plain splits.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    STRANGE = r"[^\t\n\r -~\x{a1}-\x{17f}]"
    UNEVEN = r"[\t\r]|[ \n][ \n]|(?:\A|[^a-zA-Z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17f}])[.,](?:[ \n]|\z)"
    CUT = "\0"

    def __init__(self, file: str, most: int = CACHE):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(file)
        self.pieces = regex.compile(self.PATTERN).findall
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cuts = "use_regex=True" in repr(self.tokenizer.pre_tokenizer) and self.tokenizer.normalizer is None
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.most = most
        self.index: dict[str, int] = {}
        self.flat, self.start, self.n, self.hits, self.used = np.zeros(1 << 16, np.uint32), *(np.zeros(1 << 14, np.int32) for _ in range(3)), 0

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of even texts one after another, and how many each text has.

        A line end put behind each text ends its last word; the two pieces that
        it makes are the last ones.
        """
        c, x = self.CUT, pc.binary_join_element_wise(texts, "\n", "")
        for sign in (".", ","):
            for space in (" ", "\n"):
                x = pc.replace_substring(x, sign + space, c + sign + space)
        x = pc.replace_substring(pc.replace_substring(x, "\n", f"{c}\n{c}"), " ", f"{c} ")
        lists = pc.split_pattern(x, c)
        return lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)

    def _forget(self) -> None:
        """Keeps the half of the pieces that came most often of late."""
        names = list(self.index)
        keep = np.sort(np.argsort(-self.hits[: len(names)], kind="stable")[: self.most // 2])
        n, before = self.n[keep], self.start[keep]
        start = np.cumsum(n, dtype=np.int64) - n
        flat = self.flat[np.repeat(before - start, n) + np.arange(int(n.sum()))]
        self.index = dict(zip((names[i] for i in keep.tolist()), range(len(keep)), strict=True))
        self.used = len(flat)
        self.flat[: self.used], self.start[: len(keep)], self.n[: len(keep)] = flat, start, n
        self.hits[:] = 0

    def _learn(self, pieces: list[str]) -> None:
        """Encodes new pieces; those without a line end as the lines of one text."""
        plain = [p for p in pieces if p and not p[-1].isspace()] if len(self.line) == 1 else []
        rest = [p for p in pieces if not p or p[-1].isspace()] if len(self.line) == 1 else pieces
        for e in range(0, len(plain), 20_000):
            part = plain[e : e + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.append(np.nonzero(ids == self.line[0])[0], len(ids))
            if len(ends) != len(part):  # a line end within a piece
                rest = rest + part
            else:
                self._keep(part, np.diff(ends, prepend=-1) - 1, np.delete(ids, ends[:-1]))
        for e in range(0, len(rest), 10_000):
            part = rest[e : e + 10_000]
            found = [x.ids for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            n = np.fromiter(map(len, found), np.int64, len(found))
            self._keep(part, n, np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum())))

    def _keep(self, pieces: list[str], n: np.ndarray, ids: np.ndarray) -> None:
        k, total = len(self.index), len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + len(pieces) > len(self.n):
            self.start, self.n, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.n, self.hits))
        self.flat[self.used : self.used + total] = ids
        self.n[k : k + len(pieces)] = n
        self.start[k : k + len(pieces)] = self.used + np.cumsum(n) - n
        self.used += total
        self.index.update(zip(pieces, range(k, k + len(pieces)), strict=True))

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Places of distinct pieces; new ones are learned."""
        places = list(map(self.index.get, pieces))
        if None in places:
            new = [p for p, i in zip(pieces, places, strict=True) if i is None]
            if len(self.index) + len(new) > self.most and len(self.index) > self.most // 2:
                self._forget()
                new = [p for p in pieces if p not in self.index]
            self._learn(new)
            places = list(map(self.index.__getitem__, pieces))
        return np.array(places, np.int64)

    def _ids(self, pieces: pa.Array, sizes: np.ndarray, ending: int) -> list[np.ndarray]:
        """The ids of texts of so many pieces each, without those of the last ``ending`` pieces of each."""
        coded = pieces.dictionary_encode()
        k = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        self.hits[: len(self.index)] += np.bincount(k, minlength=len(self.index))
        n, ends = self.n[k].astype(np.int64), np.cumsum(sizes)
        for last in range(1, ending + 1):
            n[ends - last] = 0
        upto = np.cumsum(n)
        ids = self.flat[np.repeat(self.start[k] - (upto - n), n) + np.arange(int(upto[-1]))]
        return np.split(ids, upto[ends - 1][:-1])

    def encode_many(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string array; null is empty."""
        if not len(texts):
            return []
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = pc.match_substring_regex(texts, self.STRANGE)
        for word in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, word))
        whole = whole.to_numpy(zero_copy_only=False) | (not self.cuts)
        uneven = pc.match_substring_regex(texts, self.UNEVEN).to_numpy(zero_copy_only=False) & ~whole
        even = ~whole & ~uneven
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        if even.any():
            for i, x in zip(np.nonzero(even)[0].tolist(), self._ids(*self.split(texts.filter(pa.array(even))), 2), strict=True):
                out[i] = x
        if uneven.any():
            cut = [self.pieces(t) for t in texts.filter(pa.array(uneven)).to_pylist()]
            pieces = pa.array(list(chain.from_iterable(cut)), pa.string())
            for i, x in zip(np.nonzero(uneven)[0].tolist(), self._ids(pieces, np.array([len(c) for c in cut]), 0), strict=True):
                out[i] = x
        for i in np.nonzero(whole)[0].tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many(pa.array([text], pa.string()))[0]


def write_segment(ids: np.ndarray, doc_ids: list[int | None], starts: list[int], width: int = WIDTH, part: int = 0, seq: int = 0, at: int = 0) -> bytes:
    """One segment of the format above."""
    if width not in (8, 16):
        raise ValueError("chunks have 8 or 16 bits")
    kind, levels, rest = {8: "<u1", 16: "<u2"}[width], [], np.asarray(ids, np.uint32)
    while True:
        more = rest >> width > 0
        bits = np.packbits(more, bitorder="little")
        steps = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), RANK_STEP), dtype=np.int64))]) if len(more) else np.zeros(1, np.int64)
        ranks = steps[: -(-len(more) // RANK_STEP)].astype("<u4")
        levels.append((len(rest), (rest & (1 << width) - 1).astype(kind).tobytes() + bits.tobytes() + ranks.tobytes()))
        if not steps[-1]:
            break
        rest = rest[more] >> width
    docs = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + bytes(d is not None for d in doc_ids) + np.array(starts, "<u8").tobytes()
    first = HEAD.size + 16 * len(levels) + len(docs)
    places = first + np.cumsum([0, *(len(x) for _, x in levels[:-1])])
    directory = np.array([(n, p) for (n, _), p in zip(levels, places.tolist(), strict=True)], "<u8").tobytes()
    head = HEAD.pack(MAGIC, width, len(levels), part, seq, at, len(ids), len(doc_ids))
    return b"".join([head, directory, docs, *(x for _, x in levels)])


class Segment:
    """Reads a segment; ``segment[i]`` is the id at position i.

    ``source`` is the segment's bytes, or a function of (place, n) that gives n
    bytes of it; only the bytes that an answer needs are asked for.
    """

    def __init__(self, source: bytes | memoryview | Callable[[int, int], bytes]):
        if not callable(source):
            whole = memoryview(source)
            source = lambda at, n: whole[at : at + n]
        self.get = source
        head = self.get(0, HEAD.size)
        if len(head) < HEAD.size or bytes(head[:8]) != MAGIC:
            raise ValueError("not a segment of token codes")
        _, self.width, n, self.part, self.seq, self.at, self.tokens, self.n_docs = HEAD.unpack(head)
        self.levels = self._take("<u8", HEAD.size, 2 * n).reshape(n, 2).astype(np.int64).tolist()
        self.kind = {8: "<u1", 16: "<u2"}[self.width]

    def _take(self, kind: str, at: int, count: int) -> np.ndarray:
        return np.frombuffer(self.get(at, count * np.dtype(kind).itemsize), kind, count)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """The doc_ids, and their places among the tokens with the number of tokens behind."""
        at, n = HEAD.size + 16 * len(self.levels), self.n_docs
        ids, present, starts = self._take("<i8", at, n), self._take("<u1", at + 8 * n, n), self._take("<u8", at + 9 * n, n)
        return [int(i) if p else None for i, p in zip(ids.tolist(), present.tolist(), strict=True)], np.append(starts, self.tokens).astype(np.int64)

    def size(self) -> int:
        """Bytes of the segment."""
        n, at = self.levels[-1]
        return at + self.width // 8 * n + -(-n // 8) + 4 * -(-n // RANK_STEP)

    def __len__(self) -> int:
        return self.tokens

    def _bits(self, level: int, a: int, b: int) -> np.ndarray:
        """Bytes a to b of a level's bitmap."""
        n, at = self.levels[level]
        return self._take("<u1", at + self.width // 8 * n + a, b - a)

    def _rank(self, level: int, i: int, bits: np.ndarray | None = None) -> int:
        """Set bits before bit i; ``bits`` are the bitmap's bytes from its block's first to its own, if they were read."""
        n, at = self.levels[level]
        block = i // RANK_STEP
        if bits is None:
            bits = self._bits(level, block * RANK_STEP // 8, min(i // 8 + 1, -(-n // 8)))
        before, rest = divmod(i % RANK_STEP, 8)
        inside = int(np.bitwise_count(bits[:before]).sum()) + ((int(bits[before]) & (1 << rest) - 1).bit_count() if rest else 0)
        if block * RANK_STEP >= n:  # past the last id of a level that ends with a whole block
            return self.levels[level + 1][0] if level + 1 < len(self.levels) else 0
        return int(self._take("<u4", at + self.width // 8 * n + -(-n // 8) + 4 * block, 1)[0]) + inside

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        out, shift = 0, 0
        for level, (_, at) in enumerate(self.levels):
            out |= int(self._take(self.kind, at + i * self.width // 8, 1)[0]) << shift
            bits = self._bits(level, i // RANK_STEP * RANK_STEP // 8, i // 8 + 1)
            if not bits[-1] >> i % 8 & 1:
                break
            i, shift = self._rank(level, i, bits), shift + self.width
        return out

    def read(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids of positions start to stop, without reading what is before or behind."""
        stop = self.tokens if stop is None else min(stop, self.tokens)
        a, b = start, max(start, stop)
        out, where, shift = np.zeros(b - a, np.uint32), None, 0
        for level, (_, at) in enumerate(self.levels):
            part = self._take(self.kind, at + a * self.width // 8, b - a).astype(np.uint32) << np.uint32(shift)
            if where is None:
                out |= part
                where = np.arange(b - a)
            else:
                out[where] |= part
            more = np.unpackbits(self._bits(level, a // 8, -(-b // 8)), bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            if not more.any():
                break
            a = self._rank(level, a)
            b, where, shift = a + int(more.sum()), where[more], shift + self.width
        return out

    def document(self, k: int) -> np.ndarray:
        starts = self.documents()[1]
        return self.read(int(starts[k]), int(starts[k + 1]))


_FILE = pa.schema([("kind", pa.string()), ("value", pa.binary())])
_IDLE: dict[tuple[str, int], Encoder] = {}
_TIMERS: dict[tuple[str, int], threading.Timer] = {}


@contextmanager
def borrowed_encoder(file: str, cache: int) -> Iterator[Encoder]:
    """A worker process keeps its encoder from task to task, and lets it go when idle for IDLE_S
    seconds, so that the pieces it holds don't take memory from other operators' tasks."""
    key = file, cache
    if timer := _TIMERS.pop(key, None):
        timer.cancel()
    enc = _IDLE.pop(key, None) or Encoder(file, cache)
    try:
        yield enc
    finally:
        _IDLE[key] = enc
        _TIMERS[key] = timer = threading.Timer(IDLE_S, _IDLE.pop, (key, None))
        timer.daemon = True
        timer.start()


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encode(tokenizer: str, end: int, width: int, limit: int, cache: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with borrowed_encoder(tokenizer_file(tokenizer), cache) as enc:
            yield from encoded(batches, enc, TaskContext.get().partitionId())

    def encoded(batches: Iterator[pa.RecordBatch], enc: Encoder, part: int) -> Iterator[pa.RecordBatch]:
        seq = at = offset = 0
        ids, docs, starts, n = [], [], [], 0
        tail = np.array([end], np.uint32)

        def closed() -> pa.RecordBatch:
            nonlocal offset
            offset = 0 if seq % FILE_SEGMENTS == 0 else offset
            blob = write_segment(np.concatenate(ids), docs, starts, width, part, seq, at)
            line = ",".join(map(str, (part, seq, seq // FILE_SEGMENTS, offset, len(blob), at, n, len(docs))))
            offset += len(blob) + 1
            return pa.record_batch([pa.array(["segments", "index"]), pa.array([blob, line.encode()], pa.binary())], schema=_FILE)

        for batch in batches:
            for doc, found in zip(batch.column(0).to_pylist(), enc.encode_many(batch.column(1)), strict=True):
                docs.append(doc)
                starts.append(n)
                ids += [found, tail]
                n += len(found) + 1
                if n >= limit:
                    yield closed()
                    seq, at = seq + 1, at + n
                    ids, docs, starts, n = [], [], [], 0
        if docs:
            yield closed()

    return tidy(run)


@contextmanager
def two_writers(spark: SparkSession) -> Iterator[None]:
    """Tasks keep both kinds' files open, so that rows need not be sorted by kind before they are written."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(2, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end: int = END, key: str = "doc_id", text: str = "text", width: int = WIDTH, limit: int = SEGMENT_TOKENS, cache: int = CACHE) -> None:
    """Writes the ids of all texts, each followed by ``end``, in ascending key order.

    Null text is empty (its ids are the end alone), as is an empty one; null
    keys come first; rows that repeat a key are ordered by a hash of the text,
    and equal rows each give theirs. A very long text makes a segment of its
    own size, as segments end with documents. An empty table writes no segment.
    Columns other than key and text, whatever their names, are not read.
    ``tokenizer`` names a file of the public tokenizers; a larger ``cache`` of
    pieces spends a worker's memory to save its time.
    """
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"), F.xxhash64(f"`{text}`").alias("hash"))
    order = [F.col("key").asc_nulls_first(), F.col("hash")]
    dealt = slim.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("key", "text")
    rows = dealt.mapInArrow(_encode(tokenizer, end, width, limit, cache), "kind string, value binary").select("kind", F.col("value").cast("string"))
    with two_writers(spark):
        rows.write.partitionBy("kind").options(maxRecordsPerFile=FILE_SEGMENTS, **NO_MARK).text(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of the segments at ``path`` (columns of ``INDEX``)."""
    try:
        lines = spark.read.schema("value string").text(f"{path}/kind=index")
    except AnalysisException:  # no segment was written
        return spark.createDataFrame([], INDEX)
    return lines.select(F.from_csv("value", F.lit(INDEX)).alias("x")).select("x.*")


def part_starts(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    """(part, tokens before it, its tokens) of each part that was written, in order."""
    sums = token_index(spark, path).groupBy("part").agg(F.sum("n_tokens")).collect()  # one row for each part
    out, total = [], 0
    for part, n in sorted(tuple(x) for x in sums):
        out.append((part, total, n))
        total += n
    return out


class TokenFiles:
    """Single tokens of the files at ``path``, read from storage by byte ranges.

    The parts' starts are kept, one number a part; a token's segment is found
    in its part's index. ``bytes_read`` counts what was asked for of segments.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.bytes_read = spark, path.rstrip("/"), 0
        self.parts = part_starts(spark, path)
        self.starts = [start for _, start, _ in self.parts]
        self.tokens = self.parts[-1][1] + self.parts[-1][2] if self.parts else 0
        self.names: dict[tuple[str, int, int], str] = {}
        for kind in ("segments", "index") if self.parts else ():
            p, fs = self._fs(f"{self.path}/kind={kind}")
            for status in fs.listStatus(p):
                if m := re.match(r"part-(\d+)-.*\.c(\d+)\.", name := status.getPath().getName()):
                    self.names[kind, int(m[1]), int(m[2])] = f"{self.path}/kind={kind}/{name}"
        self.index: dict[int, list[tuple[int, ...]]] = {}

    def _fs(self, path: str):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(sc._jsc.hadoopConfiguration())

    def _range(self, path: str, at: int, n: int | None = None) -> bytes:
        p, fs = self._fs(path)
        stream = fs.open(p)
        try:
            stream.seek(at)
            io = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
            return bytes(io.toByteArray(stream) if n is None else io.toByteArray(stream, n))
        finally:
            stream.close()

    def _segments(self, part: int) -> list[tuple[int, ...]]:
        """The index lines of a part, in order."""
        if part not in self.index:
            files = sorted(k for k in self.names if k[:2] == ("index", part))
            lines = b"".join(self._range(self.names[k], 0) for k in files).decode().split()
            self.index[part] = sorted(tuple(map(int, x.split(","))) for x in lines)
        return self.index[part]

    def locate(self, i: int) -> tuple[Segment, int]:
        """The segment that holds token i, and the token's place in it."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        part, start, _ = self.parts[bisect.bisect_right(self.starts, i) - 1]
        lines = self._segments(part)
        _, _, file, offset, _, at, _, _ = lines[bisect.bisect_right([x[5] for x in lines], i - start) - 1]

        def get(place: int, n: int) -> bytes:
            self.bytes_read += n
            return self._range(self.names["segments", part, file], offset + place, n) if n else b""

        return Segment(get), i - start - at

    def token(self, i: int) -> int:
        segment, place = self.locate(i)
        return segment[place]

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids of positions start to stop."""
        out = [np.zeros(0, np.uint32)]
        while start < min(stop, self.tokens):
            segment, place = self.locate(start)
            out.append(segment.read(place, place + stop - start))
            start += len(out[-1])
        return np.concatenate(out)


_ROWS = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
_ROWS_SQL = "id bigint, part int, at bigint, n_tokens bigint, ids_crc32 bigint"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole files to a row for each document."""
    for batch in batches:
        for file in batch.column(0):
            data, place = memoryview(file.as_buffer()), 0
            while place < len(data):
                s = Segment(data[place:])
                place += s.size() + 1
                ids, (names, starts) = s.read().astype("<u4"), s.documents()
                edges = starts.tolist()
                crc = [zlib.crc32(ids[a:b].data) for a, b in zip(edges, edges[1:], strict=False)]
                yield pa.record_batch([pa.array(names, pa.int64()), pa.array([s.part] * len(crc), pa.int32()), pa.array(starts[:-1] + s.at), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], schema=_ROWS)


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """One row per document of the files at ``path``: key, start, n_tokens, ids_crc32."""
    ship(spark)
    parts = part_starts(spark, path)
    base = F.broadcast(spark.createDataFrame([x[:2] for x in parts], "part int, base bigint"))
    if not parts:
        rows = spark.createDataFrame([], _ROWS_SQL)
    else:
        rows = spark.read.format("binaryFile").load(f"{path}/kind=segments").select("content").mapInArrow(tidy(_decode), _ROWS_SQL)
    return rows.join(base, "part").select(F.col("id").alias(key), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """Writes the token files of ``docs`` to the scratch folder and reads them back."""
    path = scratch.path()
    write_tokens(docs, path, **how)
    return read_tokens(docs.sparkSession, path)


def op4_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(table(spark, sf_dir, "documents"), Scratch(spark, "op4"), cache=LARGE_CACHE)

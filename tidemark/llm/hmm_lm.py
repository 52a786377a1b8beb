"""A hidden Markov language model: Baum-Welch training and exact scoring.

Tokens are the words of A-Z-lower-cased texts and one end per document. Every
token belongs to an emission type: the most frequent words are types of their
own, the others share a type with the words of equal first byte and last two
bytes (hashed), the end is a type. A state emits a type and the type a word in
proportion to the training counts, so p(w | k) = (1 - u) c(w)/N R(type, k); words
never seen in training are one more outcome of probability u = (words seen
once + 1) / (N + 1) in every state. The model sums to one over the vocabulary and
the unseen word, the outcomes the add-0.1 base has too.

Training covers every training document: one map-side-combined count of all
words, then full Baum-Welch iterations whose expected counts are summed over
partitions, until an iteration's model gains less than ``GAIN`` of log
likelihood per token. The state table is bounded (types x states, whatever the
input), so it travels by closure; the vocabulary is not, and stays a
distributed table. Only the start of the iterations, which must break symmetry,
comes from a bounded sample of whole documents (``WARM_TOKENS``).

Chunks: a worker codes about 16 MB of text at a time against the chunk's own
words. So texts are read once; a frequent word meets the vocabulary once a
chunk, not once a document, in a join whose skewed keys Spark can split; and no
group of rows depends on a key of the data.

Forward and backward recursions run over all blocks of 128 tokens at once: the
product of a block's transition matrices links blocks exactly, so that one very
long document costs what many short ones do.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chains import STEPS, Chain, firsts, folded_marginals, forward
from .common import Scratch, crc_mod, ship, table, tidy

HELD_OUT = 10
STATES = 6
TOP_WORDS = 1 << 16
CLASSES = 1 << 12
#: Types: 0 the end, 1..CLASSES the shared ones, then the frequent words; -1 marks a word unseen in training.
END_TYPE = 0
WARM_TOKENS, WARM_ROWS, WARM_ITERATIONS = 300_000, 15_000, 20
#: Iterations over the corpus go on until the log likelihood per token gains less.
GAIN = 0.01
CHUNK_BYTES = 16 << 20
PRIOR = 0.5
#: Tokens that one pass of the recursions holds in memory.
PIECE_TOKENS = 1 << 18


def expected(chain: Chain, types: np.ndarray, e: np.ndarray, initial: np.ndarray, trans: np.ndarray, n_types: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts: (initial K, transitions K x K, emissions types x K) and the log likelihood of the weights."""
    return folded_counts(chain, chain.fold_one(types, n_types), chain.fold(e), initial, trans, n_types)


def folded_counts(chain: Chain, types: np.ndarray, f: np.ndarray, initial: np.ndarray, trans: np.ndarray, n_types: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The same of folded types, ``n_types`` behind the last token, and folded weights, which it overwrites."""
    gamma, moves, scale = folded_marginals(chain, f, initial, trans)
    flat, rows = types.reshape(-1), gamma.reshape(-1, len(initial))
    emitted = np.stack([np.bincount(flat, rows[:, j], n_types + 1) for j in range(len(initial))], axis=1)[:n_types]
    first = (chain.first.T & (types < n_types)).reshape(-1)
    log = np.log(scale)
    log[:, -1][STEPS - (chain.blocks * STEPS - chain.n) :] = 0
    return rows[first].sum(0), moves, emitted, float(log.sum())


class Model:
    """initial, trans and the emission ratios (types x K) of p(type | k) to p(type)."""

    def __init__(self, initial: np.ndarray, trans: np.ndarray, ratio: np.ndarray):
        self.initial, self.trans, self.ratio = initial, trans, ratio

    @staticmethod
    def random(type_counts: np.ndarray, states: int, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        ratio = np.exp(rng.normal(0, 0.3, (len(type_counts), states)))
        trans = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return Model(np.full(states, 1 / states), trans, Model.normal(ratio, type_counts))

    @staticmethod
    def normal(ratio: np.ndarray, type_counts: np.ndarray) -> np.ndarray:
        total = type_counts.sum()
        return ratio / ((type_counts / total) @ ratio) if total else np.ones_like(ratio)

    @staticmethod
    def fitted(initial: np.ndarray, moves: np.ndarray, emitted: np.ndarray, type_counts: np.ndarray) -> Model:
        """The M step: counts smoothed towards each state's share, normalised per state."""
        states = len(initial)
        share = (emitted.sum(0) + 1) / (emitted.sum() + states)
        ratio = (emitted + PRIOR * share) / (emitted.sum(1, keepdims=True) + PRIOR) / share
        moves = moves + 0.1
        initial = initial + 0.1
        return Model(initial / initial.sum(), moves / moves.sum(1, keepdims=True), Model.normal(ratio, type_counts))


def train_local(types: np.ndarray, lengths: np.ndarray, type_counts: np.ndarray, states: int, iterations: int, seed: int = 7) -> Model:
    model = Model.random(type_counts, states, seed)
    if not len(types):
        return model
    chain = Chain(firsts(lengths))
    for _ in range(iterations):
        initial, moves, emitted, _ = expected(chain, types, model.ratio[types], model.initial, model.trans, len(type_counts))
        model = Model.fitted(initial, moves, emitted, type_counts)
    return model


# Chunks

_CHUNK = pa.schema(
    [("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("tokens", pa.binary()), ("words", pa.list_(pa.binary())), ("seen", pa.list_(pa.int32()))]
)
_CHUNK_SQL = "chunk bigint, ids array<bigint>, held array<boolean>, lengths array<int>, tokens binary, words array<binary>, seen array<int>"


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (id, held, text) to chunks: tokens are places in the chunk's words, 0 the end."""
    chunk = TaskContext.get().partitionId() << 32

    def fresh():
        place: defaultdict[bytes, int] = defaultdict()
        place.default_factory = place.__len__  # a new word gets the next place
        place[b""] = 0  # the end: no word is empty
        return place, ([], [], [], []), 0

    place, (ids, held, lengths, tokens), size = fresh()

    def closed() -> pa.RecordBatch:
        code = np.concatenate(tokens)
        seen = np.bincount(code[np.repeat(~np.array(held, bool), lengths)], minlength=len(place))
        row = (chunk, ids, held, lengths, zstandard.compress(code.astype("<i4").tobytes(), 1), list(place), seen.astype(np.int32))
        return pa.record_batch([pa.array([x], f.type) for x, f in zip(row, _CHUNK, strict=True)], schema=_CHUNK)

    for batch in batches:
        for i, h, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            words = (text or b"").lower().split()
            ids.append(i)
            held.append(h)
            lengths.append(len(words) + 1)
            tokens += [np.fromiter(map(place.__getitem__, words), np.int32, len(words)), np.zeros(1, np.int32)]
            size += len(text or b"") + 16
            if size >= CHUNK_BYTES:
                yield closed()
                chunk += 1
                place, (ids, held, lengths, tokens), size = fresh()
    if ids:
        yield closed()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their lexicon, in any order, to chunks with types and counts by place, as bytes."""
    for batch in batches:
        types, counts = [], []
        for lex in batch.column(4):
            place, kind, c = (x.to_numpy(zero_copy_only=False) for x in lex.values.flatten())
            order = np.argsort(place)
            types.append(kind[order].astype("<i4").tobytes())
            counts.append(c[order].astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(types, pa.binary()), pa.array(counts, pa.binary())], names=_READY)


_READY = ["ids", "held", "lengths", "tokens", "types", "counts"]
_READY_SQL = "ids array<bigint>, held array<boolean>, lengths array<int>, tokens binary, types binary, counts binary"


@dataclass
class Chunk:
    ids: pa.Array
    held: np.ndarray
    lengths: np.ndarray
    tokens: np.ndarray
    types: np.ndarray
    counts: np.ndarray

    def documents(self) -> Iterator[tuple[slice, np.ndarray]]:
        """Runs of documents of bounded tokens: which documents, which tokens."""
        ends, a = np.cumsum(self.lengths), 0
        while a < len(ends):
            at = int(ends[a] - self.lengths[a])
            b = max(a + 1, int(np.searchsorted(ends, at + PIECE_TOKENS, "right")))
            yield slice(a, b), self.tokens[at : int(ends[b - 1])]
            a = b

    def trained(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(types, lengths) of the training documents, in runs."""
        for docs, tokens in self.documents():
            n, out = self.lengths[docs], self.held[docs]
            if not out.all():
                yield self.types[tokens[np.repeat(~out, n)]], n[~out]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for ids, held, lengths, tokens, types, counts in zip(*batch.columns, strict=True):
            yield Chunk(
                ids.values,
                held.values.to_numpy(zero_copy_only=False),
                lengths.values.to_numpy().astype(np.int64),
                np.frombuffer(zstandard.decompress(tokens.as_buffer()), "<i4"),
                np.frombuffer(types.as_buffer(), "<i4").astype(np.int64),
                np.frombuffer(counts.as_buffer(), "<i8").astype(np.float64),
            )


_COUNTS = pa.schema([("slice", pa.int32()), ("n", pa.binary())])
_COUNTS_SQL = "slice int, n binary"
#: Types whose counts make one row.
SLICE = 1 << 10


def _expectation(model: Model, n_types: int):
    """Chunks to Baum-Welch counts of the whole partition, in rows of doubles: by slice of types the emissions,
    in slice -1 the log likelihood, the initial counts and the transitions.

    In single precision: the counts only guide the next model.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.initial)
        ratio = np.concatenate([model.ratio, np.ones((1, k))]).astype(np.float32)
        start, moves, emitted, log, any_rows = np.zeros(k), np.zeros((k, k)), np.zeros((n_types, k)), 0.0, False
        for chunk in _chunks(batches):
            for types, lengths in chunk.trained():
                chain = Chain(firsts(lengths))
                laid = chain.fold_one(types, n_types)
                a, b, c, d = folded_counts(chain, laid, ratio[laid], model.initial, model.trans, n_types)
                emitted += c
                start, moves, log, any_rows = start + a, moves + b, log + d, True
        if any_rows:
            parts = {-1: np.concatenate([[log], start, moves.ravel()])} | {i: emitted[i * SLICE : (i + 1) * SLICE] for i in range(-(-n_types // SLICE))}
            used = {i: x.astype("<f8").tobytes() for i, x in parts.items() if x.any()}
            yield pa.record_batch([pa.array(used, pa.int32()), pa.array(used.values(), pa.binary())], schema=_COUNTS)

    return tidy(run)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the same slice, which a task has together, to their sum."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(x.as_buffer(), "<f8")
            total[i] = total[i] + part if i in total else part
    if total:
        yield pa.record_batch([pa.array(total, pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], schema=_COUNTS)


_SAMPLE = pa.schema([("key", pa.int64()), ("types", pa.binary())])


def _sample(limit: int):
    """Types of the training documents whose hashed id is below a limit, for the warm start.

    A document that is longer than the whole sample can't be part of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            ends, keys, out = np.cumsum(chunk.lengths), [], []
            for i, h, n, end in zip(chunk.ids.to_pylist(), chunk.held.tolist(), chunk.lengths.tolist(), ends.tolist(), strict=True):
                key = zlib.crc32(b"warm %d" % (i or 0))
                if not h and key < limit and n <= WARM_TOKENS:
                    keys.append(key)
                    out.append(chunk.types[chunk.tokens[end - n : end]].astype("<i4").tobytes())
            if keys:
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], schema=_SAMPLE)

    return tidy(run)


_SCORES = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_SCORES_SQL = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _score(model: Model, n: int, v: int, unseen: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            types, counts, lengths = chunk.types, chunk.counts, chunk.lengths
            base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))
            known = counts > 0
            own = np.where(known, np.log10(np.maximum((1 - unseen) * counts / max(1, n), 1e-300)), np.log10(unseen))
            weight = np.where(known[:, None], model.ratio[types], 1.0)
            out = []
            for docs, tokens in chunk.documents():
                chain = Chain(firsts(lengths[docs]))
                _, scale, _ = forward(chain, chain.fold(weight[tokens]), model.initial, model.trans)
                at = np.cumsum(lengths[docs]) - lengths[docs]
                ratio = np.log10(chain.tokens(scale))
                out.append([np.add.reduceat(x, at) for x in (known[tokens].astype(np.int64), base[tokens], own[tokens] + ratio)])
            parts = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield pa.record_batch([chunk.ids, pa.array(chunk.held), pa.array(lengths), *map(pa.array, parts)], schema=_SCORES)

    return tidy(run)


def _frequent(vocabulary: DataFrame) -> DataFrame:
    """(word, own): the words of the largest counts, as many whole counts as fit into TOP_WORDS, with their types.

    The least count comes from the table of how many words have each count.
    """
    by_count = vocabulary.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.col("c").desc())
    rows, total, least = by_count.limit(TOP_WORDS).collect(), 0, 1 << 62  # counts of at least one word each
    for c, n in rows:
        if (total := total + n) > TOP_WORDS:
            break
        least = c
    own = F.row_number().over(Window.orderBy(F.col("c").desc(), "word")) + CLASSES  # TOP_WORDS rows at most
    return vocabulary.filter(F.col("c") >= least).select("word", own.alias("own"))


def warm_sample(blobs: list[bytes]) -> list[np.ndarray]:
    """The types of whole documents, in the order given, as long as they fit into WARM_TOKENS together."""
    out, total = [], 0
    for blob in blobs:
        if total + len(blob) // 4 <= WARM_TOKENS:
            out.append(np.frombuffer(blob, "<i4").astype(np.int64))
            total += len(out[-1])
    return out


def trained(ready: DataFrame, model: Model, type_counts: np.ndarray, gain: float = GAIN) -> Model:
    """Baum-Welch over all training documents, until the log likelihood per token gains less than ``gain``."""
    states, n_types, before = len(model.initial), len(type_counts), None
    while True:
        head, emitted = np.zeros(1 + states + states * states), np.zeros((n_types, states))
        counts = ready.mapInArrow(_expectation(model, n_types), _COUNTS_SQL).repartition("slice").mapInArrow(tidy(_summed), _COUNTS_SQL)
        for i, x in counts.collect():  # a row for each slice of types and one
            part = np.frombuffer(bytes(x), "<f8")
            if i < 0:
                head = part
            else:
                emitted[i * SLICE : (i + 1) * SLICE] = part.reshape(-1, states)
        log, initial, moves = head[0], head[1 : 1 + states], head[1 + states :].reshape(states, states)
        now = log / max(1.0, type_counts.sum())
        model = Model.fitted(initial, moves, emitted, type_counts)
        if before is not None and now - before < gain:
            return model
        before = now


def score_documents(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", held_out=None, states: int = STATES, gain: float = GAIN) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    ``held_out`` is a boolean column of ``docs`` (default: crc32 of the key's
    text modulo 10 is 0); the model learns from the other rows. Null text is
    empty, and of an empty text the only token is the end. A very long text is
    one chain, computed in blocks. Repeated rows count and are scored each.
    Columns other than key and text, whatever their names, are not read.
    Without training rows every token is unknown and the model has u = 1. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    held_out = crc_mod(key, HELD_OUT) == 0 if held_out is None else held_out
    chunks = scratch.save(docs.select(F.col(f"`{key}`").cast("long"), held_out, F.col(f"`{text}`").cast("binary")).mapInArrow(tidy(_code), _CHUNK_SQL))
    words = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "seen")).alias("place", "w")).select("chunk", "place", F.col("w.words").alias("word"), F.col("w.seen").alias("seen"))
    # Counts over all training rows, a row for each word of any row.
    counted = scratch.save(words.groupBy("word").agg(F.sum("seen").alias("c")))
    n, v, once = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1)).first()
    unseen = (once + 1) / (n + 1)
    top = scratch.save(_frequent(counted.filter((F.col("word") != b"") & (F.col("c") > 1))), TOP_WORDS)
    shared = F.crc32(F.concat(F.substring("word", 1, 1), F.lit(b"\0"), F.expr("substring(word, greatest(length(word) - 1, 1), 2)"))) % CLASSES + 1
    kind = F.when(F.col("c") == 0, -1).when(F.col("word") == b"", END_TYPE).otherwise(F.coalesce(F.col("own").cast("long"), shared)).cast("int")
    vocabulary = counted.join(F.broadcast(top), "word", "left").select("word", "c", kind.alias("type"))
    n_types = 1 + CLASSES + TOP_WORDS
    type_counts = np.zeros(n_types)
    for t, c in vocabulary.filter("type >= 0").groupBy("type").agg(F.sum("c")).collect():  # n_types rows at most
        type_counts[t] = c
    looked = words.drop("seen").join(vocabulary, "word").groupBy("chunk").agg(F.collect_list(F.struct("place", "type", "c")).alias("lex"))
    ready = scratch.save(chunks.join(looked, "chunk").select("ids", "held", "lengths", "tokens", "lex").mapInArrow(tidy(_pack), _READY_SQL))
    scratch.drop(chunks, counted)
    limit = min(1.0, 2 * WARM_TOKENS / max(1, n)) * 2**32
    picked = ready.mapInArrow(_sample(int(limit)), "key bigint, types binary").orderBy("key", "types").limit(WARM_ROWS).collect()
    sample = warm_sample([bytes(r[1]) for r in picked])
    model = train_local(np.concatenate(sample) if sample else np.zeros(0, np.int64), np.array([len(x) for x in sample], np.int64), type_counts, states, WARM_ITERATIONS)
    model = trained(ready, model, type_counts, gain) if n else model
    out = ready.mapInArrow(_score(model, n, v, unseen), _SCORES_SQL)
    return out.select(F.col("id").alias(key), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op5_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), Scratch(spark, "op5"))

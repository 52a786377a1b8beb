"""Benchmark decontamination: CGK embedding, bit-sampling LSH, edit verification.

Texts are sequences of words (lower-cased, without surrounding punctuation). A
document is contaminated by an item if some stretch of it is within an edit
distance (in words) of ``floor((1 - SIMILARITY) * n)`` of the item's n words.

The CGK random walk reads a sequence: at step j it emits the word it stands on
and moves on if a random bit of (j, word) says so. Two walks with the same bits
that differ by an edit fall into step again soon, so sequences at a small edit
distance have embeddings at a small Hamming distance. A walk started at a word
of the document embeds the window that begins there; sampling a few positions
of the embedding gives a key, and windows that share a key with an item (of the
same length class) are candidates. Walks and samples are drawn again, each
round a table of its own; rounds are as many as the target recall takes for
items edited to the largest distance (:func:`rounds_for`).
Long items keep a key less often. A class that takes more than ``MOST_ROUNDS``
is searched without loss instead: of an item's k + 1 pieces, k edits leave one
as it is, so each place that holds the first words of a piece is a candidate.
Candidates are verified by the exact edit distance of the item to the best
stretch of the window, widened by the distance allowed.

A window can only match if no more of its first n - k words than k are unknown
to the benchmark, whatever they are: each costs an edit. Windows beyond that
are dropped before they are embedded, without loss.

Scale: one pass over the documents without a shuffle, whole texts, all start
words at once. Items travel by closure in blocks of at most ``BLOCK_ITEMS``;
a benchmark of more items takes more passes. Near copies and hot groups need
no care, as no rows meet by key; the final distinct is by (document, item).
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table, tidy

SIMILARITY = 0.8
RECALL = 0.97
#: Items of one pass; positions sampled for a key; ratio of lengths within a class; rounds beyond which a class goes by pieces.
BLOCK_ITEMS = 20_000
SAMPLED = 3
CLASS_RATIO = 1.3
MOST_ROUNDS = 24
#: Words before and behind an item's start that its rounds are tried from.
AROUND = 4
SEED = 11
PUNCTUATION = b".,;:!?()[]{}\"'|*#%$&"
#: Start words embedded at once.
PIECE = 1 << 16
#: Words as split whose codes a worker keeps.
CACHE = 500_000


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words without surrounding punctuation; words of punctuation only go."""
    return [w for x in (text or b"").lower().split() if (w := x.strip(PUNCTUATION))]


def allowed(n: int, similarity: float = SIMILARITY) -> int:
    return math.floor((1 - similarity) * n + 1e-9)


class Item:
    def __init__(self, item_id: int, code: np.ndarray):
        self.id, self.code, self.n, self.words = item_id, code, len(code), set(code.tolist())
        self.by_pieces = False


class Codes(dict):
    """Codes of words as they are split: 0 if unknown to the benchmark, -1 for punctuation only."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        w = word.strip(PUNCTUATION)
        self[word] = code = self.vocabulary.get(w, 0) if w else -1
        return code


def best_stretch(item: np.ndarray, window: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the stretch of ``window`` nearest to ``item``; None beyond ``most``.

    The edit distance by rows, one per word of the item, free at both ends of
    the window; ties go to the earliest end, then the latest start.
    """
    m = len(window)
    at = np.arange(m + 1)
    row, start = np.zeros(m + 1, np.int64), at.copy()
    big = m + 2
    for i, word in enumerate(item.tolist(), 1):
        down, across = row + 1, row[:-1] + (window != word)
        cost = down.copy()
        origin = start.copy()
        better = (across < cost[1:]) | ((across == cost[1:]) & (start[:-1] > origin[1:]))
        cost[1:][better] = across[better]
        origin[1:][better] = start[:-1][better]
        cost[0], origin[0] = i, 0
        # insertions: the least of cost[j] + (at - j), carried along; origins ride in the low digits
        packed = (cost - at) * big + (big - 1 - origin)
        packed = np.minimum.accumulate(packed)
        row, start = packed // big + at, big - 1 - packed % big
        if row.min() > most:
            return None
    end = int(row.argmin())
    return (int(row[end]), int(start[end]), end) if row[end] <= most else None


def moved(at: np.ndarray, bits: np.ndarray, step: int) -> np.ndarray:
    """Where walks stand after a step."""
    on = bits.take(at)
    on >>= np.uint64(step % 64)
    on &= np.uint64(1)
    return at + on.view(np.int64)


class Index:
    """Keys of a block of items, by length class and round; pieces of the items of other classes."""

    def __init__(self, items: list[tuple[int, bytes | None]], similarity: float = SIMILARITY, recall: float = RECALL, seed: int = SEED):
        self.similarity, self.seed = similarity, seed
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[Item] = []
        for item_id, text in items:
            if words := words_of(text):
                code = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32)
                self.items.append(Item(item_id, code))
        self.known = Codes(self.vocabulary)
        self.names = np.array([0] + [zlib.crc32(w) for w in self.vocabulary], np.uint64)
        self.drawn: dict[tuple[int, int], list[int]] = {}
        self.classes: list[tuple[int, int, int]] = []  # smallest and largest length, walk steps
        for n in sorted({i.n for i in self.items}):
            if not self.classes or n > CLASS_RATIO * self.classes[-1][0]:
                self.classes.append((n, n, 0))
            self.classes[-1] = (self.classes[-1][0], n, max(1, int(1.5 * (self.classes[-1][0] - allowed(self.classes[-1][0], similarity)))))
        need = rounds_for(self, recall)
        self.hashed = [c for c, n in enumerate(need) if n <= MOST_ROUNDS]
        self.rounds = max((need[c] for c in self.hashed), default=0)
        self.tables = {c: [self._table(c, r) for r in range(self.rounds)] for c in self.hashed}
        for c in set(range(len(need))) - set(self.hashed):
            lo, hi, _ = self.classes[c]
            for x in self.items:
                x.by_pieces |= lo <= x.n <= hi
        self.pieces = self._pieces()

    def __getstate__(self):
        return self.__dict__ | {"known": None}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.known = Codes(self.vocabulary)

    def walk_hashes(self, r: int, block: int, raw: np.ndarray) -> np.ndarray:
        """64 random bits of each word, for 64 steps of the walk of a round."""
        x = raw * np.uint64(0x9E3779B97F4A7C15) + np.uint64((self.seed + 1000 * r + 77 * block + 1) * 0xC2B2AE3D27D4EB4F % 2**64)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ x >> np.uint64(32)

    def samples(self, c: int, r: int) -> list[int]:
        """Embedding positions sampled in a round."""
        if (c, r) not in self.drawn:
            steps = self.classes[c][2]
            self.drawn[c, r] = np.sort(np.random.default_rng((self.seed, c, r)).choice(steps, min(SAMPLED, steps), replace=False)).tolist()
        return self.drawn[c, r]

    def bits(self, r: int, block: int, words: np.ndarray) -> np.ndarray:
        """The hashes of coded words, each word of the benchmark hashed once."""
        return self.walk_hashes(r, block, self.names)[words]

    def walk(
        self, c: int, r: int, words: np.ndarray, starts: np.ndarray, bits: np.ndarray, only: list[np.ndarray] | None = None, at: np.ndarray | None = None, done: int = 0
    ) -> tuple[np.ndarray, list[np.ndarray]]:
        """Starts of windows and the words at the sampled positions of their embeddings.

        Past the end a walk reads zeros: ``words`` must be padded. ``bits`` are
        the words' hashes for the walk's first block of steps. ``only`` tells
        for each sample which words some item has there; other windows end.
        ``at``, if given, is where the walks stand after ``done`` steps.
        """
        at, seen, block = starts.astype(np.int64) if at is None else at, [], 0
        for s in self.samples(c, r):
            for step in range(done, s + 1):
                if step // 64 != block:
                    block = step // 64
                    bits = self.bits(r, block, words)
                if step == s:
                    seen.append(words[at])
                    if only is not None:
                        keep = only[len(seen) - 1][seen[-1]]
                        at, starts, seen = at[keep], starts[keep], [x[keep] for x in seen]
                at = moved(at, bits, step)
            done = s + 1
        return starts, seen

    @staticmethod
    def key(seen: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(seen[0]), np.uint64)
        for x in seen:
            out = (out ^ (x.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        return out

    def _table(self, c: int, r: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Sorted keys of a class's items, the items, and which words they have at each sample."""
        lo, hi, steps = self.classes[c]
        members = [i for i, x in enumerate(self.items) if lo <= x.n <= hi]
        gap = np.zeros(steps + 1, np.int32)
        words = np.concatenate([y for i in members for y in (self.items[i].code, gap)])
        sizes = np.array([self.items[i].n + len(gap) for i in members])
        _, seen = self.walk(c, r, words, np.cumsum(sizes) - sizes, self.walk_hashes(r, 0, self.names[words]))
        only = [np.isin(np.arange(len(self.names)), x) for x in seen]
        found = self.key(seen)
        order = np.argsort(found, kind="stable")
        return found[order], np.array(members)[order], only

    def _pieces(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By number of words: sorted keys of the first words of pieces, their items and places in them."""
        rows: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, x in enumerate(self.items):
            if x.by_pieces:
                n = allowed(x.n, self.similarity) + 1
                rows.setdefault(max(1, x.n // n), []).append((i, np.arange(n) * x.n // n))
        out = {}
        for q, found in rows.items():
            members, at = np.repeat([i for i, _ in found], [len(p) for _, p in found]), np.concatenate([p for _, p in found])
            words = np.concatenate([self.items[i].code[p[:, None] + np.arange(q)] for i, p in found])
            keys = self.key(list(words.T))
            order = np.argsort(keys, kind="stable")
            out[q] = keys[order], members[order], at[order]
        return out

    def piece_candidates(self, words: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        """Coded (item, start) where an item would start if the piece found were in place."""
        inside = ends > 0
        begins = np.nonzero(inside & ~np.concatenate([[False], inside[:-1]]))[0]
        for q, (keys, members, at) in self.pieces.items():
            place = np.nonzero(inside & (words > 0))[0]
            place = place[place + q <= ends[place]]
            for a in range(0, len(place), PIECE):
                part = place[a : a + PIECE]
                mine = self.key([words[part + j] for j in range(q)])
                left = np.searchsorted(keys, mine, "left")
                hit = np.nonzero(keys[np.minimum(left, len(keys) - 1)] == mine)[0]
                left, part = left[hit], part[hit]
                n = np.searchsorted(keys, mine[hit], "right") - left
                which = np.repeat(left - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                begin = begins[np.searchsorted(begins, part, "right") - 1]
                start = np.maximum(np.repeat(part, n) - at[which], np.repeat(begin, n))
                yield np.unique(members[which] * len(words) + start)

    def candidates(self, words: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, start) of windows that share a key or piece with an item of their class, sorted.

        ``words`` are documents one after another, with gaps of zeros of at least
        the longest walk; ``ends`` has the document's end for each word, 0 in gaps.
        """
        unknown = np.concatenate([[0], np.cumsum(words == 0)])
        found, parts, of = list(self.piece_candidates(words, ends)), [], {}
        for c in self.hashed:
            lo, hi, _ = self.classes[c]
            k = allowed(hi, self.similarity)
            # In an alignment of n words with at most k edits, the stretch has n - k words or more.
            least = max(1, lo - allowed(lo, self.similarity))
            starts = np.nonzero(np.arange(least, len(words) + least) <= ends)[0]
            of[c] = np.zeros(len(words), bool)
            of[c][starts[unknown[starts + least] - unknown[starts] <= k]] = True
        if of:
            starts = np.nonzero(np.logical_or.reduce(list(of.values())))[0]
            cut = [starts[a : a + PIECE] for a in range(0, len(starts), PIECE)]
            parts = [(x, {c: mine[x] for c, mine in of.items()}) for x in cut]
        # Up to a class's first sample its walks are those of every class, so they are made together.
        for r in range(self.rounds if parts else 0):
            bits, order = self.bits(r, 0, words), sorted(self.hashed, key=lambda c: self.samples(c, r)[0])
            for starts, mine in parts:
                self._round(r, order, words, starts, mine, bits, found)
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return zip((pairs // len(words)).tolist(), (pairs % len(words)).tolist(), strict=True)

    def _round(self, r: int, order: list[int], words: np.ndarray, starts: np.ndarray, of: dict[int, np.ndarray], bits: np.ndarray, found: list[np.ndarray]) -> None:
        """Adds the coded (item, start) that a round finds at these starts.

        ``order`` has the classes by their first sample, ``of`` tells for each which of the starts are its.
        """
        at, done, block, common = starts.astype(np.int64), 0, 0, bits
        for c in order:
            first = self.samples(c, r)[0]
            for step in range(done, first):
                if step // 64 != block:
                    block = step // 64
                    common = self.bits(r, block, words)
                at = moved(at, common, step)
            done = first
            keys, members, only = self.tables[c][r]
            keep = np.nonzero(of[c] & only[0].take(words.take(at)))[0]
            part, seen = self.walk(c, r, words, starts[keep], bits, only, at[keep], done)
            mine = self.key(seen)
            left = np.searchsorted(keys, mine, "left")
            hit = np.nonzero(keys[np.minimum(left, len(keys) - 1)] == mine)[0]
            left = left[hit]
            n = np.searchsorted(keys, mine[hit], "right") - left
            which = np.repeat(left - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            found.append(np.unique(members[which] * len(words) + np.repeat(part[hit], n)))

    def matches(self, texts: list[bytes | None]) -> list[list[tuple[int, int, int, int, int]]]:
        """For each text (item id, words, distance, first word, last word + 1) of the items
        it holds, the nearest stretch each."""
        out: list[list] = [[] for _ in texts]
        if not self.items:
            return out
        gap = np.zeros(max(steps for *_, steps in self.classes) + 2, np.int32)
        coded, lengths = [], []
        for text in texts:
            found = (text or b"").lower().split()
            code = np.fromiter(map(self.known.__getitem__, found), np.int32, len(found))
            coded += [code[code >= 0], gap]
            lengths.append(len(coded[-2]))
            if len(self.known) > CACHE:
                self.known.clear()
        words, lengths = np.concatenate(coded), np.array(lengths, np.int64)
        first = np.cumsum(lengths + len(gap)) - lengths - len(gap)
        ends = np.concatenate([np.concatenate([np.full(n, a + n), gap]) for a, n in zip(first.tolist(), lengths.tolist(), strict=True)])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        item, done = -1, -1
        for i, start in self.candidates(words, ends):
            n, k = self.items[i].n, allowed(self.items[i].n, self.similarity)
            d = int(np.searchsorted(first, start, "right")) - 1
            if i == item and start < done:
                continue
            # The stretch looked at holds every window that starts within k words after this one;
            # a piece tells its item's start only within k words, so there it is k words longer.
            far = (3 if self.items[i].by_pieces else 2) * k
            a, b = max(int(first[d]), start - k), min(int(first[d] + lengths[d]), start + n + far + 1)
            item, done = i, min(start + k + 1, b)
            window = words[a:b]
            # Each word of the item that the stretch lacks costs an edit.
            if len(self.items[i].words - set(window.tolist())) > k:
                continue
            if (hit := best_stretch(self.items[i].code, window, k)) and (hit[0] < best.get((d, i), (n,))[0]):
                best[d, i] = (hit[0], a + hit[1] - int(first[d]), a + hit[2] - int(first[d]))
        for (d, i), hit in best.items():
            out[d].append((self.items[i].id, self.items[i].n, *hit))
        return out


def rounds_for(index: Index, recall: float, trials: int = 2000) -> list[int]:
    """Rounds of each class that reach the recall for items edited to the full distance; MOST_ROUNDS + 1 if more.

    Random items of the class are edited (words replaced, left out and put in
    at random places) and searched for by the very rounds of the index, as in a
    document, from each of the words about their start; of the share found so
    far the lower end of its 95 % range counts.
    """
    rng, need = random.Random(index.seed), []
    for c, (lo, hi, steps) in enumerate(index.classes):
        items, about = [x for x in index.items if lo <= x.n <= hi], min(AROUND, allowed(lo, index.similarity))
        gap, parts = np.zeros(steps + 1, np.int32), []
        for _ in range(trials):
            item = rng.choice(items)
            words = item.code.tolist()
            for _ in range(allowed(item.n, index.similarity)):
                at, kind = rng.randrange(len(words)), rng.randrange(3)
                words[at : at + (kind != 2)] = [] if kind == 1 and len(words) > 1 else [0]
            parts += [np.concatenate([item.code, gap]), np.array([0] * about + [*words, *gap], np.int32)]
        words, sizes = np.concatenate(parts), np.array([len(x) for x in parts])
        begins, raw, missed = np.cumsum(sizes) - sizes, index.names[words], np.ones(trials, bool)
        starts = np.concatenate([begins[0::2], (begins[1::2] + np.arange(2 * about + 1)[:, None]).ravel()])
        for r in range(MOST_ROUNDS):
            keys = index.key(index.walk(c, r, words, starts, index.walk_hashes(r, 0, raw))[1]).reshape(-1, trials)
            missed &= (keys[1:] != keys[0]).all(0)
            share = 1 - missed.mean()
            if share - 1.96 * math.sqrt(share * (1 - share) / trials) >= recall:
                break
        else:
            r = MOST_ROUNDS
        need.append(r + 1)
    return need


_HITS = pa.schema([("rid", pa.int64()), ("id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int32()), ("distance", pa.int32()), ("first_word", pa.int32()), ("end_word", pa.int32())])
_HITS_SQL = "rid bigint, id bigint, item_id bigint, item_words int, distance int, first_word int, end_word int"


def _search(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            place = {t: k for k, t in enumerate(dict.fromkeys(texts))}
            found = index.matches(list(place))
            rows = [(rid + j, i, *m) for j, (i, t) in enumerate(zip(ids, texts, strict=True)) for m in found[place[t]]]
            rid += len(ids)
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_HITS), _HITS, strict=True)], schema=_HITS)

    return tidy(run)


def blocks(benchmark: DataFrame, item: str = "item_id") -> Iterator[list[tuple[int | None, bytes | None]]]:
    """The benchmark's items, so many at a time as one pass searches for; a partition of it at a time is fetched."""
    block: list = []
    for row in benchmark.select(F.col(f"`{item}`").cast("long"), F.col("text").cast("binary")).orderBy(item, "text").toLocalIterator():
        block.append((row[0], None if row[1] is None else bytes(row[1])))
        if len(block) == BLOCK_ITEMS:
            yield block
            block = []
    if block:
        yield block


def contaminations(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per document and item it holds: key, item_id, item_words, distance, similarity,
    first_word, end_word (words of the document, counted without punctuation-only ones).

    Null, empty and wordless documents or items match nothing; an empty
    benchmark or table gives no rows. Very long documents are searched whole.
    Repeated documents each give their rows, repeated item ids count as items
    of their own; of equally near stretches the first counts. Clean documents
    give none. Columns other than key and text, whatever their names, are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`").cast("binary"))
    parts = [slim.mapInArrow(_search(Index(block, similarity, recall)), _HITS_SQL) for block in blocks(benchmark, item)]
    out = parts[0] if parts else spark.createDataFrame([], _HITS_SQL)
    for part in parts[1:]:
        out = out.unionByName(part)
    shown = F.round(1 - F.col("distance") / F.col("item_words"), 6).alias("similarity")
    return out.select("rid", F.col("id").alias(key), "item_id", "item_words", "distance", shown, "first_word", "end_word")


def _clean(index: Index, text: int):
    """Batches without the rows whose text holds an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            place = {t: k for k, t in enumerate(dict.fromkeys(texts))}
            found = index.matches(list(place))
            yield batch.filter(pa.array([not found[place[t]] for t in texts], pa.bool_()))

    return tidy(run)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``docs`` without the rows whose text holds an item of the benchmark; columns stay.

    Rows go as they pass, so that nothing is joined; each row is judged by its
    own text, whatever its id. Edge cases are those of :func:`contaminations`.
    """
    ship(docs.sparkSession)
    out, at = docs, docs.columns.index(text)
    for block in blocks(benchmark, item):
        out = out.mapInArrow(_clean(Index(block, similarity, recall), at), docs.schema)
    return out


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("rid")

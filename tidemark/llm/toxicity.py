"""Toxicity by a linear-chain conditional random field over tokens.

Two states, clean and toxic. A token's features are its word and the word's
beginnings and ends (3 to 6 characters), hashed; transitions carry spans.
Forward-backward gives each token its marginal. A document's score is a
logistic function, fitted on the sample, of its largest marginal's log odds and
the log of its expected number of toxic tokens (sum of marginals of at least
``NOTABLE``): a strong word counts at once, a weak one when it comes again.
Tokens of marginal 0.5 or more, neighbours joined, are the offending spans.

Labelled tokens: labels exist for documents only. In a bounded sample of
labelled documents (near copies removed) a greedy cover chooses features whose
presence, or presence in several tokens, tells toxic documents from clean ones;
the tokens of toxic documents that have such a feature are labelled toxic, all
others clean. The field learns from these, then estimates the labels again
itself (:func:`under_labels`): forward-backward, given that a toxic document
has a toxic token and a clean one has none, gives each token's label as a
chance, and the field learns from those, ``ROUNDS`` times.

Scale: the sample's bounds are parameters and the fitted weights have a fixed
size. One executor task fits the field, so that the driver sees no text.
Scoring is one pass without a shuffle: a token's weight depends on its
word only and is kept by word, and a batch's tokens run through the recursions
together, however long single documents are.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chains import Chain, firsts, marginals
from .common import ASCII_LOWER, WORD, crc_mod, ship, table, tidy

HELD_OUT = 5
#: The sample that the field is fitted on: rows, bytes of all its texts, tokens of the gradient.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_TOKENS = 8000, 48 << 20, 400_000
#: Features of a word at most, and their hashed numbers.
FEATURES = 9
DIM = 1 << 18
COVER_DIM = 1 << 22
#: Steps of the gradient on the cover's labels; rounds of new labels, and steps on each.
ITERATIONS, ROUNDS, ROUND_STEPS = 50, 3, 10
NOTABLE = 0.1
PURE = 0.85
PUNCTUATION = b".,;:!?()[]{}\"'|"
CACHE = 300_000
PIECE_TOKENS = 1 << 17


def features(word: bytes) -> list[bytes]:
    """The word without surrounding punctuation, its beginnings and its ends."""
    w = word.strip(PUNCTUATION).decode("utf-8", "replace")
    out = [f"={w}"] + [f"^{w[:n]}" for n in (3, 4, 5, 6) if len(w) >= n] + [f"{w[-n:]}$" for n in (3, 4, 5, 6) if len(w) >= n]
    return [f.encode() for f in out]


def hashes(words: list[bytes]) -> np.ndarray:
    """(n, FEATURES) crc32 of the words' features, 0 where a word has fewer."""
    out = np.zeros((len(words), FEATURES), np.uint32)
    for i, w in enumerate(words):
        found = [zlib.crc32(f) for f in features(w)]
        out[i, : len(found)] = found
    return out


def numbered(raw: np.ndarray, dim: int) -> np.ndarray:
    """Feature numbers below ``dim``, 0 for none."""
    return np.where(raw > 0, 1 + raw % np.uint32(dim - 1), 0).astype(np.int32)


class Field:
    """Emission weights of the toxic state by feature (clean is 0), log start and transition
    weights, and the weights of a document's score."""

    def __init__(self, theta: np.ndarray, bias: float, start: np.ndarray, trans: np.ndarray, beta: np.ndarray | None = None):
        self.theta, self.bias, self.start, self.trans, self.beta = theta, bias, start, trans, beta
        self.known: dict[bytes, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        return self.theta[numbered(hashes(words), DIM)].sum(1) + self.bias

    def tokens(self, words: list[bytes]) -> np.ndarray:
        if new := [w for w in set(words) if w not in self.known]:
            if len(self.known) > CACHE:
                self.known.clear()
                new = list(set(words))
            self.known.update(zip(new, self.word_scores(new).tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The chance that each token is toxic, of documents with at least one token each."""
        return self.run(scores, lengths)[0][:, 1]

    def run(self, scores: np.ndarray, lengths: np.ndarray, weight: np.ndarray | None = None):
        s = np.clip(scores, -30, 30)
        top = np.maximum(s, 0)
        e = np.stack([np.exp(-top), np.exp(s - top)], axis=1)
        start = np.exp(self.start)
        return marginals(Chain(firsts(lengths)), e, start / start.sum(), np.exp(self.trans), weight)

    def all_clean(self, scores: np.ndarray, lengths: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """The chance of each document that no token is toxic, from the scales of ``run``."""
        at = np.cumsum(lengths) - lengths
        rest = np.add.reduceat(np.maximum(np.clip(scores, -30, 30), 0) + np.log(scale), at)
        path = self.start[0] - np.log(np.exp(self.start).sum()) + (lengths - 1) * self.trans[0, 0] - rest
        return np.exp(np.minimum(path, 0))


def under_labels(field: Field, scores: np.ndarray, lengths: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the documents' labels make of the field: each token's chance to be toxic, the expected
    first states and moves.

    A clean document has no toxic token, a toxic one at least one: of the
    marginals of all paths the path without any is taken out.
    """
    _, _, scale = field.run(scores, lengths)
    none = field.all_clean(scores, lengths, scale)
    some = np.maximum(1 - none, 1e-9)
    share = np.where(toxic, 1 / some, 0.0)
    gamma, moves, _ = field.run(scores, lengths, np.repeat(share, lengths))
    chance = np.minimum(gamma[:, 1] * np.repeat(share, lengths), 1.0)
    first = chance[np.cumsum(lengths) - lengths].sum()
    # Paths without a toxic token have clean moves only: a clean document's own, and too many of a toxic one's.
    moves = moves + np.diag([((lengths - 1) * np.where(toxic, -none / some, 1.0)).sum(), 0.0])
    return chance, np.array([len(lengths) - first, first]), np.maximum(moves, 0)


def _coded(texts: Iterable[tuple[bytes, int]]) -> tuple[list[bytes], list[tuple[np.ndarray, int]]]:
    """The words of the sample, and each text's word numbers and label.

    A text that shares one of four min-hashes of word triples with an earlier one is left out.
    """
    place: dict[bytes, int] = {}
    seen: set[tuple[int, int]] = set()
    out = []
    for text, label in texts:
        words = text.lower().split()
        if not words:
            continue
        grams = np.array([zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))], np.uint64)
        marks = {(j, int((grams * np.uint64(m) % np.uint64(4294967291)).min())) for j, m in enumerate((2654435761, 40503, 2246822519, 3266489917))}
        if not marks & seen:
            out.append((np.array([place.setdefault(w, len(place)) for w in words], np.int32), label))
        seen |= marks
    return list(place), out


def token_labels(docs: list[tuple[np.ndarray, int]], numbers: np.ndarray) -> np.ndarray:
    """Which words are toxic: by greedy cover of the toxic documents.

    ``docs`` holds word numbers and the label, ``numbers`` (words, FEATURES). A
    candidate is a feature in one token, or in several, of documents of which
    PURE are toxic, so many of them that chance among all features can't
    explain it (by the divergence of the two shares).
    """
    toxic = np.array([y for _, y in docs], bool)
    share = toxic.mean()
    found: list[np.ndarray] = []

    def own(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(numbers[w], return_counts=True)

    counts = np.zeros((2, 2, COVER_DIM), np.int32)  # by least, label, feature
    for w, y in docs:
        f, c = own(w)
        counts[0, y, f] += 1
        counts[1, y, f[c >= 2]] += 1
    for n in counts:
        n[:, 0] = 0
        often = np.nonzero(n[1] > 2)[0]
        n = n[:, often]  # noqa: PLW2901
        pure = n[1] / n.sum(0)
        told = n.sum(0) * (pure * np.log(np.maximum(pure, 1e-9) / share) + (1 - pure) * np.log(np.maximum(1 - pure, 1e-9) / (1 - share)))
        found.append(often[(pure >= PURE) & (told >= np.log(max(1, len(often))) + 3)])
    if not sum(map(len, found)):
        return np.zeros(len(numbers), bool)
    has, names = np.zeros((int(toxic.sum()), sum(map(len, found))), bool), np.concatenate(found)
    for row, w in zip(has, (w for w, y in docs if y), strict=True):
        f, c = own(w)
        row[:] = np.concatenate([np.isin(found[0], f), np.isin(found[1], f[c >= 2])])
    covered, chosen = np.zeros(len(has), bool), []
    while True:
        gain = has[~covered].sum(0) + 0.2 * has[covered].sum(0)
        gain[chosen] = 0
        if gain.max() < 4:
            break
        chosen.append(int(gain.argmax()))
        covered |= has[:, chosen[-1]]
    return np.isin(numbers, names[chosen]).any(1)


def fit(texts: Iterable[tuple[bytes, int]]) -> Field | None:
    """The field of a labelled sample; None if it has no toxic or no clean text."""
    words, docs = _coded(texts)
    if len({y for _, y in docs}) < 2:
        return None
    raw = hashes(words)
    bad = token_labels(docs, numbered(raw, COVER_DIM))
    # Toxic documents first, then clean ones, up to the bound.
    train, total = [], 0
    for y, share in ((1, 0.5), (0, 1.0)):
        for w, label in docs:
            if label == y and total + len(w) <= share * SAMPLE_TOKENS:
                train.append((w, y))
                total += len(w)
    if not train:
        return None
    tokens = np.concatenate([w for w, _ in train])
    lengths = np.array([len(w) for w, _ in train])
    truth = bad[tokens] & np.repeat([y == 1 for _, y in train], lengths)
    used, tokens = np.unique(tokens, return_inverse=True)
    x = numbered(raw[used], DIM)
    first = firsts(lengths)
    inner = np.nonzero(~first)[0]
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (truth[inner - 1].astype(int), truth[inner].astype(int)), 1)
    seen_start = np.bincount(truth[first].astype(int), minlength=2)
    toxic = np.array([y == 1 for _, y in train])
    field = Field(np.zeros(DIM), -4.0, np.zeros(2), np.zeros((2, 2)))
    # Adam on the penalised negative log likelihood, all tokens at once.
    size = DIM + 7
    value, m, v = np.concatenate([field.theta, [field.bias], field.start, field.trans.ravel()]), np.zeros(size), np.zeros(size)
    for step in range(1, ITERATIONS + ROUNDS * ROUND_STEPS + 1):
        field = Field(value[:DIM], value[DIM], value[DIM + 1 : DIM + 3], value[DIM + 3 :].reshape(2, 2))
        scores = (field.theta[x].sum(1) + field.bias)[tokens]
        if step > ITERATIONS and (step - ITERATIONS - 1) % ROUND_STEPS == 0:
            truth, seen_start, seen_moves = under_labels(field, scores, lengths, toxic)
        gamma, moves, _ = field.run(scores, lengths)
        off = gamma[:, 1] - truth
        by_word = np.bincount(tokens, off, len(used))
        g = np.bincount(x.ravel(), np.repeat(by_word, FEATURES), DIM)
        g[0] = 0
        g = np.concatenate([g, [off.sum()], gamma[first].sum(0) - seen_start, (moves - seen_moves).ravel()]) + 0.05 * value
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        value = value - 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    field = Field(value[:DIM].copy(), float(value[DIM]), value[DIM + 1 : DIM + 3].copy(), value[DIM + 3 :].reshape(2, 2).copy())
    shown, labels, score = [], [], field.theta[numbered(raw, DIM)].sum(1) + field.bias
    piece = np.cumsum([len(w) for w, _ in docs]) // PIECE_TOKENS
    for part in (docs[a:b] for a, b in zip(*_runs(piece), strict=True)):
        lengths = np.array([len(w) for w, _ in part])
        p = field.marginals(score[np.concatenate([w for w, _ in part])], lengths)
        shown += [evidence(x) for x in np.split(p, np.cumsum(lengths)[:-1])]
        labels += [y for _, y in part]
    field.beta = logistic(np.array(shown), np.array(labels, float))
    return field


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of runs of equal values."""
    begins = np.nonzero(np.diff(x, prepend=x[0] - 1))[0]
    return begins, np.append(begins[1:], len(x))


def evidence(p: np.ndarray) -> list[float]:
    """Of a document's marginals: one, the largest one's log odds, the log of the expected number."""
    top = np.clip(p.max(initial=0.0), 1e-6, 1 - 1e-6)
    return [1.0, float(np.log(top / (1 - top))), float(np.log1p(p[p >= NOTABLE].sum()))]


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a penalised logistic regression with no negative slope, by projected Newton steps."""
    beta, penalty = np.zeros(x.shape[1]), np.array([1e-3, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-6)
        step = np.linalg.solve(h, x.T @ (p - y) + penalty * beta)
        beta = beta - step * min(1, 2 / max(1e-9, np.abs(step).max()))
        beta[1:] = np.maximum(beta[1:], 0)
    return beta


def document_score(field: Field, p: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(np.dot(evidence(p), field.beta), -30, 30))))


def spans(text: str, p: np.ndarray) -> list[dict]:
    """Character offsets [start, end) of runs of tokens of marginal 0.5 or more, with the largest marginal."""
    out: list[dict] = []
    last = -2
    for i, m in enumerate(re.finditer(WORD, text.translate(ASCII_LOWER))):
        if p[i] >= 0.5:
            if last == i - 1:
                out[-1] |= {"end": m.end(), "p": max(out[-1]["p"], float(p[i]))}
            else:
                out.append({"start": m.start(), "end": m.end(), "p": float(p[i])})
            last = i
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
_SPANS_SQL = "array<struct<start:int,end:int,p:double>>"


def judge(field: Field | None, texts: list[bytes | None], with_spans: bool = True) -> tuple[list[float], list[list[dict]]]:
    """Scores and spans of a batch of texts."""
    nothing = document_score(field, np.zeros(0)) if field else 0.0
    score, found = [nothing] * len(texts), [[] for _ in texts]

    def flush(rows: list[int], words: list[list[bytes]]) -> None:
        lengths = np.array([len(w) for w in words])
        p = field.marginals(field.tokens([w for d in words for w in d]), lengths)
        for i, part in zip(rows, np.split(p, np.cumsum(lengths)[:-1]), strict=True):
            score[i] = document_score(field, part)
            if with_spans and (part >= 0.5).any():
                found[i] = spans(texts[i].decode("utf-8", "replace"), part)

    rows, words, n = [], [], 0
    for i, text in enumerate(texts if field else []):
        if w := (text or b"").lower().split():
            rows.append(i)
            words.append(w)
            n += len(w)
            if n >= PIECE_TOKENS:
                flush(rows, words)
                rows, words, n = [], [], 0
    if rows:
        flush(rows, words)
    return score, found


def _score(field: Field | None):
    """Batches whose last column is the text: that column goes, score and spans come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, found = judge(field, batch.column(batch.num_columns - 1).to_pylist())
            columns = [*batch.columns[:-1], pa.array(score, pa.float64()), pa.array(found, _SPANS)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "score", "spans"])

    return tidy(run)


def _clean(field: Field | None, text: int):
    """Batches without the rows whose text scores 0.5 or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, _ = judge(field, batch.column(text).cast(pa.binary()).to_pylist(), False)
            yield batch.filter(pa.array([s < 0.5 for s in score], pa.bool_()))

    return tidy(run)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (text, label) in the sample's order to the fitted field."""

    def sample() -> Iterator[tuple[bytes, int]]:
        rows = size = 0
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rows < SAMPLE_ROWS and size + len(text) <= SAMPLE_BYTES:
                    rows, size = rows + 1, size + len(text)
                    yield text, int(y > 0)

    yield pa.record_batch([pa.array([pickle.dumps(fit(sample()))], pa.binary())], names=["field"])


def train(docs: DataFrame, labels: DataFrame, learn=None, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Field | None:
    """Fits the field on labelled rows where ``learn`` holds (default: not held out).

    Of rows with a label and a text, the SAMPLE_ROWS with the smallest hash of
    the key are taken, as long as their texts, which are taken whole, fit into
    SAMPLE_BYTES together. Rows without a label or key
    don't count; a key with several labels counts as toxic if one says so.
    """
    ship(docs.sparkSession)
    learn = (crc_mod(key, HELD_OUT) != 0) if learn is None else learn
    one = labels.select(F.col(key), F.col(label).cast("int").alias("y")).filter("y is not null").groupBy(key).agg(F.max("y").alias("y"))
    h = F.crc32(F.concat(F.lit("sample "), F.col(key).cast("string")).cast("binary"))
    # Only hashes below a limit can be among the smallest: half as many again as are wanted.
    limit = int(min(1.0, 1.5 * SAMPLE_ROWS / max(1, one.count())) * 2**32)
    near = one.filter(h < limit)
    rows = docs.select(F.col(key), F.col(text).cast("binary").alias("t")).filter(learn & (h < limit) & F.col("t").isNotNull())
    picked = rows.join(near, key).select("t", "y", h.alias("h")).repartition(1).sortWithinPartitions("h", "t")  # 1.5 SAMPLE_ROWS or so
    found = picked.select("t", "y").mapInArrow(tidy(_fit), "field binary").collect()  # one row, of the weights' size
    return pickle.loads(found[0][0]) if found else None


def score_toxicity(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus score, spans and predicted (1 if score >= 0.5).

    Null, empty and wordless texts have the score of no evidence and no spans;
    every text has score 0 if no field could be fitted. Very long texts are one
    chain, judged whole. Columns named score, spans or predicted are
    replaced, others come along. Every row, repeated or not, gives a row; an empty table none.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in {text.lower(), "score", "spans", "predicted"}]
    slim = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("binary").alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]]
    out = slim.mapInArrow(_score(field), ", ".join([*fields, "score double", f"spans {_SPANS_SQL}"]))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`score_toxicity` predicts toxic; columns stay."""
    ship(docs.sparkSession)
    return docs.mapInArrow(_clean(field, docs.columns.index(text)), docs.schema)


def op2_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = train(docs, labels)
    held = docs.select("doc_id", (crc_mod("doc_id", HELD_OUT) == 0).alias("held_out"), "text")
    return score_toxicity(held, field).select("doc_id", "held_out", "score", "predicted", "spans")

"""The trained operators: recursions, language model, toxicity; and the pipeline."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chains, decontaminate, hmm_lm, mixing, simhash, token_codes, toxicity
from tidemark.llm.common import Scratch

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, score double, id long, held_out string, word string, chunk long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 9.0, 9, "x", "x", 9) for i, t in rows], DOC)


# Recursions


def brute_chain(e, initial, trans):
    k = len(initial)
    total, gamma, moves = 0.0, np.zeros(e.shape), np.zeros((k, k))
    for path in itertools.product(range(k), repeat=len(e)):
        w = initial[path[0]] * e[0, path[0]]
        for t in range(1, len(e)):
            w *= trans[path[t - 1], path[t]] * e[t, path[t]]
        total += w
        for t, s in enumerate(path):
            gamma[t, s] += w
            if t:
                moves[path[t - 1], s] += w
    return total, gamma / total, moves / total


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 4, 6, 2, 5])
    e, initial, trans = rng.uniform(0.1, 2, (18, 3)), rng.uniform(0.1, 1, 3), rng.uniform(0.1, 1, (3, 3))
    gamma, moves, scale = chains.marginals(chains.Chain(chains.firsts(lengths)), e, initial, trans)
    want_moves, at, logs = np.zeros((3, 3)), 0, np.log(scale)
    for n in lengths:
        total, g, m = brute_chain(e[at : at + n], initial, trans)
        assert np.allclose(gamma[at : at + n], g)
        if at:  # the first document's scale has the initial weights as they are
            assert logs[at : at + n].sum() == pytest.approx(math.log(total))
        want_moves += m
        at += n
    assert np.allclose(moves, want_moves)


def test_blocks_link_exactly():
    rng = np.random.default_rng(1)
    lengths = np.array([1, chains.STEPS * 3 + 5, 2, chains.STEPS, 700])
    e, initial, trans = rng.uniform(0.01, 3, (int(lengths.sum()), 4)), np.full(4, 0.25), rng.dirichlet(np.ones(4), 4)
    chain = chains.Chain(chains.firsts(lengths))
    _, scale, _ = chains.forward(chain, chain.fold(e), initial, trans)
    at = 0
    for n in lengths:
        v, log = initial, 0.0
        for t in range(n):
            v = (v if t == 0 else v @ trans) * e[at + t]
            log += math.log(v.sum())
            v = v / v.sum()
        assert np.log(chain.tokens(scale)[at : at + n]).sum() == pytest.approx(log)
        at += n


def test_baum_welch_does_not_lose_likelihood():
    rng = np.random.default_rng(2)
    types, lengths = rng.integers(0, 20, 3000), np.full(30, 100)
    counts = np.bincount(types, minlength=20).astype(float)
    model, seen = hmm_lm.Model.random(counts, 3, 1), []
    for _ in range(8):
        a, b, c, log = hmm_lm.expected(chains.Chain(chains.firsts(lengths)), types, model.ratio[types], model.initial, model.trans, 20)
        assert c.sum() == pytest.approx(3000) and a.sum() == pytest.approx(30) and b.sum() == pytest.approx(2970)
        seen.append(log)
        model = hmm_lm.Model.fitted(a, b, c, counts)
    assert seen[-1] > seen[0]
    assert np.allclose((counts / counts.sum()) @ model.ratio, 1)


# Language model


def words(text):
    return (text or "").encode().lower().split()


def test_scores_of_the_base_and_proper_model(spark, monkeypatch):
    monkeypatch.setattr(hmm_lm, "CHUNK_BYTES", 600)
    rows = [(i, " ".join(f"{'AB'[i % 2]}w{(i * j) % 13}" for j in range(i % 17))) for i in range(120)] + [(500, None), (501, ""), (None, "aw1"), (7, "unseen words"), (7, "unseen words")]
    got = hmm_lm.score_documents(docs(spark, rows).repartition(3), Scratch(spark, "t")).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    count = Counter(w for i, t in rows if not held(i) for w in [*words(t), b""])
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), held(i), len(words(t)) + 1, sum(count[w] > 0 for w in [*words(t), b""]), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), b""]), 9)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    # the model's probabilities of all one-word texts (known words and one unseen) and the empty text sum to one at most
    probe = [(10_000 + i, w.decode()) for i, w in enumerate(w for w in count if w)] + [(20_000, "never-seen"), (20_001, "")]
    both = docs(spark, [*rows, *probe])
    scored = hmm_lm.score_documents(both, Scratch(spark, "t"), held_out=(F.col("doc_id") >= 10_000) | (hmm_lm.crc_mod("doc_id", 10) == 0)).filter("doc_id >= 10000").collect()
    assert 0 < sum(10 ** r["score"] for r in scored) <= 1 + 1e-9


def test_scores_by_brute_force(spark, monkeypatch):
    """A document's score against the forward recursion, token by token, of the model that was trained."""
    monkeypatch.setattr(hmm_lm, "CHUNK_BYTES", 900)
    models, train = [], hmm_lm.trained
    monkeypatch.setattr(hmm_lm, "trained", lambda *a: models.append(train(*a)) or models[-1])
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.5, rng.integers(0, 60)) if x < 400)) for i in range(150)] + [(900, "w1 " * 1000), (901, None), (902, "new w1 words"), (None, "w2 w2")]
    got = hmm_lm.score_documents(docs(spark, rows).repartition(3), Scratch(spark, "t"), states=3).collect()
    model = models[0]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    count = Counter(w for i, t in rows if not held(i) for w in [*words(t), b""])
    n, unseen = sum(count.values()), (sum(c == 1 for c in count.values()) + 1) / (sum(count.values()) + 1)
    frequent = sorted((w for w, c in count.items() if c > 1 and w), key=lambda w: (-count[w], w))
    kind = {w: hmm_lm.CLASSES + 1 + i for i, w in enumerate(frequent)} | {b"": 0}

    def brute(text):
        v, log = None, 0.0
        for w in [*words(text), b""]:
            shared = zlib.crc32(w[:1] + b"\0" + w[-2:]) % hmm_lm.CLASSES + 1
            e = (1 - unseen) * count[w] / n * model.ratio[kind.get(w, shared)] if count[w] else np.full(3, unseen)
            v = (model.initial if v is None else v @ model.trans) * e
            log += math.log10(v.sum())
            v = v / v.sum()
        return log

    assert len(got) == len(rows)
    want = sorted((str(i), round(brute(t), 6)) for i, t in rows)
    assert sorted((str(r["doc_id"]), round(r["score"], 6)) for r in got) == want


def test_training_goes_on_until_the_likelihood_settles(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"{'ab'[(j // 9) % 2]}{x}" for j, x in enumerate(rng.integers(0, 30, 200)))) for i in range(60)]
    logs, expect = [], hmm_lm.Model.fitted
    monkeypatch.setattr(hmm_lm, "WARM_TOKENS", 600)
    monkeypatch.setattr(hmm_lm.Model, "fitted", staticmethod(lambda *a: logs.append(1) or expect(*a)))
    few = hmm_lm.score_documents(docs(spark, rows), Scratch(spark, "t"), states=2, gain=1.0).agg(F.sum("score")).first()[0]
    n_few = len(logs)
    many = hmm_lm.score_documents(docs(spark, rows), Scratch(spark, "t"), states=2, gain=1e-4).agg(F.sum("score")).first()[0]
    assert len(logs) - n_few > n_few and many > few


def test_the_warm_start_takes_whole_documents(monkeypatch):
    monkeypatch.setattr(hmm_lm, "WARM_TOKENS", 10)
    texts = [np.arange(n, dtype="<i4") for n in (4, 7, 5, 1, 3)]
    assert [len(x) for x in hmm_lm.warm_sample([t.tobytes() for t in texts])] == [4, 5, 1]


def test_language_model_edges(spark):
    assert hmm_lm.score_documents(docs(spark, []), Scratch(spark, "t")).count() == 0
    lone = hmm_lm.score_documents(docs(spark, [(1, "a b")]), Scratch(spark, "t"), held_out=F.lit(True)).first()
    assert (lone["train_tokens"], lone["n_known"], lone["n_tokens"]) == (0, 0, 3)


def test_the_registered_model_has_six_states(spark, monkeypatch):
    seen, train = [], hmm_lm.train_local
    monkeypatch.setattr(hmm_lm, "train_local", lambda *a, **b: seen.append(train(*a, **b)) or seen[-1])
    hmm_lm.op5_hmm_lm(spark, "/root/testdata/sf0.001")
    assert [(m.initial.shape, m.trans.shape, m.ratio.shape[1]) for m in seen] == [((6,), (6, 6), 6)]


def test_language_model_beats_the_base_on_held_out_documents(spark):
    got = hmm_lm.op5_hmm_lm(spark, SF).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.avg((F.col("score") > F.col("base_score")).cast("int"))).first()
    assert got[0] > 0.9 * got[1] and got[0] > got[1] and got[2] > 0.9


# Toxicity


def toxic_sample():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(900):
        text = [vocabulary[j] for j in rng.integers(0, 300, rng.integers(5, 60))]
        y = int(i % 6 == 0)
        if y:
            text[int(rng.integers(len(text)))] = str(rng.choice(["Badword,", "nasty"]))
        rows.append((i, " ".join(text), y))
    return rows


def test_field_learns_words_and_spans(spark):
    rows = toxic_sample()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    field = toxicity.train(docs(spark, [(i, t) for i, t, _ in rows]), labels)
    probe = [(1, "w1 w2 é BADWORD! w3"), (2, "w1 w2 w3"), (3, None), (4, ""), (5, " \n"), (None, "nasty nasty w1"), (6, "w5 " * 40_000), (6, "w5 " * 40_000 + "nasty")]
    got = toxicity.score_toxicity(docs(spark, probe).drop("score").withColumn("spans", F.lit(0)), field).collect()
    by = {(r["doc_id"], i): r for i, r in enumerate(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["score"])))}
    found = {k[0]: r for k, r in by.items()}
    assert len(got) == len(probe)
    assert found[1]["predicted"] == 1 and [(s["start"], s["end"]) for s in found[1]["spans"]] == [(8, 16)]
    assert found[None]["predicted"] == 1 and [(s["start"], s["end"]) for s in found[None]["spans"]] == [(0, 11)]
    assert all(found[i]["predicted"] == 0 and not found[i]["spans"] for i in (2, 3, 4, 5))
    assert sorted(r["predicted"] for r in got if r["doc_id"] == 6) == [0, 1]
    assert all(0 <= r["score"] <= 1 for r in got)


def test_the_gradient_takes_400_000_tokens(monkeypatch):
    seen, run = [], toxicity.Field.run
    monkeypatch.setattr(toxicity, "ITERATIONS", 1)
    monkeypatch.setattr(toxicity, "ROUNDS", 0)
    monkeypatch.setattr(toxicity.Field, "run", lambda self, score, lengths, *a: seen.append(int(lengths.sum())) or run(self, score, lengths, *a))
    toxicity.fit((" ".join([f"w{i}x{j % 50}" for j in range(999)] + ["nasty" if i % 2 else "fine"]).encode(), i % 2) for i in range(600))
    assert seen[0] == 400_000


def test_labels_given_the_documents_by_enumeration():
    rng = np.random.default_rng(7)
    lengths, toxic = np.array([3, 1, 5, 2, 4]), np.array([True, True, False, True, False])
    field = toxicity.Field(np.zeros(4), 0.0, rng.normal(size=2), rng.normal(size=(2, 2)))
    scores, at = rng.normal(size=15), 0
    chance, start, moves = toxicity.under_labels(field, scores, lengths, toxic)
    want, first, want_moves = np.zeros(15), np.zeros(2), np.zeros((2, 2))
    for n, y in zip(lengths, toxic, strict=True):
        paths = [p for p in itertools.product((0, 1), repeat=int(n)) if any(p) == y]
        weight = np.array([math.exp(field.start[p[0]] + sum(field.trans[a, b] for a, b in zip(p, p[1:])) + sum(scores[at + i] for i in range(n) if p[i])) for p in paths])
        for p, w in zip(paths, weight / weight.sum(), strict=True):
            want[at : at + n] += w * np.array(p)
            first[p[0]] += w
            for a, b in zip(p, p[1:]):
                want_moves[a, b] += w
        at += n
    assert np.allclose(chance, want) and np.allclose(start, first) and np.allclose(moves, want_moves)


def test_document_scores_and_spans_by_brute_force(spark):
    """Whole documents against plain forward-backward in logarithms, a document at a time."""
    field = toxicity.fit((t.encode(), y) for _, t, y in toxic_sample())
    rows = [(i, t) for i, t, _ in toxic_sample()[:120]] + [(1000, None), (1001, ""), (1002, "nasty " * 300), (1003, "w1 \t nasty\nBADWORD! w2 nasty"), (1003, "w1")]
    got = toxicity.score_toxicity(docs(spark, rows).drop("score"), field).collect()

    def add(a, b):
        return max(a, b) + math.log1p(math.exp(-abs(a - b)))

    def brute(text):
        tokens = words(text)
        if not tokens:
            return toxicity.document_score(field, np.zeros(0)), []
        s = np.clip(field.word_scores(tokens), -30, 30).tolist()
        f = [[field.start[0], field.start[1] + s[0]]]
        for x in s[1:]:
            f.append([add(f[-1][0] + field.trans[0, j], f[-1][1] + field.trans[1, j]) + (x if j else 0) for j in (0, 1)])
        b = [[0.0, 0.0]]
        for x in s[:0:-1]:
            b.append([add(b[-1][0] + field.trans[j, 0], b[-1][1] + field.trans[j, 1] + x) for j in (0, 1)])
        z = add(*f[-1])
        p = np.array([math.exp(u[1] + v[1] - z) for u, v in zip(f, b[::-1], strict=True)])
        return toxicity.document_score(field, p), [(x["start"], x["end"]) for x in toxicity.spans(text, p)]

    want = sorted((i, round(brute(t)[0], 6), brute(t)[1]) for i, t in rows)
    assert sorted((r["doc_id"], round(r["score"], 6), [(x["start"], x["end"]) for x in r["spans"]]) for r in got) == want
    assert any(w[2] for w in want)


def test_long_labelled_texts_count_within_the_bytes_of_the_sample(spark, monkeypatch):
    seen, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 60_000)
    monkeypatch.setattr(toxicity, "fit", lambda texts: seen.append([len(t) for t, _ in texts]) or fit(iter([])))
    texts = [b"x" * n for n in (10, 50_000, 20_000, 9_000, 900, 5)]
    import pyarrow as pa

    list(toxicity._fit(iter([pa.record_batch([pa.array(texts[:2]), pa.array([0, 1])], names=["t", "y"]), pa.record_batch([pa.array(texts[2:]), pa.array([1, 0, 0, 1])], names=["t", "y"])])))
    assert seen == [[10, 50_000, 9_000, 900, 5]]


def test_toxicity_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(docs(spark, [(1, "a")]), labels) is None
    got = toxicity.score_toxicity(docs(spark, [(1, "a")]), None).first()
    assert got["score"] == 0.0 and got["predicted"] == 0
    field = toxicity.fit((t.encode(), y) for _, t, y in toxic_sample())
    assert toxicity.score_toxicity(docs(spark, []), field).count() == 0


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op2_toxicity_crf(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").select("toxic", "predicted").collect()
    hit, all_toxic, wrong = sum(r[0] and r[1] for r in got), sum(r[0] for r in got), sum(r[1] and not r[0] for r in got)
    assert hit >= 0.85 * all_toxic and wrong <= 0.01 * len(got)


# Pipeline


def test_stages_against_brute_force(spark):
    scratch, now = Scratch(spark, "t"), spark.read.parquet(f"{SF}/documents.parquet")
    columns = now.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, scratch.save(stage(spark, now, SF))
        seen[name] = (before, now)
        if name != "token_output":
            assert now.columns == columns
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())

    before, after = seen["toxicity"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(ids(before)) - set(ids(after))
    assert gone and sum(labels.get(i) == 0 for i in gone) <= 2

    before, after = seen["near_copies"]
    prints = {r["doc_id"]: simhash.fingerprint((r["text"] or "").encode()) for r in before.collect()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert ids(after) == sorted(i for i in prints if find(i) == i)

    before, after = seen["decontamination"]
    items = [decontaminate.words_of(r["text"].encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    exact = set()
    for r in before.collect():
        text = b" " + b" ".join(decontaminate.words_of((r["text"] or "").encode())) + b" "
        if any(b" " + b" ".join(i) + b" " in text for i in items):
            exact.add(r["doc_id"])
    gone = set(ids(before)) - set(ids(after))
    assert exact and exact <= gone and len(gone - exact) <= 3

    before, after = seen["mixing"]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(before, scratch).collect()}
    assert Counter(ids(after)) == Counter({i: c for i, c in copies.items() if c})

    before, after = seen["token_output"]
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(token_codes.tokenizer_file("byte_bpe_50k.json")).encode
    texts = sorted((r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect())
    start = 0
    got = after.orderBy("start").collect()
    assert len(got) == len(texts)
    for r, (i, t) in zip(got, texts, strict=True):
        x = np.array([*encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(r) == (i, start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)


def test_stages_keep_the_right_rows_of_odd_tables(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, ties, extra columns with clashing names, empty tables."""
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    extra = {"score": "double", "row": "string", "fp": "long", "component_id": "long", "id": "long", "size": "long", "copies": "int", "q": "double", "of": "string", "key": "string", "hash": "long", "part": "int", "t": "string"}
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{k} {v}" for k, v in extra.items())
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    long, other = "x " * 30_000, " ".join(f"v{i}" for i in range(500))
    texts = [(1, None, None), (None, "a b c", "s"), (2, "", "s"), (2, "", "s"), (3, long, "s"), (None, None, None), (4, other, "t"), (5, other, "t"), (5, other, "t"), (6, f"start {item} end", "t"), (7, long, "t")]
    clash = [0.5, "r", 1, 2, 3, 4, 5, 6.0, "o", "k", 7, 8, "t"]
    rows = [(i, t, "en", source, 3, *clash) for i, t, source in texts]
    ids = lambda df: sorted(((r["doc_id"], len(r["text"] or "")) for r in df.collect()), key=repr)
    stages = dict(corpus_pipeline.STAGES)
    for case in ([], rows):
        docs = spark.createDataFrame(case, schema).repartition(3)
        run = lambda name, df: Scratch(spark, "t").save(stages[name](spark, df, str(tmp_path)))  # noqa: B023, E731
        clean = run("toxicity", docs)
        assert clean.columns == docs.columns and ids(clean) == ids(docs)
        alone = run("near_copies", clean)
        assert alone.columns == docs.columns
        # empty and null texts have one fingerprint; repeated rows of the id that stays all stay; rows without an id stay
        want = [(1, 0), (3, len(long)), (4, len(other)), (6, len(item) + 10), (None, 0), (None, 5)]
        assert ids(alone) == sorted(want if case else [], key=repr)
        free = run("decontamination", alone)
        assert free.columns == docs.columns and ids(free) == sorted([w for w in want if w[0] != 6] if case else [], key=repr)
        mix = run("mixing", free)
        copies = {(r["doc_id"], r["size"]): r["copies"] for r in mixing.mix(free, Scratch(spark, "t")).collect()}
        assert mix.columns == docs.columns and set(copies.values()) <= {0, 1, 2}
        sizes = {(r["doc_id"], len((r["text"] or "").split())) for r in free.collect()}
        assert set(copies) == sizes
        assert Counter((r["doc_id"], len((r["text"] or "").split())) for r in mix.collect()) == Counter({k: c for k, c in copies.items() if c})
        out = run("token_output", mix)
        assert Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in mix.collect())
        assert [r["start"] for r in out.orderBy("start").collect()] == list(itertools.accumulate((r["n_tokens"] for r in out.orderBy("start").collect()), initial=0))[:-1]


def test_run_removes_what_its_stages_have_read(spark):
    from tidemark.llm.common import shared_folder

    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.FileSystem.getLocal(spark.sparkContext._jsc.hadoopConfiguration())
    tables = lambda: {str(x.getPath()) for x in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tidemark/pipeline*/*"))}
    before = tables()
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").orderBy("start").collect()
    assert got and [r["start"] for r in got] == list(itertools.accumulate((r["n_tokens"] for r in got), initial=0))[:-1]
    left = tables() - before
    assert len(left) == 2 and sum("/pipeline-run-" in x for x in left) == 1  # the result and the token files


def test_an_iteration_sends_few_rows_that_sum_to_the_counts():
    rng, n_types = np.random.default_rng(3), 3000
    lengths, held = rng.integers(1, 400, 40), rng.random(40) < 0.2
    tokens = rng.integers(0, n_types, int(lengths.sum()))
    kinds = rng.permutation(n_types)
    columns = [
        pa.array([list(range(40))], pa.list_(pa.int64())),
        pa.array([held.tolist()], pa.list_(pa.bool_())),
        pa.array([lengths.tolist()], pa.list_(pa.int32())),
        pa.array([zstandard.compress(tokens.astype("<i4").tobytes())], pa.binary()),
        pa.array([kinds.astype("<i4").tobytes()], pa.binary()),
        pa.array([np.ones(n_types, "<i8").tobytes()], pa.binary()),
    ]
    ready = pa.RecordBatch.from_arrays(columns, names=hmm_lm._READY)
    model = hmm_lm.Model.random(np.ones(n_types), 3, 1)
    sent = list(hmm_lm._expectation(model, n_types)(iter([ready, ready])))
    assert sum(x.num_rows for x in sent) <= 10  # not one for each type
    total = {i: np.frombuffer(x, "<f8") for x in hmm_lm._summed(iter([*sent, *sent])) for i, x in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)}
    types = kinds[tokens[np.repeat(~held, lengths)]]
    a, b, c, log = hmm_lm.expected(chains.Chain(chains.firsts(lengths[~held])), types, model.ratio[types], model.initial, model.trans, n_types)
    assert np.allclose(total.pop(-1), 4 * np.concatenate([[log], a, b.ravel()]), rtol=1e-4)
    assert np.allclose(np.concatenate([total[i] for i in sorted(total)]).reshape(-1, 3), 4 * c, atol=1e-3)


def test_near_copies_stage_with_many_links_takes_few_jobs(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(40 * g + i, f"{text} w{i}") for g in range(12) for text in [" ".join(f"x{rng.randrange(5000)}" for _ in range(95))] for i in range(40)]
    docs, sc, kept, jobs = spark.createDataFrame(rows, "doc_id long, text string"), spark.sparkContext, {}, {}
    for most in (1 << 20, 300):
        monkeypatch.setattr("tidemark.llm.components.ONE_TASK", most)
        sc.setJobGroup(f"near-copies-{most}", "")
        try:
            kept[most] = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        jobs[most] = len(sc.statusTracker().getJobIdsForGroup(f"near-copies-{most}"))
    assert kept[300] == kept[1 << 20]
    assert jobs[300] <= jobs[1 << 20] + 40


def test_near_copies_stage_writes_no_raw_links_and_takes_few_jobs(spark):
    rng = random.Random(9)
    rows = [(20 * g + i, f"{text} w{rng.randrange(10**6)}") for g in range(30) for text in [" ".join(f"x{rng.randrange(5000)}" for _ in range(60))] for i in range(20)]
    sc = spark.sparkContext
    sc.setJobGroup("near-copies", "")
    try:
        kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").count()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert 30 <= kept < 300
    assert len(sc.statusTracker().getJobIdsForGroup("near-copies")) <= 42

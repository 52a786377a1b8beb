"""Exact and near duplicates, token files, decontamination, resampling."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import block_names, decontaminate, resampling, simhash, token_codes
from tidemark.llm.common import Scratch
from tidemark.llm.components import components

DOC = "doc_id long, text string, name string, rep long, key string, fp long, level int, part int, id long"


def docs(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "n", 1, "k", 2, 3, 4, 5) for i, t in rows], DOC)


def mixed_texts(seed=0):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(40)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    texts = [None, "", "  \n", "one", "One two", "one two", "\t", long, long, long[:-1], long + "x", " ".join(words), "🙂 ü " * 50]
    for _ in range(120):
        texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))))
    texts += rng.choices(texts, k=150)
    return texts


# Exact duplicates


@pytest.mark.parametrize("block", [3, 64, 4096])
def test_exact_dedup_by_brute_force(spark, block):
    texts = mixed_texts()
    if block == 3:
        texts = [t if t is None or len(t) < 500 else t[:200] for t in texts]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    got = block_names.exact_dedup(docs(spark, rows).repartition(5), Scratch(spark, "t"), block=block).collect()
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = {i: (max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(rows)


def test_exact_dedup_keeps_one_of_repeated_ids(spark):
    got = block_names.exact_dedup(docs(spark, [(5, "a")] * 4 + [(None, "a"), (None, "b"), (3, "b")]), Scratch(spark, "t")).collect()
    assert sum(r["kept"] for r in got if r["keep_id"] == 5) == 1 and len(got) == 7
    assert [(r["doc_id"], r["kept"]) for r in got if r["keep_id"] == 3].count((3, True)) == 1
    assert block_names.exact_dedup(docs(spark, []), Scratch(spark, "t")).count() == 0


# SimHash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 7)
    for t in [None, "", "A", "a b", "A b C", "a b c d " * 20, "é É x y\x0bz\x0cq"] + [t for t in mixed_texts() if t and len(t) < 2000]:
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_print(t)


def test_golay_tables():
    near, far = simhash._code()
    words = np.arange(1 << 12) << 11
    codewords = words ^ simhash._syndrome(words)
    assert (simhash._syndrome(codewords) == 0).all()
    weights = np.bitwise_count(codewords)
    assert weights[1:].min() == 7
    assert (np.bitwise_count(near) <= 3).all() and sorted(set((far > 0).sum(1).tolist())) == [0, 5]


def test_all_pairs_within_three_bits_meet():
    rng = np.random.default_rng(5)
    for d in range(4):
        a = rng.integers(-(2**63), 2**63 - 1, 4000, dtype=np.int64)
        flip = np.zeros(4000, np.uint64)
        for i in range(4000):
            for b in rng.choice(64, d, replace=False):
                flip[i] |= np.uint64(1) << np.uint64(b)
        b = (a.view(np.uint64) ^ flip).view(np.int64)
        for x, y in ((a, b), (b, a)):
            filed, looked = simhash.file_and_lookup(x)[0], simhash.file_and_lookup(y)[1]
            assert (filed[:, :, None] == looked[:, None, :]).any((1, 2)).all()


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_copies(seed=1):
    """A large group of close texts, chains of them, and others."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(400)]
    rows = []
    for _ in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append(" ".join(t))
    return rows + [t for t in mixed_texts(seed) if t is None or len(t) < 3000][:150]


def test_near_duplicates_by_brute_force(spark):
    rows = list(enumerate(near_copies()))
    got = simhash.near_duplicates(docs(spark, rows).repartition(6), Scratch(spark, "t")).collect()
    prints = {i: brute_print(t) for i, t in rows}
    assert {r["doc_id"]: r["fp"] % 2**64 for r in got} == prints
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(prints)
    assert len({r["component_id"] for r in got}) < len(rows) - 40


def test_near_duplicates_edges(spark):
    got = simhash.near_duplicates(docs(spark, [(4, "x"), (4, "x"), (None, "x"), (2, None), (9, "")]), Scratch(spark, "t")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in got) == [(-1, 4), (2, 2), (4, 4), (4, 4), (9, 2)]
    assert simhash.near_duplicates(docs(spark, []), Scratch(spark, "t")).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs(spark, []), Scratch(spark, "t"), max_bits=4)


@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_components_of_paths_and_stars(spark, monkeypatch, one_task):
    monkeypatch.setattr("tidemark.llm.components.ONE_TASK", one_task)
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0
    links = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 30)] + [(7, 7), (300, 200), (200, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 0 for i in range(30)} | {200: 200, 300: 200}


def test_many_links_of_few_nodes_take_few_jobs(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.components.ONE_TASK", 700)
    links = [(100 * g + a, 100 * g + b) for g in range(40) for a in range(16) for b in range(a)]
    sc = spark.sparkContext
    sc.setJobGroup("few-jobs", "")
    try:
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "t")).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == {100 * g + a: 100 * g for g in range(40) for a in range(16)}
    assert len(sc.statusTracker().getJobIdsForGroup("few-jobs")) <= 14


def test_links_are_written_contracted(spark, monkeypatch):
    links = spark.createDataFrame([(100 * g + a, 100 * g + b) for g in range(40) for a in range(16) for b in range(a)], "u long, v long")
    written, save = [], Scratch.save

    def counted(self, df, *rest):
        written.append((out := save(self, df, *rest)).count())
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    got = {r["node"]: r["root"] for r in components(links, Scratch(spark, "t")).collect()}
    assert got == {100 * g + a: 100 * g for g in range(40) for a in range(16)}
    assert max(written) <= 700  # of 4800 links


# Token files


def test_segment_gives_any_token():
    rng = np.random.default_rng(2)
    for width in (8, 16):
        for ids in (np.zeros(0), rng.integers(0, 200, 3000), rng.integers(0, 2**32, 2000, dtype=np.uint64), rng.choice([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1], 1500), np.arange(513)):
            ids = ids.astype(np.uint32)
            s = token_codes.Segment(token_codes.write_segment(ids, [7, None], [0, len(ids) // 2], width))
            assert (s.read() == ids).all() and len(s) == len(ids) and s.documents()[0] == [7, None]
            assert (s.document(1) == ids[len(ids) // 2 :]).all()
            for i in rng.integers(0, max(1, len(ids)), 60).tolist() if len(ids) else []:
                assert s[i] == ids[i]
                assert (s.read(i, i + 77) == ids[i : i + 77]).all()
            with pytest.raises(IndexError):
                s[len(ids)]
    with pytest.raises(ValueError):
        token_codes.Segment(b"not a segment at all")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_codes.tokenizer_file("byte_bpe_50k.json"))


def test_pieces_give_the_library_s_ids(tokenizer):
    rng = random.Random(4)
    signs = "ab1.,!' \n\t\r\x0b\x00éß²ª\xa0 x🙂"
    texts = ["", "<|endoftext|> a", "it's. A,\nb.", "a ,b . c", " . ,", "don't 've 'LL", "a  b\n\n c ", "é. ñ,\nß"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    enc = token_codes.Encoder(token_codes.tokenizer_file("byte_bpe_50k.json"), most=300)
    for at in range(0, len(texts), 1000):
        part = texts[at : at + 1000]
        for t, ids in zip(part, enc.encode_many(pa.array(part)), strict=True):
            assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_files_round_trip(spark, tokenizer):
    rows = [(i * 13 % 997, t) for i, t in enumerate(mixed_texts())] + [(None, "none"), (5000, "twice"), (5000, "twice")]
    scratch = Scratch(spark, "t")
    path = scratch.path()
    token_codes.write_tokens(docs(spark, rows).repartition(3), path, limit=5000)
    got = token_codes.read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    texts, start = dict(rows), 0
    for r in got:
        ids = np.array([*tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    empty = scratch.path()
    token_codes.write_tokens(docs(spark, []), empty)
    assert token_codes.read_tokens(spark, empty).count() == 0
    assert token_codes.TokenFiles(spark, empty).tokens == 0


def test_any_token_is_read_from_storage_by_a_few_bytes(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(token_codes, "FILE_SEGMENTS", 3)
    rows = [(i * 13 % 997, t) for i, t in enumerate(mixed_texts())]
    path = Scratch(spark, "t").path()
    token_codes.write_tokens(docs(spark, rows).repartition(3), path, limit=3000)
    want = np.concatenate([[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t in sorted(rows, key=lambda r: r[0])])
    files = token_codes.TokenFiles(spark, path)
    assert files.tokens == len(want) and len(files.names) > 8
    index = token_codes.token_index(spark, path).collect()
    assert sum(r["n_tokens"] for r in index) == len(want) and max(r["file"] for r in index) > 0
    rng = np.random.default_rng(9)
    places = [0, len(want) - 1, *rng.integers(0, len(want), 60).tolist()]
    assert [files.token(i) for i in places] == want[places].tolist()
    # the head, the directory, and at most three places of each level
    assert files.bytes_read / len(places) < 56 + 16 * 4 + 4 * (2 + 64 + 4) < sum(r["size"] for r in index) / 1000
    for a in rng.integers(0, len(want), 5).tolist():
        assert (files.read(a, a + 4000) == want[a : a + 4000]).all()
    with pytest.raises(IndexError):
        files.token(len(want))


# Decontamination


def bench_items(n=40, seed=3):
    rng = random.Random(seed)
    words = [f"b{i}" for i in range(300)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(14, 50)))) for i in range(n)]


def test_best_stretch_by_brute_force():
    rng = random.Random(6)

    def brute(item, window):
        rows = [list(range(len(item) + 1))]
        best = None
        for a in range(len(window) + 1):
            d = list(range(len(item) + 1))
            for b in range(a, len(window) + 1):
                if b > a:
                    new = [d[0] + 1]
                    for i, w in enumerate(item, 1):
                        new.append(min(d[i] + 1, new[-1] + 1, d[i - 1] + (w != window[b - 1])))
                    d = new
                best = d[-1] if best is None else min(best, d[-1])
        assert rows
        return best

    for _ in range(150):
        item = np.array([rng.randint(0, 3) for _ in range(rng.randint(1, 7))], np.int32)
        window = np.array([rng.randint(0, 4) for _ in range(rng.randint(0, 10))], np.int32)
        want = brute(item.tolist(), window.tolist())
        hit = decontaminate.best_stretch(item, window, 3)
        assert (hit is None) == (want > 3)
        if hit:
            assert hit[0] == want and 0 <= hit[1] <= hit[2] <= len(window)


def test_edited_passages_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(8)
    items = bench_items()
    fill = [f"f{i}" for i in range(400)] + [f"b{i}" for i in range(100)]
    rows, planted = [], set()
    for i in range(400):
        text = [rng.choice(fill) for _ in range(rng.randint(0, 80))]
        if i % 2:
            item, words = rng.choice(items)
            words = words.split()
            for _ in range(rng.randint(0, decontaminate.allowed(len(words)))):
                at, kind = rng.randrange(len(words)), rng.randint(0, 2)
                words[at : at + (kind != 2)] = [] if kind == 1 else [rng.choice(fill)]
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() + rng.choice(["", ",", "."]) for w in words]
            planted.add((i, item))
        rows.append((i, " ".join(text)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminations(docs(spark, rows), benchmark).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(planted & found) >= 0.9 * len(planted)
    assert not {i for i, _ in found} - {i for i, _ in planted}
    for r in got:
        assert r["distance"] <= decontaminate.allowed(r["item_words"]) and r["similarity"] >= 0.8
    kept = decontaminate.decontaminate(docs(spark, rows), benchmark)
    assert kept.columns == docs(spark, []).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in found}


@pytest.mark.parametrize("n", [100, 150, 200, 300, 400])
def test_long_items_edited_to_the_limit_are_found(n):
    rng = random.Random(n)
    vocabulary, fill = [f"b{i}" for i in range(2000)], [f"f{i}" for i in range(400)] + [f"b{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i in range(30)]
    texts, k = [], decontaminate.allowed(n)
    for _, text in items:
        words = text.split()
        for _ in range(k):
            at, kind = rng.randrange(len(words)), rng.randint(0, 2)
            words[at : at + (kind != 2)] = [] if kind == 1 else [rng.choice(fill)]
        texts.append(" ".join([*rng.choices(fill, k=rng.randint(0, 300)), *words, *rng.choices(fill, k=rng.randint(0, 300))]).encode())
    texts += [b"", None, " ".join(rng.choices(fill, k=2000)).encode()]
    found = decontaminate.Index([(i, t.encode()) for i, t in items]).matches(texts)
    assert sum(i in {m[0] for m in found[i]} for i, _ in items) >= 0.95 * len(items)
    assert all({m[0] for m in hits} <= {i} and all(m[2] <= k for m in hits) for i, hits in enumerate(found))


@pytest.mark.parametrize("n", [20, 60, 150, 400])
def test_whole_documents_against_all_windows(n):
    """Every item against every stretch of every document: nothing wrong is found, and at the full distance 0.95 of all."""
    rng = random.Random(n)
    vocabulary = [f"b{i}" for i in range(600)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i in range(12)]
    k, texts = decontaminate.allowed(n), []
    for _ in range(300 if n < 100 else 50):
        words = rng.choice(items)[1].split()
        for _ in range(k + rng.choice((0, 0, 0, 2))):  # some beyond the distance allowed
            at, kind = rng.randrange(len(words)), rng.randint(0, 2)
            words[at : at + (kind != 2)] = [] if kind == 1 else [rng.choice(vocabulary)]
        texts.append(" ".join([*rng.choices(vocabulary, k=rng.randint(0, 120)), *words, *rng.choices(vocabulary, k=rng.randint(0, 120))]).encode())
    index = decontaminate.Index([(i, t.encode()) for i, t in items])
    found = {(d, m[0]): m[2] for d, hits in enumerate(index.matches(texts)) for m in hits}
    every = {}
    for d, t in enumerate(texts):
        code = np.array([index.vocabulary.get(w, 0) for w in decontaminate.words_of(t)], np.int32)
        for x in index.items:
            if hit := decontaminate.best_stretch(x.code, code, k):
                every[d, x.id] = hit[0]
    assert set(found) <= set(every) and all(found[key] >= every[key] for key in found)
    assert len(every) >= 0.7 * len(texts) and len(found) >= 0.95 * len(every)


def test_decontamination_edges(spark, monkeypatch):
    item = bench_items(1)[0][1]
    benchmark = spark.createDataFrame([(0, item), (1, None), (2, ""), (None, item), (3, "... !")], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, item), (3, item), (None, item), (4, "x " * 50_000 + item), (5, item[: len(item) // 2])]
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminations(docs(spark, rows), benchmark).collect()]
    assert sorted(got, key=repr) == sorted([(d, i) for d in (3, 3, None, 4) for i in (0, None)], key=repr)
    assert decontaminate.contaminations(docs(spark, rows), benchmark.limit(0)).count() == 0
    assert decontaminate.contaminations(docs(spark, []), benchmark).count() == 0
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    again = [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminations(docs(spark, rows), benchmark).collect()]
    assert sorted(again, key=repr) == sorted(got, key=repr)


# Importance resampling


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=30_000), np.round(rng.normal(size=25_000), 1), np.full(20_000, 3.0), np.r_[np.full(15_000, 1.0), 1e9, -1e9, np.full(9000, 1.0 + 1e-9)]):
        rows = spark.createDataFrame(list(zip(range(len(values)), map(float, values))), "id long, v double")
        for k in (0, 1, 777, len(values) // 2, len(values)):
            got = resampling.top_k(rows, k, "v", "id", "kept")
            want = {int(i) for i in np.lexsort((np.arange(len(values)), -values))[:k]}
            assert {r["id"] for r in got.filter("kept").collect()} == want


def test_rows_that_tie_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(resampling, "LAST_BIN", 100)
    ids = [None] * 3000 + [7] * 2000 + list(range(100, 400))
    rows = spark.createDataFrame([(i, 1.5, n * 3) for n, i in enumerate(ids)], "id long, v double, row long").repartition(4)
    for k in (1, 1500, 2100, 2301, 5000):
        got = resampling.top_k(rows, k, "v", "id", "kept", "row").filter("kept").collect()
        want = sorted(range(len(ids)), key=lambda n: (ids[n] is None, ids[n] or 0, n))[:k]
        assert sorted(r["row"] for r in got) == sorted(n * 3 for n in want)


def test_importance_weights_by_hand(spark):
    rows = [(1, "good words here"), (2, "good words too"), (3, "junk junk"), (4, None), (5, ""), (None, "junk")]
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (None, 1), (9, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in resampling.importance_sample(docs(spark, rows), labels, Scratch(spark, "t"), keep=0.5).collect()}
    counts = np.zeros((2, resampling.BUCKETS))
    grams = {i: resampling.grams(np.array([zlib.crc32(w) for w in (t or "").encode().split()], np.uint64)) if (t or "").split() else np.zeros(0, int) for i, t in rows}
    for i, g in grams.items():
        counts[1] += np.bincount(g, minlength=resampling.BUCKETS)
        counts[0] += np.bincount(g, minlength=resampling.BUCKETS) * (i in (1, 2))
    p = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * resampling.BUCKETS)
    for i, g in grams.items():
        assert got[i]["log_weight"] == pytest.approx(np.log(p[0][g] / p[1][g]).sum()) and got[i]["n_grams"] == len(g)
    assert sum(r["kept"] for r in got.values()) == 3
    assert got[1]["log_weight"] > 0 > got[3]["log_weight"]
    none = resampling.importance_sample(docs(spark, rows), labels.limit(0), Scratch(spark, "t")).collect()
    assert all(r["log_weight"] == 0 for r in none)
    assert resampling.importance_sample(docs(spark, []), labels, Scratch(spark, "t")).count() == 0


def test_resampling_prefers_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = resampling.op10_importance_resampling(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    share = {r["quality"]: r["k"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.9 > 0.3 > share[0]


def test_walks_shared_by_classes_are_those_of_each_class(monkeypatch):
    rng = random.Random(5)
    words = [b"w%d" % i for i in range(60)]
    index = decontaminate.Index([(i, b" ".join(rng.choices(words, k=n))) for i, n in enumerate([12, 15, 22, 30, 44, 70, 95] * 3)])
    code = np.array([rng.randrange(61) for _ in range(3000)] + [0] * 200, np.int32)
    ends = np.where(np.arange(3200) < 3000, 3000, 0)
    unknown, want = np.concatenate([[0], np.cumsum(code == 0)]), set()
    for c in index.hashed:
        lo, hi, _ = index.classes[c]
        least, k = lo - decontaminate.allowed(lo), decontaminate.allowed(hi)
        starts = np.array([p for p in range(3000 - least + 1) if unknown[p + least] - unknown[p] <= k])
        for r in range(index.rounds):
            at, seen = index.walk(c, r, code, starts, index.walk_hashes(r, 0, index.names[code]))
            for key, item in zip(*index.tables[c][r][:2], strict=True):
                want |= {(int(item), int(p)) for p in at[index.key(seen) == key]}
    hashed, sizes = index.walk_hashes, []
    monkeypatch.setattr(index, "walk_hashes", lambda r, block, raw: sizes.append(len(raw)) or hashed(r, block, raw))
    index.pieces = {}
    assert want
    assert set(index.candidates(code, ends)) == want
    assert max(sizes) == len(index.names)  # the benchmark's words are hashed, not each word of the texts

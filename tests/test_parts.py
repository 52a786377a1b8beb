import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashing, vectors
from tidemark.operators import bloom, cuts, metrics, ml, ring, vector
from tidemark.schema import LOG
from tidemark.sources import files, wal
from tidemark.sources.store import Store
from tidemark.streaming import ingest


def fnv(data: bytes) -> int:
    h = 14695981039346656037
    for b in data:
        h = (h ^ b) * 1099511628211 % 2**64
    return h


def test_fnv_matches_the_published_value(spark):
    keys = [b"", b"a", b"foobar", "é€".encode(), bytes(range(256))]
    rows = spark.createDataFrame([(bytearray(k),) for k in keys], "k binary")
    got = {bytes(r["k"]): int(r["h"]) for r in rows.withColumn("h", hashing.fnv1a64(F.col("k"))).collect()}
    assert got == {k: fnv(k) for k in keys}
    assert got[b"a"] == 0xAF63DC4C8601EC8C == hashing.fnv1a64_py(b"a")


def test_frames(spark):
    rows = spark.createDataFrame([(bytearray(b"mykey"), bytearray(b"myval"), 7, False, 0), (bytearray(b"partition_key"), bytearray(b"partition_val"), -1, True, 1), (bytearray(b""), None, 1, True, 2)], LOG)
    got = {r["seq"]: bytes(r["frame"]) for r in wal.to_frames(rows).collect()}
    payload = struct.pack("<qBII", 7, 0, 5, 5) + b"mykeymyval"
    assert got[0] == struct.pack("<I", zlib.crc32(payload)) + payload
    assert [len(got[i]) for i in range(3)] == [31, 47, 21]
    whole = got[0] + got[1]
    assert [(k, t) for _, k, _, _, t in wal.frames(whole)] == [(b"mykey", False), (b"partition_key", True)]
    assert list(wal.frames(b"junk" + whole[4:])) == []
    assert len(list(wal.frames(whole[:-1]))) == 1


def test_wal_files(spark, tmp_path):
    rows = spark.createDataFrame([(bytearray(b"k1"), bytearray(b"v1"), 10, False, 0), (bytearray(b"k1"), None, 11, True, 1)], LOG)
    (tmp_path / "a.wal").write_bytes(b"".join(bytes(r["frame"]) for r in wal.to_frames(rows).orderBy("seq").collect()) + b"half a frame")
    (tmp_path / "b.wal").write_bytes(b"")
    got = wal.read_wal(spark, str(tmp_path)).orderBy("offset").collect()
    assert [(bytes(r["key"]), r["ts"], r["tombstone"]) for r in got] == [(b"k1", 10, False), (b"k1", 11, True)]


def test_bloom_rates(spark):
    assert hashing.bloom_shape(1000, 0.01) == (9586, 7)
    inside = spark.createDataFrame([(chr(i),) for i in range(1000)], "k string")
    outside = spark.createDataFrame([(chr(i),) for i in range(1000, 2000)], "k string")
    bits = bloom.build(inside, F.col("k").cast("binary"), 1000)
    assert bloom.probe(inside, F.col("k").cast("binary"), bits, 1000).filter("not maybe").count() == 0
    assert bloom.probe(outside, F.col("k").cast("binary"), bits, 1000).filter("maybe").count() <= 50


def test_cosine_cases(spark):
    cases = [([1.0, 0.0], [2.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 3.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0], [1.0, 2.0], 0.0), ([], [], 0.0), ([1.0, 1.0], [-2.0, -2.0], -1.0), (None, [1.0], 0.0)]
    rows = spark.createDataFrame([(a, b, c) for a, b, c in cases], "a array<float>, b array<float>, want double")
    for r in rows.withColumn("got", vectors.cosine(F.col("a"), F.col("b"))).collect():
        assert r["got"] == pytest.approx(r["want"], abs=1e-9)


def test_parse_vector(spark):
    row = spark.sql("select '1, 2.5,x,' as s").select(vectors.parse_vector(F.col("s")).alias("v")).first()
    assert row["v"] == [1.0, 2.5, 0.0, 0.0]
    with pytest.raises(Exception):  # noqa: B017
        spark.sql("select '1,x' as s").select(vectors.parse_vector(F.col("s"), strict=True).alias("v")).collect()


def corpus(spark, rows):
    return spark.createDataFrame([(f"v{i:03d}", [float(x) for x in v]) for i, v in enumerate(rows)], "id string, vector array<float>")


def test_knn_against_numpy(spark):
    rng = np.random.default_rng(0)
    data = np.concatenate([rng.normal(size=(300, 16)) * rng.uniform(0.1, 9, (300, 1)), np.zeros((2, 16)), np.repeat(rng.normal(size=(1, 16)), 5, 0)]).astype(np.float32)
    rows = corpus(spark, data).repartition(5)
    unit = np.float64(data) / np.maximum(np.linalg.norm(np.float64(data), axis=1, keepdims=True), 1e-300)
    queries = [("a", data[3].tolist()), ("b", data[-1].tolist()), ("zero", [0.0] * 16), ("short", [1.0] * 3)]
    got = {}
    for r in vector.knn_batch(rows, queries, 7).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = (r["id"], r["score"])
    for name, q in queries[:2]:
        s = unit @ (np.float64(q) / np.linalg.norm(q))
        want = sorted(range(len(data)), key=lambda i: (-round(s[i], 9), i))[:7]
        assert {got[name][i + 1][0] for i in range(7)} == {f"v{i:03d}" for i in want}
        one = vector.knn(rows, q, 7).collect()
        assert [round(r["score"], 9) for r in one] == [round(s[i], 9) for i in want]
    assert [got["zero"][i + 1][0] for i in range(3)] == ["v000", "v001", "v002"]
    assert got["short"][1][1] == 0.0
    assert vector.knn(rows, data[0].tolist(), 0).count() == 0 and vector.knn_batch(rows, queries, 0).count() == 0
    assert vector.knn(rows.limit(0), data[0].tolist(), 3).count() == 0


def test_vectors_are_versioned_by_arrival(spark):
    rows = spark.createDataFrame([("vec_1", [1.0, 0.0, 0.0], 0), ("vec_1", [0.0, 1.0, 0.0], 1)], "id string, vector array<float>, seq long")
    assert vector.latest_vectors(rows).first()["vector"] == [0.0, 1.0, 0.0]


def test_shards_with_replicas_give_each_row_once(spark):
    rows = corpus(spark, np.eye(6))
    got = vector.knn_sharded([rows, rows, rows.limit(2)], [1.0, 0.5, 0.2, 0.0, 0.0, 0.0], 3).collect()
    assert [r["id"] for r in got] == ["v000", "v001", "v002"]


def brute_owners(nodes, vnodes, key, count):
    tokens = sorted((fnv(f"{n}#{i}".encode()), n) for n in nodes for i in range(vnodes))
    at = next((i for i, (t, _) in enumerate(tokens) if t >= fnv(key)), 0)
    out = []
    for i in range(len(tokens)):
        n = tokens[(at + i) % len(tokens)][1]
        if n not in out:
            out.append(n)
    return out[:count]


def test_ring_against_brute_force(spark):
    nodes = ["nodeA", "nodeB", "nodeC", "nodeB"]
    keys = [f"key{i}" for i in range(200)] + ["", "x" * 50]
    rows = spark.createDataFrame([(k,) for k in keys], "key string")
    r = ring.HashRing(nodes, 8)
    got = {x["key"]: x["owners"] for x in ring.replicas(rows, F.col("key").cast("binary"), r, 2).collect()}
    assert got == {k: brute_owners({"nodeA", "nodeB", "nodeC"}, 8, k.encode(), 2) for k in keys}
    assert all(len(o) == 3 for o in (x["owners"] for x in ring.replicas(rows, F.col("key").cast("binary"), r, 9).collect()))
    moved = {x["key"] for x in ring.remap(rows, F.col("key").cast("binary"), r, r.without("nodeA")).collect()}
    assert moved == {k for k in keys if brute_owners({"nodeA", "nodeB", "nodeC"}, 8, k.encode(), 1) == ["nodeA"]}
    assert sum(x["n_keys"] for x in ring.balance(rows, F.col("key").cast("binary"), r).collect()) == len(keys)
    with pytest.raises(ValueError):
        ring.HashRing([]).owners(1, 1)


def test_percentiles_by_brute_force(spark):
    rng = np.random.default_rng(1)
    data = {"a": rng.exponential(5, 3000), "b": np.full(50, 7.0), "c": rng.normal(size=3), "d": np.array([-1.0, 0.0, 0.0, 1e9])}
    rows = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [("e", None)], "op string, latency_ms double")
    got = {r["op"]: (r["p50"], r["p95"], r["p99"]) for r in metrics.floor_percentiles(rows).collect()}
    for k, v in data.items():
        s = np.sort(v)
        assert got[k] == tuple(s[int(len(s) * q)] for q in (0.5, 0.95, 0.99))
    assert got["e"] == (0.0, 0.0, 0.0)


def kv_rows(spark, rows):
    return spark.createDataFrame([(k, v, ts) for k, v, ts in rows], "key string, value string, ts long")


def values(df):
    return {bytes(r["key"]).decode(): (None if r["value"] is None else bytes(r["value"]).decode(), r["ts"], r["tombstone"]) for r in df.collect()}


def test_store(spark):
    store = Store(spark, files.fresh_folder(spark, "t"))
    assert store.view().count() == 0
    store.put_batch(kv_rows(spark, [("k1", "v1", 1), ("k2", "v2", 2)]))
    store.put_batch(kv_rows(spark, [("k1", "late", 0), ("k3", "v3", 3)]))
    store.put_batch(kv_rows(spark, [("k3", "tie", 3)]))
    store.delete(spark.createDataFrame([("k2",)], "key string"), ts=9)
    want = {"k1": ("v1", 1, False), "k2": (None, 9, True), "k3": ("v3", 3, False)}
    assert values(store.view()) == want
    old = store.log()
    store.compact()
    assert values(store.view()) == want and len(store.manifest()["runs"]) == 1
    assert old.count() == 6 and len(store.manifest()["retired"]) == 4  # readers of the manifest before go on
    store.compact(keep_s=0)
    assert values(store.view()) == want and not store.manifest()["retired"]
    store.put_batch(kv_rows(spark, [("k3", "tie again", 3), ("k2", "back", 10)]))
    again = Store(spark, store.path)
    assert values(again.view()) == want | {"k2": ("back", 10, False)}
    got = {bytes(r["key"]).decode(): r["outcome"] for r in again.get(spark.createDataFrame([("k1",), ("zz",)], "key string")).collect()}
    assert got == {"k1": "live", "zz": "absent"}
    peer = Store(spark, files.fresh_folder(spark, "p"))
    peer.sync_from(again, since=3)
    assert set(values(peer.view())) == {"k2", "k3"}
    copy = files.fresh_folder(spark, "b")
    again.backup(copy)
    assert spark.read.parquet(copy).count() == again.log().count()
    assert again.status().first()["alive"]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_predicates_and_columns_reach_the_scan(spark):
    store = Store(spark, files.fresh_folder(spark, "t"))
    for i in range(3):
        store.put_batch(kv_rows(spark, [("k1", f"v{i}", i), (f"k{i + 2}", "x", 10 * i)]))
    got = plan(store.scan_since(10))
    assert "GreaterThanOrEqual(ts,10)" in got and "vector" not in got.split("ReadSchema")[1].split("\n")[0]
    assert values(store.scan_since(10)) == {"k3": ("x", 10, False), "k4": ("x", 20, False)}
    keys = plan(store.log().filter(F.col("ts") >= 10).select("key"))
    assert "value" not in keys.split("ReadSchema")[1].split("\n")[0]
    assert "EqualTo(key" in plan(store.log().filter(F.col("key") == F.lit(b"k1")))


def test_top_k_is_two_phased(spark):
    rows = corpus(spark, np.eye(4))
    assert "TakeOrderedAndProject" in plan(vector.knn(rows, [1.0, 0, 0, 0], 2))
    assert "WindowGroupLimit" in plan(vector.knn_batch(rows, [("q", [1.0, 0, 0, 0])], 2))


def test_store_search_survives_compaction(spark):
    store = Store(spark, files.fresh_folder(spark, "v"))
    put = lambda rows: store.put_batch(spark.createDataFrame(rows, "key string, value string, ts long, vector array<float>"))
    put([("key1", "a", 1, [1.0, 2.0, 3.0]), ("key2", "b", 1, [-1.0, 0.0, 0.0])])
    put([("key1", "older time, later arrival", 0, [3.0, 2.0, 1.0]), ("key2", "no vector", 2, None)])
    store.delete(spark.createDataFrame([("key2",)], "key string"), ts=5)
    for _ in range(2):
        assert [r["id"] for r in store.search([3.0, 2.0, 1.0], 1).collect()] == ["key1"]
        assert store.search([3.0, 2.0, 1.0], 1).first()["score"] == pytest.approx(1.0)
        assert {r["id"] for r in store.search([1.0, 0.0, 0.0], 5).collect()} == {"key1"}
        assert {r["id"] for r in store.search([1.0, 0.0, 0.0], 5, live_only=False).collect()} == {"key1", "key2"}
        store.compact()


def test_arrival_order_holds_for_batches_of_many_partitions(spark):
    names = spark.range(400).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(1).cast("long").alias("ts"))
    first = names.withColumn("value", F.lit("first")).withColumn("vector", F.array(F.lit(1.0), F.lit(0.0))).repartition(200, "key")
    second = names.withColumn("value", F.lit("second")).withColumn("vector", F.array(F.lit(0.0), F.lit(1.0))).repartition(200, F.reverse("key"))
    store, peer = (Store(spark, files.fresh_folder(spark, x)) for x in ("many", "peer"))
    store.put_batch(first)
    store.put_batch(second)
    peer.put_batch(first.withColumn("ts", F.lit(0).cast("long")))
    peer.sync_from(store)

    def check(s):
        assert {bytes(r["value"]) for r in s.view().collect()} == {b"first"}  # of equal times the first arrival
        assert {round(r["score"], 6) for r in s.search([0.0, 1.0], 400).collect()} == {1.0}  # the last arrival's vector

    check(store)
    check(peer)
    store.compact()
    check(store)
    store.put_batch(first)
    assert {round(r["score"], 6) for r in store.search([1.0, 0.0], 400).collect()} == {1.0}
    assert store.view().count() == 400 and store.scan_since(1, vectors=True).filter("size(vector) > 0").count() == 400


def brute_cuts(rows, start, step):
    out, state = [], {}
    for unit, order, x in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        state[unit], made = step(state.get(unit, start), 0 if x is None else x, x)
        out.append((unit, order, *made))
    return sorted(out, key=str)


def test_cuts_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(u, i, None if rng.random() < 0.1 else int(rng.integers(0, 90))) for u in ("a", "b", None) for i in range(700)] + [("c", 0, None), ("d", 0, 5000)]
    for cast in ("string", "int"):
        made = [((None if u is None else ord(u) % 7) if cast == "int" else u, i, x) for u, i, x in rows]
        df = spark.createDataFrame(made, f"unit {cast}, seq long, size int").repartition(5)

        def index(s, x, _):
            cut = s[1] is None or s[0] - s[1] >= 100
            return (s[0] + x, s[0] if cut else s[1]), (s[0], cut)

        def flush(s, x, _):
            s = (0, s[1] + 1) if s[0] >= 300 else s
            return (s[0] + x, s[1]), (s[1],)

        def group(s, x, known):
            n, first, g = s
            if n and (n >= 7 or (first is not None and known is not None and x - first >= 40)):
                n, first, g = 0, None, g + 1
            return (n + 1, known if first is None else first, g), (g,)

        got = sorted((tuple(r) for r in cuts.sparse_index(df, "unit", "seq", "size", 100).collect()), key=str)
        assert got == [r[:3] for r in brute_cuts(made, (0, None), index) if r[3]]
        got = sorted((tuple(r[c] for c in ("unit", "seq", "segment")) for r in cuts.flush_cuts(df, "unit", "seq", "size", 300).collect()), key=str)
        assert got == brute_cuts(made, (0, 0), flush)
        got = sorted((tuple(r[c] for c in ("unit", "seq", "commit_group")) for r in cuts.commit_groups(df, "unit", "seq", "size", 7, 40).collect()), key=str)
        assert got == brute_cuts(made, (0, None, 0), group)
    assert cuts.flush_cuts(df.limit(0), "unit", "seq", "size", 5).count() == 0


def test_stream_equals_batch(spark):
    rows = [(bytearray(f"k{i % 7}".encode()), bytearray(str(i).encode()), (i * 37) % 50, i % 11 == 0, i) for i in range(200)]
    log = spark.createDataFrame(rows, LOG)
    source, out, state = (files.fresh_folder(spark, x) for x in ("s", "o", "c"))
    log.repartition(6).write.parquet(source)
    stream = lambda: spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
    from tidemark.operators.lww import latest

    ingest.ingest_log(stream(), out, state).awaitTermination()
    assert values(latest(ingest.read_log(spark, out, LOG))) == values(latest(log))
    # started again, the stream goes on where it was
    ingest.ingest_log(stream(), out, state).awaitTermination()
    assert ingest.read_log(spark, out, LOG).count() == 200


def test_schema_registry(spark):
    registry = ml.register_schema(ml.empty_registry(spark), "v1", ["age", "click_rate"])
    assert ml.get_schema(registry, "v1") == ["age", "click_rate"]
    with pytest.raises(ml.UnknownSchema):
        ml.get_schema(registry, "v9")


def test_classifier(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    rows = spark.createDataFrame([([float(v) for v in r], int(r[0] + r[1] > 0)) for r in x], "features array<double>, label int")
    model = ml.train(rows)
    assert ml.accuracy(ml.predict(model, rows)).first()[0] > 0.9
    miss = spark.createDataFrame([(None, 0)], "features array<double>, label int")
    assert ml.predict(model, miss).first()["prediction"] is None


def test_classifier_against_newton_steps(spark):
    """Predictions of the registered query's classifier against a plain penalised fit."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 5)) * [1, 2, 0.5, 1, 3]
    y = (x @ [1, -0.5, 2, 0, 0.1] + rng.logistic(size=300) > 0).astype(float)
    rows = spark.createDataFrame([(r.tolist(), int(v)) for r, v in zip(x, y)], "features array<double>, label int")
    got = ml.predict(ml.train(rows), rows).collect()
    scale, w = x.std(0, ddof=1), np.zeros(6)
    z = np.hstack([x / scale, np.ones((300, 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        penalty = np.array([0.01] * 5 + [0])
        w -= np.linalg.solve((z.T * (p * (1 - p))) @ z / 300 + np.diag(penalty), z.T @ (p - y) / 300 + penalty * w)
    p = 1 / (1 + np.exp(-z @ w))
    assert [r["prediction"] for r in got] == [int(v > 0.5) for v in p]
    assert [r["probability"] for r in got] == pytest.approx(np.maximum(p, 1 - p), abs=1e-3)


def test_features_as_json(spark):
    rows = spark.createDataFrame([([1.0, -2.5, 1e-7],), ([],), (None,)], "f array<double>").withColumn("v", ml.feature_value(F.col("f")))
    got = [(bytes(r["v"]) if r["v"] is not None else None, r["b"]) for r in rows.withColumn("b", ml.features_of(F.col("v"))).collect()]
    assert got == [(b"[1.0,-2.5,1.0E-7]", [1.0, -2.5, 1e-7]), (b"[]", []), (None, None)]


def test_flushed_runs_are_sorted_by_key(spark, tmp_path):
    store = Store(spark, str(tmp_path / "sorted"))
    store.put_batch(kv_rows(spark, [(f"k{i * 37 % 101:03}", f"v{i}", 1) for i in range(202)]))
    parts = [[bytes(r["key"]) for r in spark.read.parquet(str(f)).collect()] for f in (tmp_path / "sorted").rglob("part-*.parquet")]
    assert sum(map(len, parts)) == 202 and all(p == sorted(p) for p in parts)
    assert {bytes(r["key"]): bytes(r["value"]) for r in store.view().collect()} == {f"k{i * 37 % 101:03}".encode(): f"v{i}".encode() for i in range(101)}

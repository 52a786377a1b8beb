import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, ml
from tidemark.sources import client, features, files
from tidemark.sources.cluster import Cluster


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "key string, value string")


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def got(df):
    return {bytes(r["key"]).decode(): (bytes(r["value"]).decode() if r["value"] is not None else None, r["quorum"], r["found"], r["tombstone"]) for r in df.collect()}


def test_quorum_writes_hints_and_recovery(spark):
    c = Cluster(spark, files.fresh_folder(spark, "cluster"), ["A", "B", "C"])
    c.down = {"B", "C"}
    assert not c.put_batch(rows(spark, ("k", "v0")), ts=1).first()["committed"]
    c.down = {"C"}
    ack = c.put_batch(rows(spark, ("k", "v1"), ("x", "1")), ts=2)
    assert all(r["committed"] and r["n_ok"] == 2 for r in ack.collect())
    assert got(c.get(keys(spark, "k", "x", "none")))["k"] == ("v1", True, True, False)
    assert got(c.get(keys(spark, "none")))["none"] == (None, True, False, None)
    c.down = set()
    c.replay_hints("C")
    c.down = {"A", "B"}
    lone = got(c.get(keys(spark, "k"), repair=False))["k"]
    assert lone[1] is False and lone[0] is None
    c.r = 1
    assert got(c.get(keys(spark, "k"), repair=False))["k"][0] == "v1"
    with pytest.raises(ValueError):
        c.replay_hints("A")


def test_read_repair_and_deletes(spark):
    c = Cluster(spark, files.fresh_folder(spark, "cluster"), ["A", "B", "C"])
    c.put_batch(rows(spark, ("k", "old")), ts=100)
    c.down = {"A"}
    c.put_batch(rows(spark, ("k", "new")), ts=200)
    c.down, c.hints["A"] = set(), type(c.hints["A"])(spark, files.fresh_folder(spark, "lost"))
    assert got(c.get(keys(spark, "k")))["k"][0] == "new"
    c.down, c.r = {"B", "C"}, 1
    assert got(c.get(keys(spark, "k")))["k"][0] == "new"  # A was repaired
    c.down = set()
    c.delete(keys(spark, "k"), ts=300)
    assert got(c.get(keys(spark, "k")))["k"][2:] == (True, True)


def test_vectors_come_back_by_hints_and_repair(spark):
    c = Cluster(spark, files.fresh_folder(spark, "cluster"), ["A", "B", "C"])
    put = lambda v, ts: c.put_batch(spark.createDataFrame([("k", "v", v)], "key string, value string, vector array<float>"), ts)
    put([1.0, 0.0], 1)
    c.down = {"A"}
    put([0.0, 1.0], 2)
    put([1.0, 1.0], 3)
    near = lambda node, v: c.stores[node].search(v, 1).first()["score"]
    c.down = set()
    assert near("A", [1.0, 0.0]) == pytest.approx(1)
    c.get(keys(spark, "k"))
    assert near("A", [1.0, 1.0]) == pytest.approx(1)
    c.replay_hints("A")
    assert near("A", [1.0, 1.0]) == pytest.approx(1) and near("B", [1.0, 1.0]) == pytest.approx(1)


def test_reads_resolve_the_first_answers(spark):
    c = Cluster(spark, files.fresh_folder(spark, "cluster"), ["A", "B", "C"], w=1, r=2)
    c.put_batch(rows(spark, ("k", "old")), ts=1)
    c.down = {"A", "B"}
    c.put_batch(rows(spark, ("k", "new")), ts=2)
    c.down = set()
    first = c.get(keys(spark, "k"), repair=False).first()
    assert bytes(first["value"]) == b"old" and first["n_ok"] == 2  # C answers third
    c.get(keys(spark, "k"))
    assert got(c.get(keys(spark, "k"), repair=False))["k"][0] == "new"


def test_partition_of_five(spark):
    c = Cluster(spark, files.fresh_folder(spark, "cluster"), list("ABCDE"), n=5, w=3, r=3)
    c.down = {"A", "B", "C"}
    assert not c.put_batch(rows(spark, ("k", "minority")), ts=1).first()["committed"]
    c.down = {"D", "E"}
    assert c.put_batch(rows(spark, ("k", "majority")), ts=2).first()["committed"]
    c.down = set()
    for n in "ABCDE":
        c.replay_hints(n)
    c.down, c.r = {"A", "B", "C"}, 2
    assert got(c.get(keys(spark, "k"), repair=False))["k"][0] == "majority"


def test_scatter_gather(spark):
    c = Cluster(spark, files.fresh_folder(spark, "cluster"), ["A", "B", "C"], n=2)
    vecs = spark.createDataFrame([(f"v{i}", "x", [float(j == i) + 0.1 for j in range(6)]) for i in range(6)], "key string, value string, vector array<float>")
    c.put_batch(vecs, ts=1)
    found = [r["id"] for r in c.search([1.0, 0.5, 0, 0, 0, 0], 2).collect()]
    assert found == ["v0", "v1"]


def test_client_and_command_line(spark, capsys):
    path = files.fresh_folder(spark, "cli")
    c = client.Client(spark, path)
    c.put("a", "1", [1.0, 0.0])
    assert c.stream_put(({"key": f"s{i}", "value": str(i), "vector": [0.0, 1.0]} for i in range(5)), batch=2) == 5
    assert c.get("a") == b"1" and c.get("s4") == b"4" and c.get("zz") is None
    assert c.search([1.0, 0.0], 1)[0]["key"] == b"a"
    run = lambda *x: client.main(["--store", path, *x], spark)
    assert run("put", "b", "two", "--vector", "1,1") == 0 and run("get", "b") == 0 and run("delete", "b") == 0 and run("get", "b") == 1
    assert run("compact") == 0 and run("search", "0,oops", "-k", "2") == 0 and run("status") == 0
    out = capsys.readouterr().out
    assert "two" in out and "not found" in out and "'alive': True" in out


def test_generated_features(spark):
    df = features.feature_rows(spark, 50, 16)
    v = np.array([r["vector"] for r in df.collect()])
    assert v.shape == (50, 16) and v.min() >= -1 and v.max() < 1 and len(np.unique(v)) > 700
    assert df.first() == features.feature_rows(spark, 50, 16).first()


def test_versions_registry_and_network(spark, tmp_path):
    registry = ml.register_schema(ml.empty_registry(spark), "v1", ["a", "b"])
    ml.save_registry(registry, str(tmp_path / "r"))
    again = ml.load_registry(spark, str(tmp_path / "r"))
    assert ml.get_schema(again, "v1") == ["a", "b"]
    x = np.random.default_rng(0).normal(size=(200, 2))
    model = ml.train(spark.createDataFrame([([float(a), float(b)], int(a > 0)) for a, b in x], "features array<double>, label int"))
    log = spark.createDataFrame([("u", "[2.0, 0.0]", 1, False, 0), ("d", None, 2, True, 1)], "key string, value string, ts long, tombstone boolean, seq long")
    out = {r["key"]: (r["status"], r["prediction"]) for r in ml.predict_versioned(model, keys(spark, "u", "d", "n"), log, again, "v1").collect()}
    assert out == {"u": (200, 1), "d": (404, None), "n": (404, None)}
    with pytest.raises(ml.UnknownSchema):
        ml.predict_versioned(model, keys(spark, "u"), log, again, "v2")
    w = [([[1.0, -1.0], [0.0, 1.0]], [0.0, 0.5]), ([[1.0], [2.0]], [-1.0])]
    got = ml.mlp_forward(spark.createDataFrame([([1.0, 2.0],), ([-1.0, 0.0],)], "features array<double>"), w).collect()
    want = [1 / (1 + np.exp(-(max(0, a) + 2 * max(0, -a + b + 0.5) - 1))) for a, b in ((1.0, 2.0), (-1.0, 0.0))]
    assert [r["score"] for r in got] == pytest.approx(want)


def test_gauges(spark):
    ops = spark.createDataFrame([("a", float(i), i == 3) for i in range(100)], "op string, latency_ms double, error boolean")
    assert metrics.exposition(ops) == "ops_total 100\nops_errors 1\nlatency_ms_p50 50\nlatency_ms_p95 95\nlatency_ms_p99 99\n"
    assert metrics.exposition(ops.filter(F.lit(False))) == "ops_total 0\nops_errors 0\nlatency_ms_p50 0\nlatency_ms_p95 0\nlatency_ms_p99 0\n"

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cuts, lww, quorum, scan

LOG = "key string, value string, ts long, tombstone boolean, seq long"


def log(spark, rows):
    return spark.createDataFrame([(k, v, ts, v is None, i) for i, (k, v, ts) in enumerate(rows)], LOG)


def view(df):
    return {r["key"]: (r["value"], r["ts"], r["tombstone"]) for r in df.collect()}


def test_later_time_wins_and_delete_is_a_version(spark):
    rows = log(spark, [("key1", "val1", 100), ("key3", "val3", 102), ("key2", "val2", 101), ("key2", None, 103)])
    assert view(lww.latest(rows)) == {"key1": ("val1", 100, False), "key2": (None, 103, True), "key3": ("val3", 102, False)}
    assert set(view(lww.live(rows))) == {"key1", "key3"}
    assert set(view(lww.tombstones(rows))) == {"key2"}


def test_equal_times_go_to_the_first_arrival(spark):
    assert view(lww.latest(log(spark, [("k", "a", 5), ("k", "b", 5)])))["k"][0] == "a"
    assert view(lww.latest_ranked(log(spark, [("k", "a", 5), ("k", "b", 5)])))["k"][0] == "a"
    # a delete at the same time as the put before it does not take effect
    assert view(lww.latest(log(spark, [("k", "a", 5), ("k", None, 5)])))["k"] == ("a", 5, False)


def test_older_times_lose_whenever_they_arrive(spark):
    rows = log(spark, [("k", "new", 9), ("k", "old", 3), ("d", None, 9), ("d", "older put", 3), ("r", None, 3), ("r", "again", 9)])
    got = view(lww.latest(rows))
    assert got["k"][0] == "new" and got["d"][2] and got["r"] == ("again", 9, False)


def test_tombstones_are_filtered_after_the_fold(spark):
    rows = log(spark, [("k", "a", 1), ("k", None, 2)])
    assert view(lww.live(rows)) == {}


def test_order_of_rows_does_not_matter(spark):
    rng = random.Random(1)
    rows = [(f"k{rng.randint(0, 5)}", rng.choice(["a", "b", None]), rng.randint(0, 9), i) for i in range(200)]
    make = lambda r: spark.createDataFrame([(k, v, ts, v is None, s) for k, v, ts, s in r], LOG)
    want = view(lww.latest(make(rows)))
    for _ in range(3):
        rng.shuffle(rows)
        assert view(lww.latest(make(rows))) == want == view(lww.latest_ranked(make(rows)))


def test_lookup_has_three_outcomes(spark):
    rows = log(spark, [("a", "1", 1), ("b", "1", 1), ("b", None, 2), ("", "", 3)])
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("a",), ("",)], "key string")
    got = sorted((r["key"], r["outcome"], r["value"]) for r in lww.lookup(rows, asked).collect())
    assert got == [("", "live", ""), ("a", "live", "1"), ("a", "live", "1"), ("b", "deleted", None), ("c", "absent", None)]


def test_compaction_changes_nothing_and_is_idempotent(spark):
    rng = random.Random(2)
    rows = log(spark, [(f"k{rng.randint(0, 9)}", rng.choice(["a", None]), rng.randint(0, 20)) for _ in range(300)]).withColumn("layer", F.col("seq") % 4)
    once = lww.compact(rows)
    assert view(once) == view(lww.latest(rows.drop("layer")))
    assert view(lww.compact(once.withColumn("layer", F.lit(0)))) == view(once)


def test_layered_get_ignores_time(spark):
    rows = log(spark, [("k", "newer", 9), ("k", "late", 3)]).withColumn("layer", F.col("seq"))
    assert lww.layered_get(rows).first()["value"] == "late"
    assert lww.latest(rows).first()["value"] == "newer"


def test_scans(spark):
    rows = log(spark, [("a", "1", 1), ("a", "2", 5), ("b", "1", 7)])
    assert {r["ts"] for r in scan.scan_since(rows, 5).collect()} == {5, 7}
    keys = scan.scan_since_keys([rows, rows], 5)
    assert sorted(r[0] for r in keys.collect()) == ["a", "a", "b", "b"]
    assert sorted(r[0] for r in scan.scan_since_keys([rows, rows], 5, dedupe=True).collect()) == ["a", "b"]
    stats = scan.run_stats(rows.withColumn("layer", F.lit(0))).first()
    assert (stats["n_rows"], stats["min_ts"], stats["max_ts"], stats["n_bytes"]) == (3, 1, 7, 3 * 19)


def test_valid_prefix(spark):
    rows = spark.createDataFrame([(i, i not in (3, 5)) for i in range(8)], "seq long, valid boolean")
    assert sorted(r["seq"] for r in scan.valid_prefix(rows).collect()) == [0, 1, 2]
    assert scan.valid_prefix(rows.withColumn("valid", F.lit(True))).count() == 8
    assert scan.valid_prefix(rows.withColumn("valid", F.lit(False))).count() == 0


def greedy(sizes, limit):
    out, held, segment = [], 0, 0
    for s in sizes:
        if held >= limit:
            held, segment = 0, segment + 1
        out.append(segment)
        held += s
    return out


def test_flush_cuts_by_brute_force(spark):
    rng = random.Random(3)
    sizes = [rng.randint(1, 900) for _ in range(500)]
    rows = spark.createDataFrame([(u, i, s) for u in ("x", "y") for i, s in enumerate(sizes if u == "x" else sizes[::-1])], "unit string, seq long, size long")
    got = cuts.flush_cuts(rows, "unit", "seq", "size", 4096).orderBy("unit", "seq").collect()
    assert [r["segment"] for r in got] == greedy(sizes, 4096) + greedy(sizes[::-1], 4096)


def test_commit_groups(spark):
    times = [0, 1, 2, 20, 21, 40, 41, 42, 43, 44]
    rows = spark.createDataFrame([(0, i, t) for i, t in enumerate(times)], "unit long, seq long, ts long")
    got = cuts.commit_groups(rows, "unit", "seq", "ts", most=3, wait_ns=10).orderBy("seq").collect()
    assert [r["commit_group"] for r in got] == [0, 0, 0, 1, 1, 2, 2, 2, 3, 3]
    assert cuts.commit_groups(rows.limit(0), "unit", "seq", "ts").count() == 0


def answers(spark, rows):
    return spark.createDataFrame(rows, "key string, node string, value string, ts long, tombstone boolean, found boolean, ok boolean, resp_order int")


def test_quorum_write_and_hints(spark):
    acks = spark.createDataFrame([(1, "A", True), (1, "B", False), (1, "C", False), (2, "A", True), (2, "B", True), (2, "C", False)], "seq long, node string, ok boolean")
    assert {r["seq"]: r["committed"] for r in quorum.write_outcome(acks, ["seq"], 2).collect()} == {1: False, 2: True}
    assert quorum.hints_of(acks).count() == 3


def test_quorum_read_resolves_the_newest(spark):
    rows = answers(spark, [("k", "A", "val1", 100, False, True, True, 0), ("k", "B", "val2", 200, False, True, True, 1), ("k", "C", "val2", 200, False, True, True, 2)])
    got = quorum.read_resolve(rows, 2).first()
    assert got["quorum"] and got["value"] == "val2"
    lone = quorum.read_resolve(rows.withColumn("ok", F.col("node") == "A"), 2).first()
    assert not lone["quorum"] and lone["value"] is None and lone["n_ok"] == 1


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_stale_replicas_do_not_depend_on_arrival(spark, order):
    a, b, c = order
    rows = answers(spark, [("k", "A", "old", 100, False, True, True, a), ("k", "B", "new", 200, False, True, True, b), ("k", "C", None, 0, False, False, True, c)])
    assert sorted(r["node"] for r in quorum.stale_replicas(rows).collect()) == ["A", "C"]
    repair = {r["node"]: r["value"] for r in quorum.read_repair(rows).collect()}
    assert repair == {"A": "new", "C": "new"}


def test_repair_and_hints_keep_tombstones(spark):
    rows = answers(spark, [("k", "A", "v", 1, False, True, True, 0), ("k", "B", None, 2, True, True, True, 1)])
    assert quorum.read_repair(rows).first()["tombstone"]
    store = spark.createDataFrame([("A", "k", "v", 1, False, 0)], "node string, key string, value string, ts long, tombstone boolean, seq long")
    hints = spark.createDataFrame([("A", "k", None, 2, True, 1), ("Z", "k", "x", 3, False, 2)], "target string, key string, value string, ts long, tombstone boolean, seq long")
    up = spark.createDataFrame([("A",)], "node string")
    once = quorum.replay_hints(hints, up, store)
    assert [(r["node"], r["tombstone"]) for r in once.collect()] == [("A", True)]
    assert quorum.replay_hints(hints, up, once.select(*store.columns)).count() == 1


def test_failure_detector(spark):
    beats = [True, False, False, False, False, True, False, True]
    rows = spark.createDataFrame([("n", i, ok) for i, ok in enumerate(beats)], "node string, tick long, ok boolean")
    got = quorum.failure_detector(rows, 3).orderBy("tick").collect()
    assert [r["misses"] for r in got] == [0, 1, 2, 3, 4, 0, 1, 0]
    assert [r["state"] for r in got] == ["ALIVE", "ALIVE", "ALIVE", "DEAD", "DEAD", "ALIVE", "ALIVE", "ALIVE"]
    assert [r["tick"] for r in got if r["recovered"]] == [5]


def test_sync_converges(spark):
    a, b = log(spark, [("x", "1", 1), ("y", "1", 5)]), log(spark, [("x", "2", 2), ("z", None, 3)])
    got = {r["key"]: r["side"] for r in quorum.sync_diff(a, b).collect()}
    assert got == {"x": "remote", "y": "local", "z": "remote"}
    assert view(quorum.anti_entropy(a, b)) == {"x": ("2", 2, False), "y": ("1", 5, False), "z": (None, 3, True)}
    assert "x" not in {k for k, v in view(quorum.anti_entropy(a, b, since=3)).items() if v[1] == 2}

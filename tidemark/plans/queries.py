"""The registered queries of the core library and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a64
from ..functions.vectors import cosine, parse_vector
from ..operators import bloom, cuts, lww, metrics, ml, quorum, ring, scan, vector
from ..schema import LOG, RECORD
from ..sources import files, wal
from ..sources.store import Store
from ..streaming import detector, ingest
from .fixtures import ANSWERS_SQL, KV_SQL, answers, kv, nanos, table, vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Fixed values of the queries: a time in the middle of the events, the ring, the search.
SINCE = 1_705_708_800_000_000_000
NODES, VNODES, COPIES = ["n1", "n2", "n3"], 3, 2
K = 10
LATEST_SQL = KV_SQL + ", latest AS (SELECT key, value, ts, tombstone, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq) AS n FROM kv) WHERE n = 1)"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# Views


@query(f"WITH {KV_SQL} SELECT key, arg_max(value, {{'a': ts, 'b': -seq}}) AS value, max(ts) AS ts, arg_max(tombstone, {{'a': ts, 'b': -seq}}) AS tombstone FROM kv GROUP BY key")
def kv_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lww.latest(kv(spark, sf_dir)).drop("seq")


@query(f"WITH {LATEST_SQL} SELECT key, value, ts, tombstone, seq FROM latest")
def kv_latest_window(spark, sf_dir):
    return lww.latest_ranked(kv(spark, sf_dir))


@query(f"WITH {LATEST_SQL} SELECT key, value, ts FROM latest WHERE NOT tombstone")
def kv_live(spark, sf_dir):
    return lww.live(kv(spark, sf_dir)).select("key", "value", "ts")


@query(f"WITH {LATEST_SQL} SELECT key, ts FROM latest WHERE tombstone")
def kv_tombstones(spark, sf_dir):
    return lww.tombstones(kv(spark, sf_dir)).select("key", "ts")


@query(f"WITH {LATEST_SQL} SELECT 'user_7' AS key, CASE WHEN ts IS NULL THEN 'absent' WHEN tombstone THEN 'deleted' ELSE 'live' END AS outcome, CASE WHEN NOT tombstone THEN value END AS value, ts FROM (SELECT 1) LEFT JOIN latest ON key = 'user_7'")
def kv_get(spark, sf_dir):
    return lww.lookup(kv(spark, sf_dir), spark.createDataFrame([("user_7",)], "key string"))


@query(f"WITH {LATEST_SQL} SELECT 'user_' || c_custkey AS key, CASE WHEN ts IS NULL THEN 'absent' WHEN tombstone THEN 'deleted' ELSE 'live' END AS outcome, CASE WHEN NOT tombstone THEN value END AS value, ts FROM customer LEFT JOIN latest ON key = 'user_' || c_custkey")
def kv_multi_get(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.concat(F.lit("user_"), F.col("c_custkey").cast("string")).alias("key"))
    return lww.lookup(kv(spark, sf_dir), keys)


@query(
    f"""WITH {KV_SQL}, rows AS (SELECT key, value, ts, tombstone, seq FROM kv UNION ALL
      SELECT key, 'batch', ts + seq % 2, false, seq + 1000000000000 FROM kv WHERE event_type = 'purchase')
    SELECT key, value, ts, tombstone FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq) AS n FROM rows) WHERE n = 1"""
)
def kv_put_batch_lww(spark, sf_dir):
    """A batch of later arrivals with equal or newer times: equal ones lose."""
    log = kv(spark, sf_dir)
    bought = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("seq"))
    batch = log.join(bought, "seq").select("key", F.lit("batch").alias("value"), (F.col("ts") + F.col("seq") % 2).alias("ts"), F.lit(False).alias("tombstone"), (F.col("seq") + 10**12).alias("seq"))
    return lww.latest(log.unionByName(batch)).drop("seq")


@query(
    """SELECT l_partkey AS key, arg_max(l_orderkey, o) AS l_orderkey, arg_max(l_linenumber, o) AS l_linenumber, max(epoch_us(l_shipdate) * 1000) AS ts
    FROM (SELECT *, {'a': epoch_us(l_shipdate), 'b': -l_orderkey, 'c': -l_linenumber, 'd': -l_suppkey, 'e': -l_extendedprice} AS o FROM lineitem) GROUP BY l_partkey"""
)
def kv_tie_lww(spark, sf_dir):
    """Many equal times: order, line, supplier and price stand for arrival."""
    rows = table(spark, sf_dir, "lineitem").withColumn("ts", nanos(F.col("l_shipdate")))
    age = F.struct("ts", *[(-F.col(c)).alias(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")])
    slim = rows.select(F.col("l_partkey").alias("key"), "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "ts")
    return lww.latest(slim, "key", age).select("key", "l_orderkey", "l_linenumber", "ts")


@query(f"WITH {KV_SQL} SELECT key, seq % 4 AS layer, value, ts, tombstone FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq % 4 DESC, ts DESC, seq) AS n FROM kv) WHERE n = 1")
def layered_get(spark, sf_dir):
    log = kv(spark, sf_dir).withColumn("layer", F.col("seq") % 4)
    return lww.layered_get(log).select("key", "layer", "value", "ts", "tombstone")


@query(f"WITH {LATEST_SQL} SELECT key, value, ts, tombstone FROM latest")
def compact(spark, sf_dir):
    """Compaction of four runs gives what the raw log gives."""
    return lww.compact(kv(spark, sf_dir).withColumn("layer", F.col("seq") % 4)).drop("seq")


# Scans


@query(f"WITH {KV_SQL} SELECT key, value, ts, tombstone FROM kv WHERE ts >= {SINCE}")
def scan_since(spark, sf_dir):
    return scan.scan_since(kv(spark, sf_dir), SINCE).drop("seq")


@query(f"WITH {KV_SQL} SELECT key FROM kv WHERE ts >= {SINCE}")
def scan_since_keys(spark, sf_dir):
    log = kv(spark, sf_dir)
    return scan.scan_since_keys([log.filter(F.col("seq") % 4 == i) for i in range(4)], SINCE)


@query(f"WITH {LATEST_SQL} SELECT key, value, ts, tombstone FROM latest ORDER BY key")
def sorted_scan(spark, sf_dir):
    return scan.sorted_scan(kv(spark, sf_dir)).drop("seq")


@query(f"WITH {KV_SQL} SELECT seq % 4 AS layer, count(*) AS n_rows, min(ts) AS min_ts, max(ts) AS max_ts, sum(strlen(key) + strlen(value) + 17)::BIGINT AS n_bytes FROM kv GROUP BY ALL")
def run_stats(spark, sf_dir):
    return scan.run_stats(kv(spark, sf_dir).withColumn("layer", F.col("seq") % 4))


@query(f"WITH {LATEST_SQL} SELECT key, value, ts, tombstone FROM latest WHERE ts >= {SINCE}")
def sync_rows(spark, sf_dir):
    return scan.sync_rows(kv(spark, sf_dir), SINCE).drop("seq")


# Cuts: each run (event_id mod 4) or node (mod 3) is a sequence of its own

_SIZED = f"{KV_SQL}, sized AS (SELECT seq %% %d AS unit, seq, strlen(key) + strlen(value) + 17 AS size, ts FROM kv)"
_UPTO = ", upto AS (SELECT *, sum(size) OVER (PARTITION BY unit ORDER BY seq ROWS UNBOUNDED PRECEDING) - size AS off FROM sized)"


def _sized(spark, sf_dir, units: int) -> DataFrame:
    return kv(spark, sf_dir).select((F.col("seq") % units).alias("unit"), "seq", (F.length("key") + F.length("value") + 17).alias("size"), "ts")


@query(
    "WITH RECURSIVE "
    + _SIZED % 4
    + _UPTO
    + """, entries AS (SELECT unit, seq, off FROM upto WHERE off = 0 UNION ALL
      SELECT u.unit, min(u.seq), min(u.off) FROM entries e JOIN upto u ON u.unit = e.unit AND u.off - e.off >= 4096 GROUP BY u.unit, e.off)
    SELECT unit, seq, off::BIGINT AS "offset" FROM entries"""
)
def sparse_index(spark, sf_dir):
    return cuts.sparse_index(_sized(spark, sf_dir, 4), "unit", "seq", "size")


@query(
    "WITH RECURSIVE "
    + _SIZED % 3
    + _UPTO
    + """, starts AS (SELECT unit, seq, off, 0 AS segment FROM upto WHERE off = 0 UNION ALL
      SELECT u.unit, min(u.seq), min(u.off), e.segment + 1 FROM starts e JOIN upto u ON u.unit = e.unit AND u.off - e.off >= 65536 GROUP BY u.unit, e.off, e.segment)
    SELECT u.unit, u.segment, count(*) AS n_rows, sum(u.size)::BIGINT AS n_bytes, min(u.seq) AS first_seq
    FROM (SELECT x.*, (SELECT max(s.segment) FROM starts s WHERE s.unit = x.unit AND s.seq <= x.seq) AS segment FROM upto x) u GROUP BY ALL"""
)
def flush_cuts(spark, sf_dir):
    """Segments of 64 KiB and more, as memtables of that size would flush."""
    rows = cuts.flush_cuts(_sized(spark, sf_dir, 3), "unit", "seq", "size", 65536)
    return rows.groupBy("unit", "segment").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"), F.min("seq").alias("first_seq"))


@query(
    "WITH "
    + _SIZED % 3
    + " SELECT unit, (row_number() OVER (PARTITION BY unit ORDER BY seq) - 1) // 100 AS commit_group, seq FROM sized"
)
def group_commit_batches(spark, sf_dir):
    """Commit groups by size; waiting is long here, so that times don't cut."""
    return cuts.commit_groups(_sized(spark, sf_dir, 3), "unit", "seq", "ts", 100, 1 << 60).select("unit", "commit_group", "seq")


@query(
    "WITH RECURSIVE "
    + _SIZED % 3
    + """, rows AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY seq) AS rn FROM sized),
    starts AS (SELECT unit, rn, ts, seq, 0 AS commit_group FROM rows WHERE rn = 1 UNION ALL
      SELECT u.unit, min(u.rn), min(u.ts), min(u.seq), e.commit_group + 1 FROM starts e JOIN rows u ON u.unit = e.unit AND u.rn > e.rn
      AND (u.rn - e.rn >= 100 OR u.ts - e.ts >= 36000000000000) GROUP BY u.unit, e.rn, e.commit_group)
    SELECT unit, commit_group, seq AS first_seq FROM starts"""
)
def group_commit_timer(spark, sf_dir):
    """Commit groups by size or ten hours, whichever comes first."""
    rows = cuts.commit_groups(_sized(spark, sf_dir, 3), "unit", "seq", "ts", 100, 36_000_000_000_000)
    return rows.groupBy("unit", "commit_group").agg(F.min("seq").alias("first_seq"))


# Log frames


def _octets(number: str, n: int) -> str:
    """SQL for the low n bytes of a number that is not negative, least significant first, in hexadecimal."""
    return "concat(" + ", ".join(f"printf('%02X', ({number}) // {256**i} % 256)" for i in range(n)) + ")"


@query(
    f"""WITH {KV_SQL},
    crcs AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
    payloads AS (SELECT seq, {_octets("ts", 8)} || CASE WHEN tombstone THEN '01' ELSE '00' END || {_octets("strlen(key)", 4)} || {_octets("strlen(coalesce(value, ''))", 4)}
      || hex(key) || hex(coalesce(value, '')) AS p FROM kv),
    octets AS (SELECT seq, p, list_transform(range(length(p) // 2), lambda i: ('0x' || substr(p, 2 * i + 1, 2))::BIGINT) AS o FROM payloads),
    sums AS (SELECT seq, p, xor(list_reduce(list_prepend(4294967295::BIGINT, o), lambda a, v: xor(a // 256, t[xor(a % 256, v) + 1])), 4294967295) AS crc FROM octets, crcs)
    SELECT seq, {_octets("crc", 4)} || p AS frame, crc FROM sums"""
)
def wal_frame_crc(spark, sf_dir):
    """Each row's frame in hexadecimal, and its checksum."""
    log = kv(spark, sf_dir).withColumn("key", F.col("key").cast("binary")).withColumn("value", F.col("value").cast("binary"))
    return wal.to_frames(log).withColumn("frame", F.hex("frame"))


@query(f"WITH {KV_SQL} SELECT key, ts, seq FROM kv WHERE seq < (SELECT count(*) // 2 FROM events)")
def wal_valid_prefix(spark, sf_dir):
    """A log damaged at the middle row and at a later one gives what is before the first."""
    log = kv(spark, sf_dir)
    middle = F.broadcast(log.agg(F.floor(F.count("*") / 2).alias("middle")))
    marked = log.crossJoin(middle).withColumn("valid", (F.col("seq") != F.col("middle")) & (F.col("seq") != F.col("middle") + 3))
    return scan.valid_prefix(marked.drop("middle")).select("key", "ts", "seq")


# Bloom filter over user keys

N_BLOOM = 1000
_FNV = "list_reduce([14695981039346656037::HUGEINT] || [ord(x)::HUGEINT FOR x IN string_split({s}, '')], LAMBDA a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
_M, _KH = 9586, 7
_BITS_SQL = f"hashed AS (SELECT DISTINCT key, {_FNV.format(s='key')} AS h FROM kv), bits AS (SELECT DISTINCT (((h // 4294967296 + i * (h % 4294967296)) % 4294967296) % {_M})::BIGINT AS bit FROM hashed, range({_KH}) t(i))"


def _bloom_bits(spark, sf_dir) -> DataFrame:
    keys = kv(spark, sf_dir).select("key").distinct()
    return bloom.build(keys, F.col("key").cast("binary"), N_BLOOM)


@query(f"WITH {KV_SQL}, {_BITS_SQL} SELECT bit FROM bits")
def bloom_bits(spark, sf_dir):
    return _bloom_bits(spark, sf_dir)


_PROBE_SQL = f"""asked AS (SELECT 'user_' || c_custkey AS key, {_FNV.format(s="'user_' || c_custkey")} AS h FROM customer),
probed AS (SELECT key, bool_and(bit IS NOT NULL) AS maybe FROM (SELECT a.key, b.bit FROM asked a, range({_KH}) t(i) LEFT JOIN bits b ON b.bit = (((h // 4294967296 + i * (h % 4294967296)) % 4294967296) % {_M})) GROUP BY key)"""


def _probed(spark, sf_dir) -> DataFrame:
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("user_"), F.col("c_custkey").cast("string")).alias("key"))
    return bloom.probe(asked, F.col("key").cast("binary"), _bloom_bits(spark, sf_dir), N_BLOOM)


@query(f"WITH {KV_SQL}, {_BITS_SQL}, {_PROBE_SQL} SELECT key, maybe FROM probed")
def bloom_probe(spark, sf_dir):
    return _probed(spark, sf_dir)


@query(f"WITH {KV_SQL}, {_BITS_SQL}, {_PROBE_SQL} SELECT count(*) AS n_absent, count_if(maybe) AS n_false FROM probed WHERE key NOT IN (SELECT key FROM kv)")
def bloom_fpr(spark, sf_dir):
    absent = _probed(spark, sf_dir).join(kv(spark, sf_dir).select("key"), "key", "left_anti")
    return absent.agg(F.count("*").alias("n_absent"), F.count_if("maybe").alias("n_false"))


# Placement

_RING_KEYS = f"keys AS (SELECT c_name AS key, {_FNV.format(s='c_name')} AS h FROM customer)"


def _tokens_sql(nodes: list[str], name: str = "tokens") -> str:
    labels = " UNION ALL ".join(f"SELECT '{n}' AS node, '{n}#{i}' AS label" for n in nodes for i in range(VNODES))
    return f"{name} AS (SELECT node, {_FNV.format(s='label')} AS token FROM ({labels}))"


def _placed_sql(tokens: str = "tokens", name: str = "placed") -> str:
    return f"""{name} AS (SELECT key, node, row_number() OVER (PARTITION BY key ORDER BY spot.a, spot.b) AS place
      FROM (SELECT key, node, min({{'a': token < h, 'b': token}}) AS spot FROM keys, {tokens} GROUP BY key, node))"""


def _ring_keys(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"))


@query(f"WITH {_RING_KEYS} SELECT key, h::VARCHAR AS h FROM keys")
def fnv1a64_keys(spark, sf_dir):
    return _ring_keys(spark, sf_dir).select("key", fnv1a64(F.col("key").cast("binary")).cast("string").alias("h"))


@query(f"WITH {_tokens_sql(NODES)} SELECT token::VARCHAR AS token, node FROM tokens")
def ring_tokens(spark, sf_dir):
    nodes = spark.createDataFrame([(n,) for n in NODES], "node string")
    return ring.tokens(nodes, VNODES).select(F.col("token").cast("string").alias("token"), "node")


@query(f"WITH {_RING_KEYS}, {_tokens_sql(NODES)}, {_placed_sql()} SELECT key, node FROM placed WHERE place = 1")
def ring_route(spark, sf_dir):
    return ring.route(_ring_keys(spark, sf_dir), F.col("key").cast("binary"), ring.HashRing(NODES, VNODES))


@query(f"WITH {_RING_KEYS}, {_tokens_sql(NODES)}, {_placed_sql()} SELECT key, place::BIGINT AS place, node FROM placed WHERE place <= {COPIES}")
def ring_replicas(spark, sf_dir):
    placed = ring.replicas(_ring_keys(spark, sf_dir), F.col("key").cast("binary"), ring.HashRing(NODES, VNODES), COPIES)
    return placed.select("key", F.posexplode("owners").alias("place", "node")).withColumn("place", (F.col("place") + 1).cast("long"))


@query(
    f"WITH {_RING_KEYS}, {_tokens_sql(NODES)}, {_placed_sql()}, {_tokens_sql(NODES[1:], 'tokens2')}, {_placed_sql('tokens2', 'placed2')} "
    "SELECT a.key, a.node AS old_node, b.node AS new_node FROM placed a JOIN placed2 b ON a.key = b.key AND a.place = 1 AND b.place = 1 WHERE a.node <> b.node"
)
def ring_remap(spark, sf_dir):
    before = ring.HashRing(NODES, VNODES)
    return ring.remap(_ring_keys(spark, sf_dir), F.col("key").cast("binary"), before, before.without(NODES[0])).select("key", "old_node", "new_node")


@query(f"WITH {_RING_KEYS}, {_tokens_sql(NODES)}, {_placed_sql()} SELECT n.node, count(p.key) AS n_keys FROM (SELECT DISTINCT node FROM tokens) n LEFT JOIN placed p ON p.node = n.node AND p.place = 1 GROUP BY n.node")
def ring_balance(spark, sf_dir):
    return ring.balance(_ring_keys(spark, sf_dir), F.col("key").cast("binary"), ring.HashRing(NODES, VNODES))


# Quorums

_ACKS_SQL = f"{KV_SQL}, acks AS (SELECT seq, key, value, ts, tombstone, node, (seq * 31 + node) % 5 <> 0 AS ok FROM kv, range(3) t(node))"


def _acks(spark, sf_dir) -> DataFrame:
    log = kv(spark, sf_dir).withColumn("node", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])))
    return log.withColumn("ok", (F.col("seq") * 31 + F.col("node")) % 5 != 0)


@query(f"WITH {_ACKS_SQL} SELECT seq, count_if(ok) AS n_ok, count_if(ok) >= 2 AS committed FROM acks GROUP BY seq")
def quorum_write(spark, sf_dir):
    return quorum.write_outcome(_acks(spark, sf_dir), ["seq"], 2)


@query(f"WITH {_ACKS_SQL} SELECT node AS target, seq, key, value, ts, tombstone FROM acks WHERE NOT ok")
def quorum_hints(spark, sf_dir):
    return quorum.hints_of(_acks(spark, sf_dir)).select("target", "seq", "key", "value", "ts", "tombstone")


@query(
    f"""WITH {ANSWERS_SQL}, good AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY resp_order) AS place FROM answers WHERE ok),
    best AS (SELECT key, count(*) AS n_ok, arg_max({{'v': value, 't': ts, 'd': tombstone}}, {{'a': ts, 'b': -resp_order}}) AS w FROM good WHERE place <= 2 GROUP BY key)
    SELECT k.key, coalesce(n_ok, 0) AS n_ok, coalesce(n_ok, 0) >= 2 AS quorum, CASE WHEN n_ok >= 2 THEN w.v END AS value, CASE WHEN n_ok >= 2 THEN w.t END AS ts, CASE WHEN n_ok >= 2 THEN w.d END AS tombstone
    FROM (SELECT DISTINCT key FROM answers) k LEFT JOIN best USING (key)"""
)
def quorum_read(spark, sf_dir):
    return quorum.read_resolve(answers(spark, sf_dir), 2).drop("found").withColumn("quorum", F.coalesce("quorum", F.lit(False)))


_STALE_SQL = ANSWERS_SQL + ", stale AS (SELECT key, node, ts, best_ts FROM (SELECT *, max(ts) OVER (PARTITION BY key) AS best_ts FROM answers WHERE ok) WHERE ts < best_ts)"


@query(f"WITH {_STALE_SQL} SELECT key, node, ts, best_ts FROM stale")
def stale_replicas(spark, sf_dir):
    return quorum.stale_replicas(answers(spark, sf_dir))


@query(
    f"""WITH {_STALE_SQL}, won AS (SELECT key, value, ts, tombstone FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, resp_order) AS n FROM answers WHERE ok) WHERE n = 1)
    SELECT s.node, s.key, w.value, w.ts, w.tombstone FROM stale s JOIN won w USING (key)"""
)
def read_repair(spark, sf_dir):
    return quorum.read_repair(answers(spark, sf_dir))


@query(
    f"""WITH {_ACKS_SQL}, rows AS (SELECT node, key, value, ts, tombstone, seq FROM acks WHERE ok OR node IN (0, 1))
    SELECT node, key, value, ts, tombstone FROM (SELECT *, row_number() OVER (PARTITION BY node, key ORDER BY ts DESC, seq) AS n FROM rows) WHERE n = 1"""
)
def hints_replay(spark, sf_dir):
    """Nodes 0 and 1 are up again and take what they missed; node 2 stays behind."""
    acks = _acks(spark, sf_dir)
    columns = ["node", "key", "value", "ts", "tombstone", "seq"]
    up = spark.createDataFrame([(0,), (1,)], "node long")
    return quorum.replay_hints(quorum.hints_of(acks), up, acks.filter("ok").select(*columns)).drop("seq")


@query(
    """WITH beats AS (SELECT user_id AS node, event_id AS tick, event_type IN ('signup', 'purchase') AS ok FROM events),
    islands AS (SELECT *, sum(ok::INT) OVER (PARTITION BY node ORDER BY tick) AS island FROM beats),
    counted AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY node, island ORDER BY tick)::BIGINT AS misses FROM islands)
    SELECT node, tick, ok, misses, CASE WHEN misses >= 3 THEN 'DEAD' ELSE 'ALIVE' END AS state,
      ok AND lag(misses, 1, 0) OVER (PARTITION BY node ORDER BY tick) >= 3 AS recovered FROM counted"""
)
def failure_detector(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return quorum.failure_detector(e.select(F.col("user_id").alias("node"), F.col("event_id").alias("tick"), F.col("event_type").isin("signup", "purchase").alias("ok")))


_TWO_SQL = f"""{KV_SQL}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq) AS n FROM kv WHERE seq % 3 <> 0) WHERE n = 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq) AS n FROM kv WHERE seq % 3 <> 1) WHERE n = 1)"""


@query(
    f"""WITH {_TWO_SQL} SELECT coalesce(a.key, b.key) AS key, a.ts AS local_ts, b.ts AS remote_ts, CASE WHEN b.ts IS NULL OR a.ts > b.ts THEN 'local' ELSE 'remote' END AS side
    FROM a FULL JOIN b ON a.key = b.key WHERE a.ts IS DISTINCT FROM b.ts"""
)
def sync_diff(spark, sf_dir):
    log = kv(spark, sf_dir)
    return quorum.sync_diff(log.filter("seq % 3 <> 0"), log.filter("seq % 3 <> 1"))


@query(
    f"""WITH {_TWO_SQL}, rows AS (SELECT key, value, ts, tombstone, seq FROM kv WHERE seq % 3 <> 0 UNION ALL SELECT key, value, ts, tombstone, seq FROM b WHERE ts >= {SINCE})
    SELECT key, value, ts, tombstone FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq) AS n FROM rows) WHERE n = 1"""
)
def anti_entropy(spark, sf_dir):
    log = kv(spark, sf_dir)
    return quorum.anti_entropy(log.filter("seq % 3 <> 0"), log.filter("seq % 3 <> 1"), SINCE).drop("seq")


# Vectors

_COS = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


def _query_vector(spark, sf_dir) -> list[float]:
    return [float(x) for x in vectors(spark, sf_dir).filter("id = 'vec_0'").first()["vector"]]


@query("SELECT 'label_' || label AS id, max(vec_id) AS seq, arg_max(embedding[1], vec_id)::DOUBLE AS first_value FROM embeddings GROUP BY label")
def vector_lww(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("id"), "vector", "seq")
    return vector.latest_vectors(rows).select("id", "seq", F.col("vector")[0].cast("double").alias("first_value"))


@query(f"SELECT 'vec_' || a.vec_id AS id, round({_COS.format(a='a.embedding', b='q.embedding')}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def cosine_scores(spark, sf_dir):
    return vector.scores(vectors(spark, sf_dir), _query_vector(spark, sf_dir)).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT 'vec_' || a.vec_id AS id, round({_COS.format(a='a.embedding', b='q.embedding')}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_COS.format(a='a.embedding', b='q.embedding')} DESC, id LIMIT {K}")
def knn(spark, sf_dir):
    return vector.knn(vectors(spark, sf_dir), _query_vector(spark, sf_dir), K).select("id", F.round("score", 6).alias("score"))


@query(
    f"""SELECT qid, rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
      SELECT 'vec_' || q.vec_id AS qid, 'vec_' || a.vec_id AS id, {_COS.format(a='a.embedding', b='q.embedding')} AS score FROM embeddings a, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= {K}"""
)
def knn_batch(spark, sf_dir):
    """Every row whose id is divisible by 100 is a query against all rows."""
    rows = vectors(spark, sf_dir)
    queries = [(r[0], [float(x) for x in r[1]]) for r in rows.filter("seq % 100 = 0").select("id", "vector").toLocalIterator()]
    found = vector.knn_batch(rows, queries, K)
    return found.select("qid", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


@query(ORACLES["knn"])
def knn_sharded(spark, sf_dir):
    """Three shards that overlap: rows of every fifth id are on two of them."""
    rows = vectors(spark, sf_dir)
    shards = [rows.filter((F.col("seq") % 3 == i) | ((F.col("seq") % 5 == 0) & (F.col("seq") % 3 == (i + 1) % 3))) for i in range(3)]
    return vector.knn_sharded(shards, _query_vector(spark, sf_dir), K).select("id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {LATEST_SQL} SELECT 'user_' || a.vec_id AS id, round({_COS.format(a='a.embedding', b='q.embedding')}, 6) AS score
    FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE 'user_' || a.vec_id NOT IN (SELECT key FROM latest WHERE tombstone)
    ORDER BY {_COS.format(a='a.embedding', b='q.embedding')} DESC, id LIMIT {K}"""
)
def knn_live(spark, sf_dir):
    """Vectors of deleted keys are not found."""
    rows = vectors(spark, sf_dir).withColumn("key", F.concat(F.lit("user_"), F.col("seq").cast("string"))).withColumn("id", F.col("key"))
    found = vector.knn(vector.searchable(rows, kv(spark, sf_dir)), _query_vector(spark, sf_dir), K)
    return found.select("id", F.round("score", 6).alias("score"))


@query("SELECT 'vec_' || vec_id AS id, round(embedding[1]::DOUBLE + 0.5, 6) AS score FROM embeddings")
def parsed_vectors(spark, sf_dir):
    """A vector given as text, with a number that is none, scored against each row."""
    text = F.concat_ws(",", F.col("vector")[0].cast("string"), F.lit(" 0.5"), F.lit("oops"))
    rows = vectors(spark, sf_dir).withColumn("parsed", parse_vector(text))
    return rows.select("id", F.round(F.col("parsed")[0].cast("double") + F.col("parsed")[1] + F.col("parsed")[2], 6).alias("score"))


# Metrics


@query("SELECT event_type AS op, count(*) AS total, count_if(event_type = 'error') AS errors, round(avg(value), 6) AS mean_ms FROM events GROUP BY event_type")
def op_metrics(spark, sf_dir):
    return metrics.op_summary(_ops(spark, sf_dir))


def _ops(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("op"), F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("error"))


@query(
    "SELECT op, s[floor(n * 0.5)::BIGINT + 1] AS p50, s[floor(n * 0.95)::BIGINT + 1] AS p95, s[floor(n * 0.99)::BIGINT + 1] AS p99 "
    "FROM (SELECT event_type AS op, list_sort(list(value)) AS s, count(*)::DOUBLE AS n FROM events GROUP BY event_type)"
)
def latency_percentiles(spark, sf_dir):
    return metrics.floor_percentiles(_ops(spark, sf_dir))


@query("SELECT date_trunc('day', ts) AS day, count(*) AS n_ops, round(count(*) / 86400.0, 9) AS ops_per_s FROM events GROUP BY ALL")
def throughput(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n_ops"), F.round(F.count("*") / F.lit(86400.0), 9).alias("ops_per_s"))


# Features and classifier


@query(
    f"""WITH {LATEST_SQL} SELECT 'user_' || c_custkey AS key, CASE WHEN ts IS NULL THEN 'absent' WHEN tombstone THEN 'deleted' ELSE 'live' END AS outcome,
    CASE WHEN NOT tombstone THEN [json_extract(value, '$.k')::DOUBLE, 1.0] END AS features FROM customer LEFT JOIN latest ON key = 'user_' || c_custkey"""
)
def feature_lookup(spark, sf_dir):
    """Requests of customers against features kept as JSON arrays."""
    keys = table(spark, sf_dir, "customer").select(F.concat(F.lit("user_"), F.col("c_custkey").cast("string")).alias("key"))
    log = kv(spark, sf_dir).withColumn("value", F.concat(F.lit("["), F.get_json_object("value", "$.k"), F.lit(", 1.0]")))
    return ml.feature_lookup(keys, log).select("key", "outcome", "features")


@query()
def predict(spark, sf_dir):
    """Logistic regression on embeddings, trained on four of five rows; every row gets a prediction, the fifth is held out."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("features"), (F.col("label") % 2).alias("label"))
    model = ml.train(rows.filter("vec_id % 5 <> 0"))
    scored = ml.predict(model, rows)
    return scored.select("vec_id", (F.col("vec_id") % 5 == 0).alias("held_out"), "label", "prediction", F.round("probability", 6).alias("probability"))


@query("SELECT vec_id, len(embedding) AS n_features, true AS same FROM embeddings")
def feature_values(spark, sf_dir):
    """Features put as the JSON arrays that values are, and read back as they were."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    back = rows.withColumn("value", ml.feature_value(F.col("features"))).withColumn("back", ml.features_of(F.col("value")))
    return back.select("vec_id", F.size("back").cast("long").alias("n_features"), (F.col("back") == F.col("features")).alias("same"))


@query("SELECT * FROM (VALUES ('v1', 'age'), ('v1', 'click_rate'), ('v1', 'past_purchases'), ('v1', 'embedding_vector'), ('v2', 'age')) t(version, feature)")
def schema_registry(spark, sf_dir):
    registry = ml.register_schema(ml.empty_registry(spark), "v1", ["age", "click_rate", "past_purchases", "embedding_vector"])
    registry = ml.register_schema(ml.register_schema(registry, "v2", ["old"]), "v2", ["age"])
    return registry.select("version", F.explode("features").alias("feature"))


# Storage and streams


@query(f"WITH {LATEST_SQL} SELECT key, value, ts, tombstone FROM latest")
def store_compacted(spark, sf_dir):
    """Four batches put into a store, compacted, and read."""
    log = kv(spark, sf_dir)
    store = Store(spark, files.fresh_folder(spark, "store"))
    for i in range(4):
        store.put_batch(log.filter(F.col("seq") % 4 == i))
    store.compact()
    return store.view().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "ts", "tombstone")


@query(f"WITH {KV_SQL} SELECT count(*) AS n_rows, sum(seq)::BIGINT AS sum_seq, count(DISTINCT key) AS n_keys FROM kv")
def backup_gzip(spark, sf_dir):
    store, copy = Store(spark, files.fresh_folder(spark, "store")), files.fresh_folder(spark, "backup")
    store.put_batch(kv(spark, sf_dir))
    store.backup(copy)
    return spark.read.schema(RECORD).parquet(copy).agg(F.count("*").alias("n_rows"), F.sum("seq").alias("sum_seq"), F.count_distinct("key").alias("n_keys"))


def _as_stream(spark, sf_dir) -> DataFrame:
    """The log in files of mixed order, two to a micro-batch."""
    folder = files.fresh_folder(spark, "stream")
    log = kv(spark, sf_dir).select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "ts", "tombstone", "seq")
    log.repartition(8, F.hash("seq")).write.parquet(folder)
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 2).parquet(folder)


def _shown(log: DataFrame) -> DataFrame:
    return log.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "ts", "tombstone")


@query(f"WITH {LATEST_SQL} SELECT key, value, ts, tombstone FROM latest")
def stream_ingest_lww(spark, sf_dir):
    """A stream appended to a log, batch by batch, then read as of now."""
    log, state = files.fresh_folder(spark, "log"), files.fresh_folder(spark, "state")
    ingest.ingest_log(_as_stream(spark, sf_dir), log, state).awaitTermination()
    return _shown(lww.latest(ingest.read_log(spark, log, LOG)))


@query(f"WITH {LATEST_SQL} SELECT key, value, ts, tombstone FROM latest")
def stream_lww_state(spark, sf_dir):
    """Keyed state over a stream; its changes add up to the view."""
    out, state = files.fresh_folder(spark, "changes"), files.fresh_folder(spark, "state")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    ingest.lww_changes(_as_stream(spark, sf_dir), sink, state).awaitTermination()
    return _shown(ingest.fold_changes(ingest.read_log(spark, out, LOG)))


@query("SELECT 'vec_' || a.vec_id AS a, 'vec_' || b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_neighbours(spark, sf_dir):
    """Similarity of each vector to the next."""
    rows = vectors(spark, sf_dir)
    after = rows.select((F.col("seq") - 1).alias("seq"), F.col("id").alias("b"), F.col("vector").alias("other"))
    return rows.join(after, "seq").select(F.col("id").alias("a"), "b", F.round(cosine(F.col("vector"), F.col("other")), 6).alias("score"))


@query(ORACLES["failure_detector"])
def stream_failure_detector(spark, sf_dir):
    """Heartbeats come in three files, one to a micro-batch; state is kept between them."""
    e = table(spark, sf_dir, "events")
    beats = e.select(F.col("user_id").alias("node"), F.col("event_id").alias("tick"), F.col("event_type").isin("signup", "purchase").alias("ok"))
    source, out, state = (files.fresh_folder(spark, x) for x in ("beats", "states", "state"))
    third = beats.agg(F.floor(F.max("tick") / 3 + 1)).first()[0] or 1
    for i in range(3):  # files are read in the order in which they were written
        beats.filter(F.floor(F.col("tick") / third) == i).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(beats.schema).option("maxFilesPerTrigger", 1).parquet(source)
    found = detector.detect(stream)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(detector.OUT).parquet(out)
